"""The registry of queries and the domain views that they read."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chatterlake.plans.sqlviews import with_views
from chatterlake.functions.money import BANDS
from chatterlake.operators.signals import last_rows
from chatterlake.sources import landed


#: A ticker with more rows than this doesn't meet in one task before they are combined.
HOT_ROWS = 2_000_000


def _bars(rows: DataFrame) -> DataFrame:
    order, price = F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice"), F.col("l_extendedprice") / F.col("l_quantity")
    return rows.groupBy("ticker", "date").agg(
        F.min_by(price, order).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"),
        F.max_by(price, order).alias("close"), F.sum("l_quantity").cast("long").alias("volume"),
    )


class Tables:
    """The driver tables of a folder, and the domain tables derived from them."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @cached_property
    def bars(self) -> DataFrame:
        """A bar a ticker and day. One shuffle by ticker serves the bars and all windows over them; tickers with more rows than a task
        should have are combined by day first."""
        rows = self.read("lineitem").select(F.col("l_suppkey").alias("ticker"), F.to_date("l_shipdate").alias("date"), "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_quantity")
        hot = landed.saved(rows.groupBy("ticker").agg(F.count("*").alias("n")).where(F.col("n") > HOT_ROWS).select("ticker"), "hot-tickers")
        if not hot.limit(1).count():
            return _bars(rows.repartition("ticker"))
        return _bars(rows.join(landed.small(hot), "ticker", "left_anti").repartition("ticker")).unionByName(_bars(rows.join(landed.small(hot), "ticker", "left_semi")))

    @cached_property
    def universe(self) -> DataFrame:
        s = self.read("supplier").join(F.broadcast(self.read("nation")), F.col("s_nationkey") == F.col("n_nationkey")).join(F.broadcast(self.read("region")), F.col("n_regionkey") == F.col("r_regionkey"))
        both = s.select(F.col("s_suppkey").alias("ticker"), F.explode(F.array("n_name", "r_name")).alias("sector"), (F.col("n_nationkey") % 2 == 1).alias("speculative"))
        return both

    @cached_property
    def news(self) -> DataFrame:
        n = self.read("supplier").count()
        return self.read("orders").select((F.col("o_orderkey") % n).alias("ticker"), F.to_date("o_orderdate").alias("date"), F.concat("o_orderpriority", F.col("o_custkey").cast("string")).alias("link"), F.col("o_orderkey").alias("news_id"), F.col("o_orderpriority").alias("title"))

    @cached_property
    def mentions(self) -> DataFrame:
        e = self.read("events").select(F.col("user_id").alias("ticker"), F.to_date("ts").alias("date"), "event_type", F.col("value").cast("decimal(18,2)").alias("v"))
        each = e.select("ticker", "date", F.explode(F.array("event_type", F.lit(""))).alias("subreddit"), "v")
        day = each.groupBy("ticker", "date", "subreddit").agg(F.count("*").alias("mention_count"), F.sum("v").cast("double").alias("upvote_sum"))
        before = day.select("ticker", F.date_add("date", 1).alias("date"), "subreddit", F.col("mention_count").alias("mentions_24h_ago"))
        return day.join(before, ["ticker", "date", "subreddit"], "left")

    @cached_property
    def etf_flows(self) -> DataFrame:
        from pyspark.sql import Window

        w = Window.partitionBy("ticker").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
        return self.bars.select(F.col("ticker").alias("etf"), "date", F.col("close").alias("price"), (F.col("close") * F.sum("volume").over(w)).alias("aum"))

    @cached_property
    def etf_map(self) -> DataFrame:
        s = self.read("supplier").join(F.broadcast(self.read("nation")), F.col("s_nationkey") == F.col("n_nationkey"))
        return last_rows(s.select(F.col("n_name").alias("sector"), F.col("s_suppkey").alias("etf")), ["sector"], 3, F.col("etf")).drop("rank")

    @cached_property
    def deals(self) -> DataFrame:
        o = self.read("orders").join(self.read("customer"), F.col("o_custkey") == F.col("c_custkey")).join(F.broadcast(self.read("nation")), F.col("c_nationkey") == F.col("n_nationkey"))
        return o.select(F.col("o_orderkey").alias("deal_key"), F.col("n_name").alias("sector"), F.to_date("o_orderdate").alias("date"), F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice")).alias("amount"), F.col("o_orderpriority").alias("deal_type"), F.col("o_custkey").alias("custkey"))

    @cached_property
    def econ(self) -> DataFrame:
        o = self.read("orders").groupBy(F.col("o_orderpriority").alias("series_id"), F.trunc("o_orderdate", "month").alias("date"))
        return o.agg(F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("value"))

    @cached_property
    def raw_trades(self) -> DataFrame:
        """Trades with the amount as text of its band, as disclosures give it."""
        p = F.col("o_totalprice")
        text = F.when(p > 50_000_000, F.lit("Over $50,000,000"))
        for low, high in BANDS:
            text = text.when(p <= high, F.lit(f"${low:,} - ${high:,}"))
        o = self.read("orders").join(self.read("customer"), F.col("o_custkey") == F.col("c_custkey"))
        return o.select(
            F.col("o_orderkey").alias("filing_id"), F.col("c_name").alias("full_name"), F.concat(F.lit("T"), (F.col("o_custkey") % 50).cast("string")).alias("ticker"),
            F.to_date("o_orderdate").alias("transaction_date"), F.date_add(F.to_date("o_orderdate"), (F.col("o_orderkey") % 46).cast("int")).alias("disclosure_date"),
            text.alias("amount"), F.when(F.col("o_orderstatus") == "F", "Purchase").when(F.col("o_orderstatus") == "O", "Sale (Full)").otherwise("Exchange").alias("type"),
            F.col("o_orderpriority").alias("asset_type"), F.col("c_mktsegment").alias("party"),
        )

    @cached_property
    def members(self) -> DataFrame:
        return self.read("customer").select(F.col("c_custkey").alias("bioguide_id"), F.col("c_name").alias("full_name"), F.col("c_mktsegment").isin("BUILDING", "MACHINERY").alias("is_watched"), (F.col("c_acctbal") > 9000).alias("is_star"))

    @cached_property
    def posts(self) -> DataFrame:
        d = self.read("documents")
        return d.select(
            F.col("doc_id").alias("post_id"), F.col("source").alias("subreddit"), F.concat(F.lit("u"), (F.col("doc_id") % 41).cast("string")).alias("author"),
            F.substring_index("text", "\n", 1).alias("title"), F.col("text").alias("body"), (F.timestamp_seconds(F.lit(1704067200) + F.col("doc_id") * 60)).alias("created_at"),
            (F.col("n_chars") % 97).alias("score"), (F.col("n_chars") % 23).alias("num_comments"),
        )

    @cached_property
    def sightings(self) -> DataFrame:
        return self.read("events").select(F.col("user_id").alias("post_id"), F.col("ts").alias("seen_at"), F.col("event_id"), F.floor("value").cast("long").alias("score"), F.get_json_object("props", "$.k").cast("long").alias("num_comments"))

    @cached_property
    def comments(self) -> DataFrame:
        c = self.read("conversations")
        return c.select(F.col("conv_id").alias("post_id"), (F.col("conv_id") * 1000 + F.col("turn")).alias("comment_id"), F.when(F.col("turn") > 0, F.col("conv_id") * 1000 + F.col("turn") - 1).alias("parent_id"), F.col("role").alias("author"), F.col("text").alias("body"), (F.length("text") % 50).cast("long").alias("score"), "turn")

    @cached_property
    def tweets(self) -> DataFrame:
        """One row per tweet and provider that saw it."""
        e = self.read("events").select(F.col("event_id").alias("tweet_id"), F.col("user_id").alias("handle"), F.col("ts").alias("created_at"), F.concat_ws(" ", "event_type", "props").alias("text"), F.concat(F.lit("$"), F.upper(F.translate("event_type", "_", "")), F.lit(" "), F.col("props")).alias("cash_text"), "event_type", F.get_json_object("props", "$.k").cast("long").alias("k"))
        seen = F.array_compact(F.array(F.when(F.col("tweet_id") % 10 != 0, F.lit("A")), F.when(F.col("tweet_id") % 7 != 0, F.lit("B"))))
        return e.withColumn("provider", F.explode(seen))

    @cached_property
    def day_log(self) -> DataFrame:
        t = self.tweets.groupBy("handle", F.to_date("created_at").alias("date"), "provider").agg(F.count("*").alias("tweets_fetched"))
        mark = F.pmod(F.col("handle") * 7 + F.dayofmonth("date") * 3 + F.ascii("provider"), F.lit(11))
        return t.withColumn("status", F.when(mark == 0, "failed").when(mark == 1, "exhausted").otherwise("complete"))


REGISTERED: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable:
    """Register a function of Tables under a name, with the SQL that gives the same rows."""

    def add(f: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        REGISTERED[name] = lambda spark, folder: f(Tables(spark, folder))
        if sql is not None:
            SQL[name] = with_views(sql)
        return f

    return add


def r6(c: str, name: str | None = None):
    return F.round(F.col(c), 6).alias(name or c)
