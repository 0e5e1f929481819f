"""Landed files to clean tables: prices, news, tweets, posts, communities, economic observations, deals, run files."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chatterlake.functions.text import collapse, finite

NEWS_SCHEMA = "ticker string, title string, link string, publisher string, providerPublishTime long, content struct<title:string,pubDate:string,canonicalUrl:struct<url:string>,clickThroughUrl:struct<url:string>,provider:struct<displayName:string>>"
TWEET_SCHEMA = "id string, text string, createdAt string, isReply boolean, inReplyToId string, likeCount long, media array<struct<url:string,media_url:string>>, _corrupt string"
POST_SCHEMA = "id string, name string, title string, selftext string, body string, author string, score long, ups long, num_comments long, created_utc double"
COMMUNITY_SCHEMA = "display_name string, name string, subscribers long, title string, public_description string, created_utc double, over18 boolean, over_18 boolean, quarantine boolean"
BODY_CAP = 10_000
#: Widest table, in rows, that is sent to every task.
BROADCAST_ROWS = 50_000
#: Values of a column that a parquet file may hold once each.
DICTIONARY_BYTES = 16 << 20


def scratch(spark: SparkSession, name: str) -> str:
    """A new path that driver and executors share, in the application's own part of the folder in ``spark.checkpoint.dir``;
    where that is unset (local tests), a new temporary folder becomes it."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return f"{folder.rstrip('/')}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def clear_scratch(spark: SparkSession) -> None:
    """Remove all that the application has written there: call it when no result is to be read any more."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder.rstrip('/')}/{spark.sparkContext.applicationId}")
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def saved(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back: lineage ends there, and it is computed once."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def repeats_written_once(spark: SparkSession, *columns: str) -> None:
    """For columns of long values that are repeated row by row: from now on the session's parquet files hold a value once each, if it is up
    to DICTIONARY_BYTES long with the others, not up to Parquet's 1 MB; and the least and greatest value of each page of these
    columns, of which a writer keeps whole copies, aren't kept. Settings that somebody has made stay."""
    wanted = {"parquet.dictionary.page.size": str(DICTIONARY_BYTES)} | {f"parquet.column.statistics.enabled#{c}": "false" for c in columns}
    for name, value in wanted.items():
        if spark.conf.get(name, None) is None:
            spark.conf.set(name, value)


def spread(df: DataFrame) -> DataFrame:
    """Rows dealt out over as many tasks as shuffles have, where the files would be read by fewer than there are cores for."""
    tasks = max(df.sparkSession.sparkContext.defaultParallelism, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return df.repartition(tasks) if df.rdd.getNumPartitions() < df.sparkSession.sparkContext.defaultParallelism else df


def small(df: DataFrame) -> DataFrame:
    """Broadcast a saved table if its rows are few; else leave it to a shuffled join, whose hot keys AQE splits."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def clean_bars(raw: DataFrame) -> DataFrame:
    """Bars with all fields; adj_close falls back on close."""
    adj = F.coalesce("adj_close", "close")
    b = raw.select("ticker", F.col("date").cast("date").alias("date"), *(finite(F.col(c).cast("double")).alias(c) for c in ("open", "high", "low", "close")), finite(adj.cast("double")).alias("adj_close"), F.col("volume").cast("long").alias("volume"))
    return b.dropna()


def read_news(spark: SparkSession, path: str) -> DataFrame:
    """Two shapes of items in one table; what lacks a title, link or date is dropped."""
    n = spark.read.schema(NEWS_SCHEMA).json(path)
    when = F.coalesce(F.expr("try_to_timestamp(content.pubDate)"), F.timestamp_seconds("providerPublishTime"))
    out = n.select(
        "ticker", F.coalesce("content.title", "title").alias("title"), F.coalesce("content.canonicalUrl.url", "content.clickThroughUrl.url", "link").alias("link"),
        F.coalesce("content.provider.displayName", "publisher").alias("publisher"), when.alias("published_at"),
    )
    return out.where("coalesce(title, '') != '' and coalesce(link, '') != '' and published_at is not null")


def is_corrupt_news(title: Column, published_at: Column) -> Column:
    return (F.coalesce(title, F.lit("")) == "") | (F.year(published_at) == 1970)


def read_tweets(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(rows, malformed count as one row): malformed lines and lines without an id are skipped and counted."""
    raw = spark.read.text(path).select(F.from_json("value", TWEET_SCHEMA, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}).alias("t"))
    bad = F.col("t._corrupt").isNotNull() | F.col("t.id").isNull()
    urls = F.array_compact(F.transform(F.coalesce("t.media", F.array().cast("array<struct<url:string,media_url:string>>")), lambda m: F.coalesce(m.url, m.media_url)))
    rows = raw.where(~bad).select(F.col("t.id").cast("long").alias("tweet_id"), F.col("t.text").alias("text"), F.to_timestamp("t.createdAt").alias("created_at"), F.coalesce("t.isReply", F.lit(False)).alias("is_reply"), F.col("t.likeCount").alias("likes"), F.array_join(urls, ",").alias("media"))
    return rows, raw.agg(F.count_if(bad).alias("malformed"))


def read_posts(spark: SparkSession, path: str) -> DataFrame:
    """Posts under either name of each field; bodies capped; what lacks an id or a time is dropped."""
    p = spark.read.schema(POST_SCHEMA).json(path)
    out = p.select(F.coalesce("id", "name").alias("post_id"), "title", F.substring(F.coalesce("selftext", "body"), 1, BODY_CAP).alias("body"), "author", F.coalesce("score", "ups").alias("score"), F.coalesce("num_comments", F.lit(0)).alias("num_comments"), F.timestamp_seconds("created_utc").alias("created_at"))
    return out.where("post_id is not null and created_at is not null")


def without_deleted(comments: DataFrame) -> DataFrame:
    return comments.where(~F.coalesce("body", F.lit("")).isin("[deleted]", "[removed]"))


def read_communities(spark: SparkSession, path: str) -> DataFrame:
    c = spark.read.schema(COMMUNITY_SCHEMA).json(path)
    name = F.coalesce("display_name", "name")
    out = c.select(name.alias("name"), F.coalesce("subscribers", F.lit(0)).alias("subscribers"), collapse(F.coalesce("title", F.lit("")), 500).alias("title"), collapse(F.coalesce("public_description", F.lit("")), 500).alias("description"), F.coalesce("over18", "over_18", F.lit(False)).alias("over18"), F.coalesce("quarantine", F.lit(False)).alias("quarantined"))
    return out.where(F.col("name").rlike("^[A-Za-z0-9_]{3,21}$"))


def economic_series(raw: DataFrame) -> DataFrame:
    """Observations with a value; the source writes '.' for none."""
    return raw.where("value is not null and trim(value) not in ('', '.')").select("series_id", F.col("date").cast("date").alias("date"), F.expr("try_cast(value as double)").alias("value")).where("value is not null")


def valid_deals(raw: DataFrame, sectors: list[str]) -> DataFrame:
    """Deals with date, sector and summary; amounts that aren't numbers are null; unknown sectors stay, flagged."""
    d = raw.where("date is not null and trim(coalesce(sector, '')) != '' and trim(coalesce(summary, '')) != ''")
    sector = F.lower(F.trim("sector"))
    deal_id = F.substring(F.sha2(F.concat_ws("|", F.col("date").cast("string"), sector, "summary").cast("binary"), 256), 1, 16)
    return d.select(deal_id.alias("deal_id"), "date", sector.alias("sector"), F.lower("deal_type").alias("deal_type"), F.upper("ticker").alias("ticker"), "summary", F.expr("try_cast(amount as double)").alias("amount"), (~sector.isin(sectors)).alias("unknown_sector"))


def last_file_wins(spark: SparkSession, paths: str | list[str], schema: str, key: str) -> DataFrame:
    """Of all run files the row of the file whose name sorts last, per key."""
    rows = spark.read.schema(schema).json(paths).select("*", F.element_at(F.split("_metadata.file_path", "/"), -2).alias("run"))
    others = [c for c in rows.columns if c not in (key, "run")]
    return rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.max_by(F.struct(*others), "run").alias("r"), F.max("run").alias("run")).select(key, "r.*", "run")


def last_record(spark: SparkSession, path: str, schema: str, key: str, order: str) -> DataFrame:
    """JSON lines: bad lines and lines without a key are skipped, the last record of a key counts."""
    rows = spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path).where(F.col(key).isNotNull())
    others = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*others), order).alias("r")).select(key, "r.*")


CATALOG_SCHEMA = "name string, subscribers long, is_market int, signals string, relevance string"


def write_catalog(catalog: DataFrame, path: str) -> None:
    """CSV with flags as 0 and 1, lists joined by |, relevance with two places."""
    catalog.select("name", "subscribers", F.col("is_market").cast("int").alias("is_market"), F.array_join("signals", "|").alias("signals"), F.format_string("%.2f", "relevance").alias("relevance")).write.csv(path, header=True)


def read_catalog(spark: SparkSession, path: str) -> DataFrame:
    c = spark.read.schema(CATALOG_SCHEMA).csv(path, header=True)
    return c.select("name", "subscribers", (F.col("is_market") == 1).alias("is_market"), F.filter(F.split(F.coalesce("signals", F.lit("")), r"\|"), lambda s: s != "").alias("signals"), F.col("relevance").cast("double").alias("relevance"))


def stock_map(rows: DataFrame) -> DataFrame:
    """(ticker, names): each ticker's communities, the largest first."""
    listed = F.transform(F.array_sort(F.collect_list(F.struct((-F.col("subscribers")).alias("s"), "name"))), lambda x: x["name"])
    return rows.groupBy("ticker").agg(listed.alias("names"))


def overwrite_parts(df: DataFrame, path: str, part: str) -> None:
    """Write a table by the values of a column: only parts with rows in ``df`` are replaced."""
    # rebalanced: a part's rows come together, but a large part is split over several files
    df.hint("rebalance", part).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(part).parquet(path)
