"""Boards, screens and sector roll-ups: latest values of tickers brought to sectors, in a few shuffles for all keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chatterlake.functions.labels import colour_of_sign
from chatterlake.operators.signals import latest
from chatterlake.sources import landed


def newest(df: DataFrame, col: str = "date") -> DataFrame:
    """One row (as_of): the greatest date, for a broadcast in place of a wall clock."""
    return df.agg(F.max(col).alias("as_of"))


def with_as_of(df: DataFrame, as_of: DataFrame) -> DataFrame:
    return df.join(F.broadcast(as_of), F.lit(True))  # one row


def wide_matrix(signals: DataFrame, names: list[str], *more: Column) -> DataFrame:
    """Each ticker's signals at its latest date with any signal; a signal missing that day is null. ``more``: what else is to be told of all
    its rows in the same pass."""
    some = F.coalesce(*(F.when(F.col(n).isNotNull(), True) for n in names), F.lit(False))
    at = F.when(some, F.col("date"))  # numbers alone, no struct: such an aggregate is hashed
    return signals.groupBy("ticker").agg(F.max(at).alias("date"), *(F.max_by(n, at).alias(n) for n in names), *more).where("date is not null")


def ticker_board(universe: DataFrame, wide: DataFrame, bars: DataFrame) -> DataFrame:
    names = universe.groupBy("ticker").agg(F.concat_ws(", ", F.array_sort(F.collect_list("sector"))).alias("sectors"), F.bool_or("speculative").alias("speculative"))
    prices = bars.groupBy("ticker").agg(F.max_by("close", "date").alias("close"))
    flags = F.when(F.col("near_breakout") == 1, "breakout").when(F.col("near_breakdown") == 1, "breakdown").otherwise("")
    return names.join(wide, "ticker", "left").join(prices, "ticker", "left").withColumn("flags", flags)


def ticker_screen(universe: DataFrame, wide: DataFrame, sectors: list[str], speculative: bool) -> DataFrame:
    """Tickers in any of the sectors, speculative in any of theirs or not, by volume ratio, missing last."""
    marks = universe.groupBy("ticker").agg(F.bool_or(F.col("sector").isin(sectors)).alias("chosen"), F.bool_or("speculative").alias("spec"))
    rows = wide.join(marks.where(F.col("chosen") & (F.col("spec") == speculative)), "ticker", "left_semi").select("ticker", F.round("volume_ratio", 6).alias("volume_ratio"))
    return places(rows, [F.desc_nulls_last("volume_ratio"), F.col("ticker")])


def own_latest(name: str) -> Column:
    """A signal's value at the latest date that has one."""
    return F.max_by(name, F.when(F.col(name).isNotNull(), F.col("date")))


def sector_signal_means(signals: DataFrame, universe: DataFrame, names: list[str]) -> DataFrame:
    """Means over members of each signal's own latest row; members without it are skipped."""
    last = signals.groupBy("ticker").agg(*(own_latest(n).alias(n) for n in names))
    return universe.join(last, "ticker", "left").groupBy("sector").agg(*(F.avg(n).alias(n) for n in names))


def news_heat(news: DataFrame, universe: DataFrame) -> DataFrame:
    """News of the last 7 days against the pace of the last 30; null without news in 30."""
    daily = landed.saved(news.groupBy("ticker", "date").agg(F.count("*").alias("n")), "daily-news")  # one pass over the news
    d = with_as_of(daily, newest(daily))
    recent = lambda days: F.coalesce(F.sum(F.when(F.col("date") >= F.date_sub("as_of", days), F.col("n"))), F.lit(0))
    per_ticker = d.groupBy("ticker").agg(recent(7).alias("c7"), recent(30).alias("c30"))
    both = universe.join(per_ticker, "ticker", "left").groupBy("sector").agg(F.sum("c7").alias("c7"), F.sum("c30").alias("c30"))
    return both.select("sector", F.when(F.col("c30") > 0, F.col("c7") / (F.col("c30") / (30 / 7))).alias("news_heat"))


def sector_deals(deals: DataFrame) -> DataFrame:
    daily = landed.saved(deals.groupBy("sector", "date").agg(F.sum(F.col("amount").cast("decimal(18,2)")).alias("amount"), F.count("*").alias("n")), "daily-deals")  # one pass
    d = with_as_of(daily, newest(daily))
    recent = F.col("date") >= F.date_sub("as_of", 30)
    return d.groupBy("sector").agg(
        F.sum(F.when(recent, F.col("amount"))).cast("double").alias("deal_sum"),
        F.coalesce(F.sum(F.when(recent, F.col("n"))), F.lit(0)).alias("deal_count"),
        F.datediff(F.max("as_of"), F.max("date")).cast("long").alias("days_since"),
    )


def implied_flow(funds: DataFrame) -> DataFrame:
    """Change of assets that the price doesn't explain, against the previous stored date."""
    w = Window.partitionBy("etf").orderBy("date")
    aum, price = F.nullif(F.lag("aum").over(w), F.lit(0.0)), F.nullif(F.lag("price").over(w), F.lit(0.0))
    return funds.select("etf", "date", (F.col("aum") - aum - aum * (F.col("price") / price - 1)).alias("net_flow"))


def sector_flow_ratio(flows: DataFrame, etf_map: DataFrame) -> DataFrame:
    """Mean flow of 5 calendar days over that of 30, for funds with 15 flows or more; the sector takes its funds' mean."""
    flows = landed.saved(flows, "flows")
    f = with_as_of(flows, newest(flows))
    days = F.datediff("as_of", "date")
    short, long = F.when(days < 5, F.col("net_flow")), F.when(days < 30, F.col("net_flow"))
    per = f.groupBy("etf").agg(F.count(long).alias("n30"), F.count(short).alias("n5"), F.avg(long).alias("a30"), F.avg(short).alias("a5"))
    ratio = F.when((F.col("n30") >= 15) & (F.col("n5") >= 1), F.col("a5") / F.nullif(F.col("a30"), F.lit(0.0)))
    return etf_map.join(per.select("etf", ratio.alias("ratio")), "etf", "left").groupBy("sector").agg(F.avg("ratio").alias("flow_ratio"))


def as_of(rows: DataFrame, keys: list[str], as_of_row: DataFrame, days_back: int = 0) -> DataFrame:
    """The value on or before a date, the latest there is; a null there stays null."""
    before = with_as_of(rows, as_of_row).where(F.col("date") <= F.date_sub("as_of", days_back))
    return before.groupBy(keys).agg(F.max_by(F.struct("value"), "date")["value"].alias("value"))


def recent_bars(bars: DataFrame, as_of_row: DataFrame, days: int = 30, rows: int = 64) -> DataFrame:
    """The bars of each ticker from the start of the year on that leaves it ``rows`` or more of them up to the date ``days`` before: what
    signals of so many rows take at any later date. Counted by year first, so the history isn't sorted to be cut."""
    b = with_as_of(bars.select("ticker", "date"), as_of_row)
    years = b.groupBy("ticker", F.year("date").alias("year")).agg(F.count_if(F.col("date") <= F.date_sub("as_of", days)).alias("n"))
    back = Window.partitionBy("ticker").orderBy(F.desc("year")).rowsBetween(Window.unboundedPreceding, 0)  # a row a year
    enough = F.when(F.sum("n").over(back) >= rows, F.col("year"))
    starts = years.withColumn("enough", enough).groupBy("ticker").agg(F.coalesce(F.max("enough"), F.min("year")).alias("__start"))
    return bars.join(landed.small(landed.saved(starts, "starts")), "ticker").where(F.year("date") >= F.col("__start")).drop("__start")


def sector_signals(signals: DataFrame, universe: DataFrame, names: list[str], as_of_row: DataFrame) -> DataFrame:
    """Means of the members' latest signals, and mean range now less mean range 30 days ago over tickers that have both:
    one pass over the signals for all of it."""
    s = with_as_of(signals, as_of_row)
    value, date = F.col("atr_pct"), F.when(F.col("atr_pct").isNotNull() & (F.col("date") <= F.col("as_of")), F.col("date"))
    per = s.groupBy("ticker").agg(*(own_latest(n).alias(n) for n in names), F.max_by(value, date).alias("now"), F.max_by(value, F.when(date <= F.date_sub("as_of", 30), date)).alias("old"))
    both = F.col("now").isNotNull() & F.col("old").isNotNull()
    change = F.avg(F.when(both, F.col("now"))) - F.avg(F.when(both, F.col("old")))
    return universe.join(per, "ticker", "left").groupBy("sector").agg(F.count_distinct("ticker").alias("constituents"), *(F.avg(n).alias(n) for n in names), change.alias("volatility_change"))


def sector_heat(signals: DataFrame, universe: DataFrame, news: DataFrame, deals: DataFrame, flows: DataFrame, etf_map: DataFrame, as_of_row: DataFrame) -> DataFrame:
    out = sector_signals(signals, universe, ["return_1m", "above_sma50"], as_of_row)
    for part in (news_heat(news, universe), sector_deals(deals), sector_flow_ratio(flows, etf_map)):
        out = out.join(part, "sector", "left")
    return out.fillna(0, ["deal_count"])


def terciles(df: DataFrame, key: str, columns: dict[str, bool]) -> DataFrame:
    """Classes by the interpolated third and two thirds quantile; True: the lower the better. Below 3 values: none."""
    cuts = df.agg(*(F.percentile(c, F.array(F.lit(1 / 3), F.lit(2 / 3))).alias(f"q_{c}") for c in columns), *(F.count(c).alias(f"n_{c}") for c in columns))
    j = df.join(F.broadcast(cuts), F.lit(True))

    def classed(c: str, low_good: bool) -> Column:
        best, worst = ("red", "green") if low_good else ("green", "red")
        at = F.when(F.col(c) >= F.col(f"q_{c}")[1], best).when(F.col(c) >= F.col(f"q_{c}")[0], "yellow").otherwise(worst)
        return F.when((F.col(f"n_{c}") >= 3) & F.col(c).isNotNull(), at).alias(f"{c}_class")

    return j.select(key, *(classed(c, low) for c, low in columns.items()))


def places(rows: DataFrame, order: list[Column], name: str = "rank") -> DataFrame:
    """Adds each row's place in an order over all rows. The sort deals rows out by ranges; a place is the number of rows
    in the ranges before and the place within the range, so no task has all rows."""
    spark = rows.sparkSession
    path = landed.scratch(spark, "ranges")
    rows.orderBy(*order).withColumn("__part", F.spark_partition_id()).withColumn("__n", F.monotonically_increasing_id()).write.parquet(path)
    ranged = spark.read.parquet(path)
    sizes = ranged.groupBy("__part").agg(F.count("*").alias("size"), F.min("__n").alias("first"))  # a row a partition
    starts = sizes.select("__part", "first", (F.sum("size").over(Window.orderBy("__part")) - F.col("size")).alias("before"))
    return ranged.join(F.broadcast(starts), "__part").withColumn(name, (F.col("before") + F.col("__n") - F.col("first") + 1).cast("int")).select(*rows.columns, name)


def ranked_within(rows: DataFrame, keys: list[str], order: list[Column], name: str = "rank") -> DataFrame:
    """Adds each row's place within its key. Keys and order are sorted together by ranges, so a hot key is spread; the
    key's first place is taken off."""
    all_places = places(rows, [*map(F.col, keys), *order], "__place")
    firsts = all_places.groupBy(*keys).agg(F.min("__place").alias("__first"))
    return all_places.join(firsts, keys).withColumn(name, F.col("__place") - F.col("__first") + 1).drop("__place", "__first")


def sector_card(universe: DataFrame, wide: DataFrame) -> DataFrame:
    j = universe.join(wide, "ticker", "left")
    return j.groupBy("sector").agg(F.count("*").alias("members"), F.avg("return_5d").alias("return_5d"), F.avg(F.when(F.col("near_breakout") > 0, 1.0).otherwise(0.0)).alias("near_breakout"))


def constituents(universe: DataFrame, wide: DataFrame, news: DataFrame) -> DataFrame:
    recent = with_as_of(news, newest(news)).where(F.col("date") >= F.date_sub("as_of", 7)).groupBy("ticker").agg(F.count("*").alias("news_7d"))
    j = universe.join(wide, "ticker", "left").join(recent, "ticker", "left").withColumn("return_1m", F.round("return_1m", 6)).fillna(0, ["news_7d"])
    return ranked_within(j, ["sector"], [F.desc_nulls_last("return_1m"), F.col("ticker")])


def priority_list(universe: DataFrame, mentions: DataFrame, most: int) -> DataFrame:
    """Mentioned tickers by mentions, then the rest, cut at ``most`` (a report)."""
    rows = universe.select("ticker").distinct().join(mentions, "ticker", "left").orderBy(F.desc_nulls_last("mention_count"), "ticker").limit(most)
    rank = F.row_number().over(Window.orderBy(F.desc_nulls_last("mention_count"), "ticker"))
    return rows.select("ticker", F.coalesce("mention_count", F.lit(0)).alias("mentions"), rank.alias("rank"))


def ticker_detail(bars: DataFrame, wide: DataFrame, events: DataFrame, now: Column) -> DataFrame:
    """One row per ticker: place in the 52-week range, days to the next and since the last event, classes."""
    year = with_as_of(bars, newest(bars)).where(F.col("date") > F.date_sub("as_of", 365))
    y = year.groupBy("ticker").agg(F.max("high").alias("hi"), F.min("low").alias("lo"), F.max_by("close", "date").alias("close"))
    e = events.groupBy("ticker").agg(F.min(F.when(F.col("date") >= now, F.col("date"))).alias("next"), F.max(F.when(F.col("date") < now, F.col("date"))).alias("last"))
    j = y.join(e, "ticker", "left").join(wide.drop("date"), "ticker", "left")
    level = lambda c, hi, lo, incl: F.when(F.col(c) >= hi if incl else F.col(c) > hi, "high").when(F.col(c) < lo, "low").otherwise("mid")
    return j.withColumns({
        "range_position": F.least(F.lit(1.0), F.greatest(F.lit(0.0), (F.col("close") - F.col("lo")) / F.nullif(F.col("hi") - F.col("lo"), F.lit(0.0)))),
        "from_high": F.col("close") / F.nullif(F.col("hi"), F.lit(0.0)) - 1, "from_low": F.col("close") / F.nullif(F.col("lo"), F.lit(0.0)) - 1,
        "days_to_next": F.datediff("next", now).cast("long"), "days_since_last": F.datediff(now, "last").cast("long"),
        "rsi_class": level("rsi", 60, 30, True), "volume_class": level("volume_ratio", 1.5, 0.5, False),
    })


def target_position(rows: DataFrame) -> DataFrame:
    """``rows``: close, and low, mean and high of analysts' targets. Adds upside, the places of the mean and of the close in
    the range of targets in percent, held to 0 to 100, and the upside's class; null without a close above zero or a range."""
    span = F.when(F.col("high") > F.col("low"), F.col("high") - F.col("low"))
    place = lambda c: F.when(F.col(c).isNotNull() & span.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(100.0), (F.col(c) - F.col("low")) / span * 100)))
    upside = F.when(F.col("close") > 0, (F.col("mean") - F.col("close")) / F.col("close"))
    return rows.withColumns({"upside": upside, "mean_position": place("mean"), "current_position": place("close"), "upside_class": colour_of_sign(upside)})
