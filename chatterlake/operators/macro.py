"""Macro series: alignment of slow on fast calendars, ratios, z-scores, the composite reality score.

Series are (series_id, date, value); every function handles all series in one pass.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chatterlake.operators.rollups import with_as_of
from chatterlake.operators.signals import last_rows

#: Weight of each bucket, and the least score of each band.
WEIGHTS = {"market": 0.5, "economy": 0.5}
BANDS = (("severe_decoupling", 1.5), ("stretched", 0.5))


def quarter_ends(series: DataFrame) -> DataFrame:
    """The last value in each quarter, dated at the quarter's end."""
    end = F.last_day(F.add_months(F.trunc("date", "quarter"), 2))
    return series.groupBy("series_id", end.alias("quarter_end")).agg(F.max_by("value", "date").alias("value"))


def fill_forward(fast: DataFrame, slow: DataFrame) -> DataFrame:
    """(pair, date, fast, slow): the latest slow value on or before each fast date; fast dates before any are dropped.
    Both: pair, date, value; pairs of series are aligned side by side, each in its own window."""
    both = fast.select("pair", "date", F.col("value").alias("fast"), F.lit(None).cast("double").alias("s"), F.lit(1).alias("o"))
    both = both.union(slow.select("pair", "date", F.lit(None).cast("double"), F.col("value"), F.lit(0)))
    w = Window.partitionBy("pair").orderBy("date", "o").rowsBetween(Window.unboundedPreceding, 0)
    filled = both.withColumn("slow", F.last("s", ignorenulls=True).over(w))
    return filled.where("o = 1 and slow is not null").select("pair", "date", "fast", "slow")


def ratio(a: DataFrame, b: DataFrame) -> DataFrame:
    """a / b on the dates that both have."""
    j = a.select("date", F.col("value").alias("a")).join(b.select("date", F.col("value").alias("b")), "date")
    return j.select("date", (F.col("a") / F.nullif(F.col("b"), F.lit(0.0))).alias("ratio")).where("ratio is not null")


def basket_ratio(basket: DataFrame, index: DataFrame) -> DataFrame:
    """Mean of the members' values over the index, rebased to 1 at the first common date."""
    mean = basket.groupBy("date").agg(F.avg("value").alias("value"))
    r = ratio(mean, index)
    first = r.agg(F.min_by("ratio", "date").alias("first"))  # one row
    return r.join(F.broadcast(first), F.lit(True)).select("date", (F.col("ratio") / F.col("first")).alias("rebased"))


def period_change(series: DataFrame, n: int) -> DataFrame:
    before = F.lag("value", n).over(Window.partitionBy("series_id").orderBy("date"))
    return series.select("series_id", "date", ((F.col("value") / F.nullif(before, F.lit(0.0)) - 1) * 100).alias("change_pct"))


def real_stretch(prices: DataFrame, cpi: DataFrame, n: int = 120, least: int = 60) -> DataFrame:
    """(pair, date, stretch): prices in the latest price level over their mean of n rows, where ``least`` rows are there.
    ``prices``: pair, date, value; ``cpi``: date, value."""
    latest = cpi.agg(F.max_by("value", "date").alias("latest"))
    w = Window.partitionBy("pair").orderBy("date").rowsBetween(1 - n, 0)
    level = lambda df: df.select(F.lit("level").alias("pair"), "date", "value")
    calendar = fill_forward(level(prices.groupBy("date").agg(F.lit(0.0).alias("value"))), level(cpi)).select("date", "slow")  # the dates, once each
    real = prices.join(calendar, "date").join(F.broadcast(latest), F.lit(True)).select("pair", "date", (F.col("value") * F.col("latest") / F.col("slow")).alias("real"))
    return real.select("pair", "date", F.when(F.count("real").over(w) >= least, F.col("real") / F.avg("real").over(w)).alias("stretch"))


def latest_z(series: DataFrame, days: int = 365 * 5, least: int = 12) -> DataFrame:
    """z of each series' newest value over the trailing days, or over all its history if that is too short."""
    last = series.groupBy("series_id").agg(F.max("date").alias("last"), F.max_by("value", "date").alias("value"))
    j = series.select("series_id", "date", F.col("value").alias("v")).join(last, "series_id")
    recent = F.when(F.col("date") >= F.date_sub("last", days), F.col("v"))
    g = j.groupBy("series_id").agg(
        F.first("value").alias("value"), F.count(recent).alias("n"), F.avg(recent).alias("m1"), F.stddev_samp(recent).alias("s1"), F.avg("v").alias("m2"), F.stddev_samp("v").alias("s2")
    )
    mean, spread = F.when(F.col("n") >= least, F.col("m1")).otherwise(F.col("m2")), F.when(F.col("n") >= least, F.col("s1")).otherwise(F.col("s2"))
    return g.select("series_id", "value", ((F.col("value") - mean) / F.nullif(F.when(F.isnan(spread), None).otherwise(spread), F.lit(0.0))).alias("z_score"))


def sparkline(series: DataFrame, n: int = 60) -> DataFrame:
    """The last n points of each series as a map from date to value."""
    rows = last_rows(series.select("series_id", "date", "value"), ["series_id"], n, F.desc("date"))
    return rows.groupBy("series_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col("date").cast("string"), "value")))).alias("history"))


def reality_score(indicators: DataFrame, config: DataFrame) -> DataFrame:
    """One row. ``indicators``: series_id, z_score; ``config``: series_id, bucket, sign. Context and missing z are skipped."""
    j = indicators.join(config, "series_id", "left").withColumn("bucket", F.coalesce("bucket", F.lit("context")))
    used = F.col("bucket").isin(*WEIGHTS) & F.col("z_score").isNotNull()
    z = F.when(used, F.coalesce("sign", F.lit(1)) * F.col("z_score"))
    g = j.agg(
        F.avg(F.when(F.col("bucket") == "market", z)).alias("m"),
        F.avg(F.when(F.col("bucket") == "economy", z)).alias("e"),
        F.array_sort(F.collect_list(F.when(used, F.col("series_id")))).alias("used_indicators"),
        F.array_sort(F.collect_list(F.when(~used, F.col("series_id")))).alias("skipped_indicators"),
    )
    both = WEIGHTS["market"] * F.col("m") + WEIGHTS["economy"] * F.col("e")
    score = F.coalesce(both, F.col("m"), F.col("e"), F.lit(0.0))
    band = F.lit("market_discounting_weakness")
    band = F.when(score >= BANDS[0][1], BANDS[0][0]).when(score >= BANDS[1][1], BANDS[1][0]).when(score > -0.5, "aligned").otherwise(band)
    return g.select(F.round(score, 3).alias("score"), band.alias("band"), F.round("m", 3).alias("market_z"), F.round("e", 3).alias("economy_z"), "used_indicators", "skipped_indicators")


def since(df: DataFrame, as_of_row: DataFrame, days: int) -> DataFrame:
    """Rows of the trailing days, inclusive, up to as_of."""
    return with_as_of(df, as_of_row).where(F.col("date").between(F.date_sub("as_of", days), F.col("as_of"))).drop("as_of")


def option_summary(chain: DataFrame) -> DataFrame:
    """Open interest and volume by side, with the put / call ratio of open interest."""
    g = chain.groupBy("ticker").agg(*(F.sum(F.when(F.col("side") == s, F.col(c))).alias(f"{s}_{c}") for s in ("call", "put") for c in ("open_interest", "volume")))
    r: Column = F.col("put_open_interest") / F.nullif(F.col("call_open_interest"), F.lit(0))
    return g.withColumn("put_call_ratio", r)
