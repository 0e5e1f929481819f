"""Work along the rows of a key in their order, where no task may have all rows of a key.

Rows are sorted by ranges of key and order together, so a key with most rows lies in many ranges. What a range needs from
the ones before is small: the last value, or two numbers that sum up a recursion. It is worked out from a row for each
range, and carried over the edge.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chatterlake.operators.rollups import ranked_within
from chatterlake.sources import landed

#: Rows of a key that are worked through together. Powers of the decay over a block stay far from the ends of doubles.
BLOCK = 256


def as_of_join(left: DataFrame, right: DataFrame, keys: list[str], time: str = "date", value: str = "value") -> DataFrame:
    """``left`` and, for each of its rows, the value of the key's latest ``right`` row on or before its time.

    A null value is a value: where the latest row has one, the result is null. Rows of ``left`` before any of ``right``
    get null too. ``right`` has one row for a key and time; rows of ``left`` may repeat."""
    others = [c for c in left.columns if c not in (*keys, time)]
    row = F.struct(*others) if others else F.struct(F.lit(1).alias("one"))
    a = left.select(*keys, time, F.lit(1).alias("__side"), row.alias("__row"))
    b = right.select(*keys, time, F.lit(0).alias("__side"), F.struct(value).alias("__value"))
    both = a.unionByName(b, allowMissingColumns=True)
    ranged = landed.saved(both.orderBy(*keys, time, "__side").withColumn("__part", F.spark_partition_id()), "ranges")
    along = Window.partitionBy("__part", *keys).orderBy(time, "__side").rowsBetween(Window.unboundedPreceding, 0)
    here = F.last("__value", ignorenulls=True).over(along)
    # the last value of a key in a range, for keys that lie in more than one
    ends = ranged.groupBy(*keys, "__part").agg(F.max_by("__value", F.when(F.col("__value").isNotNull(), F.col(time))).alias("__end"))
    before = Window.partitionBy(*keys).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    carried = ends.withColumn("__end", F.last("__end", ignorenulls=True).over(before)).where("__end is not null")
    carried = landed.small(landed.saved(carried, "carried"))
    found = ranged.withColumn("__here", here).where("__side = 1").join(carried, [*keys, "__part"], "left")
    return found.select(*keys, time, *(F.col(f"__row.{c}").alias(c) for c in others), F.coalesce("__here", "__end")[value].alias(value))


def then(first: Column, second: Column) -> Column:
    """Two maps x -> a x + b, one for each of two means that decay alike, made one: ``second`` after ``first``."""
    put = lambda c: (second["a"] * first[c] + second[c]).alias(c)
    return F.struct((first["a"] * second["a"]).alias("a"), put("up"), put("down"))


def states_before(blocks: DataFrame, key: str) -> DataFrame:
    """(key, block, up, down): what the maps of all blocks before give, from nought. ``blocks``: key, block from 0, map (a, up, down).

    Blocks are taken together, BLOCK at a time, until a key has one: so the maps are composed level by level."""
    zero = F.struct(F.lit(1.0).alias("a"), F.lit(0.0).alias("up"), F.lit(0.0).alias("down"))
    compose = lambda maps: F.aggregate(maps, zero, then)
    grouped = blocks.withColumn("group", F.floor(F.col("block") / BLOCK))
    before = Window.partitionBy(key, "group").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # BLOCK rows at most
    within = landed.saved(grouped.withColumn("before", compose(F.collect_list("map").over(before))), "maps")
    if (within.agg(F.max("group")).first()[0] or 0) == 0:
        return within.select(key, "block", "before.up", "before.down")
    whole = within.groupBy(key, "group").agg(F.max_by(F.struct("before", "map"), "block").alias("last"))
    above = states_before(whole.select(key, F.col("group").alias("block"), then(F.col("last.before"), F.col("last.map")).alias("map")), key)
    above = above.select(key, F.col("block").alias("group"), F.col("up").alias("__up"), F.col("down").alias("__down"))
    told = within.join(above, [key, "group"])
    put = lambda c: (F.col("before")["a"] * F.col(f"__{c}") + F.col("before")[c]).alias(c)
    return told.select(key, "block", put("up"), put("down"))


def wilder_rsi(bars: DataFrame, n: int = 14) -> DataFrame:
    """(ticker, date, wilder_rsi): recursive smoothing from the first change on; null for the first n rows and where all is flat.
    Rows with a null close are left out.

    A step of the smoothing is the map x -> (1 - 1/n) x + change / n; the first change counts whole. A block's steps are summed in closed
    form from nought, and what the blocks before have come to is added with its decay."""
    keep = 1.0 - 1.0 / n
    rows = bars.where("close is not null").select("ticker", "date", "close")
    placed = ranked_within(rows, ["ticker"], [F.col("date")], "place")
    placed = landed.saved(placed.withColumn("block", F.floor((F.col("place") - 1) / BLOCK)), "placed")
    along = Window.partitionBy("ticker", "block").orderBy("place")  # BLOCK rows at most
    ends = placed.groupBy("ticker", "block").agg(F.max_by("close", "place").alias("__last")).withColumn("block", F.col("block") + 1)
    before = F.coalesce(F.lag("close").over(along), "__last")
    moved = placed.join(ends, ["ticker", "block"], "left").withColumn("change", F.col("close") - before)
    at = (F.col("place") - 1) % BLOCK
    step = lambda x: F.when(F.col("place") == 2, x).when(F.col("place") > 2, x / n).otherwise(0.0)
    sums = lambda x: F.pow(F.lit(keep), at) * F.sum(step(F.greatest(x, F.lit(0.0))) * F.pow(F.lit(keep), -at)).over(along)
    change = F.coalesce("change", F.lit(0.0))
    s = landed.saved(moved.select("ticker", "date", "place", "block", at.alias("at"), sums(change).alias("up"), sums(-change).alias("down")), "smoothed")
    maps = s.groupBy("ticker", "block").agg(F.max_by(F.struct(F.pow(F.lit(keep), F.col("at") + 1).alias("a"), "up", "down"), "place").alias("map"))
    carried = states_before(maps, "ticker").select("ticker", "block", F.col("up").alias("__up"), F.col("down").alias("__down"))
    decay = F.pow(F.lit(keep), F.col("at") + 1)
    gain, loss = F.col("up") + decay * F.col("__up"), F.col("down") + decay * F.col("__down")
    rsi = F.when(loss != 0, 100 - 100 / (1 + gain / F.nullif(loss, F.lit(0.0)))).when(gain > 0, 100.0)
    return s.join(carried, ["ticker", "block"]).select("ticker", "date", F.when(F.col("place") > n, rsi).alias("wilder_rsi"))
