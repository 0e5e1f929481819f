"""Price, volume and mention signals for every bar, in one sort by ticker and date.

Offsets count stored rows, not calendar days. NULL means not enough history, or a zero denominator.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def by_ticker():
    return Window.partitionBy("ticker").orderBy("date")


def rows(first: int, last: int):
    return by_ticker().rowsBetween(first, last)


def full(n: int, value: Column) -> Column:
    """The value where the window of the last n rows is full."""
    return F.when(F.count(F.lit(1)).over(rows(1 - n, 0)) == n, value)


def change_over(col: str, n: int) -> Column:
    """(now - n rows ago) / n rows ago."""
    before = F.lag(col, n).over(by_ticker())
    return (F.col(col) - before) / F.nullif(before, F.lit(0.0))


def _doubled(b: DataFrame, sums: dict[str, int], most: dict[str, int]) -> DataFrame:
    """Adds x_2, x_4 and so on for each x, up to its length: the sums (null where one is) and the greatest values of so many last rows. Each is
    made of two halves, so the rows of a window aren't gone through again for every bar."""
    k = 1
    while any(2 * k <= n for n in (*sums.values(), *most.values())):
        part = lambda x, k=k: x if k == 1 else f"{x}_{k}"
        back = lambda x: F.lag(part(x), k).over(by_ticker())  # noqa: B023, E731
        b = b.withColumns({f"{x}_{2 * k}": F.col(part(x)) + back(x) for x, n in sums.items() if 2 * k <= n} | {f"{x}_{2 * k}": F.greatest(part(x), back(x)) for x, n in most.items() if 2 * k <= n})
        k *= 2
    return b


def _rsi(gain: Column, loss: Column) -> Column:
    """RSI of plain means over the last changes: no loss gives 100, flat too; no gain gives 0."""
    return F.when(gain.isNotNull() & loss.isNotNull(), F.when(loss == 0, 100.0).when(gain == 0, 0.0).otherwise(100 - 100 / (1 + gain / loss)))


def price_signals(bars: DataFrame) -> DataFrame:
    """(ticker, date, close, signals, return_ytd) for all bars (ticker, date, high, low, close, volume as a long)."""
    so_far = by_ticker().rowsBetween(Window.unboundedPreceding, 0)
    back = lambda c, n: F.lag(c, n).over(by_ticker())
    b = bars.select(
        "ticker", "date", "high", "low", "close", "volume", F.row_number().over(by_ticker()).alias("n"), back("close", 1).alias("last"), (F.col("volume") - back("volume", 1)).cast("double").alias("vchange"),
        change_over("close", 1).alias("return_1d"), change_over("close", 5).alias("return_5d"), change_over("close", 20).alias("return_20d"), change_over("close", 21).alias("return_1m"), change_over("close", 252).alias("return_1y"),
        _return_ytd().alias("return_ytd"), F.coalesce(F.sum("volume").over(so_far), F.lit(0)).alias("vsum"), F.count("volume").over(so_far).alias("vcount"), F.count("close").over(so_far).alias("ccount"),
    )
    last, change = F.col("last"), F.col("close") - F.col("last")
    side = lambda x: F.when(x.isNotNull(), F.greatest(x, F.lit(0.0)))
    b = b.withColumns({
        "up": side(change), "down": side(-change), "vup": side(F.col("vchange")), "vdown": side(-F.col("vchange")), "sum": F.coalesce("close", F.lit(0.0)), "top": F.col("close"), "floor": -F.col("close"),
        "swing": F.when(last.isNotNull(), F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - last), F.abs(F.col("low") - last))),
    })
    fourteen = ("up", "down", "vup", "vdown", "swing")
    b = _doubled(b, {**dict.fromkeys(fourteen, 8), "sum": 32}, {"top": 16, "floor": 16})
    prior = lambda c: F.coalesce(back(c, 1), F.lit(0)) - F.coalesce(back(c, 31), F.lit(0))
    b = b.withColumns({
        **{f"{x}_14": F.col(f"{x}_8") + back(f"{x}_4", 8) + back(f"{x}_2", 12) for x in fourteen}, "sum_50": F.col("sum_32") + back("sum_16", 32) + back("sum_2", 48),
        "top_30": F.greatest("top_16", back("top_16", 14)), "floor_30": F.greatest("floor_16", back("floor_16", 14)), "vsum_30": prior("vsum"), "vcount_30": prior("vcount"),
        "ccount_50": F.col("ccount") - F.coalesce(back("ccount", 50), F.lit(0)),
    })
    zero, close = F.lit(0.0), F.col("close")
    atr, sma50 = F.col("swing_14") / 14, F.when((F.col("n") >= 50) & (F.col("ccount_50") > 0), F.col("sum_50") / F.col("ccount_50"))
    b = b.withColumns({
        "volume_ratio": F.when(F.col("vcount_30") >= 10, F.col("volume") / F.nullif(F.col("vsum_30") / F.col("vcount_30"), zero)),
        "dist_high": F.when(F.col("n") >= 30, close / F.nullif(F.col("top_30"), zero) - 1), "dist_low": F.when(F.col("n") >= 30, close / F.nullif(-F.col("floor_30"), zero) - 1),
        "rsi": _rsi(F.col("up_14") / 14, F.col("down_14") / 14), "volume_rsi": _rsi(F.col("vup_14") / 14, F.col("vdown_14") / 14), "atr": atr, "atr_pct": atr / F.nullif(close, zero),
        "above_sma50": F.when(sma50.isNotNull(), (close > sma50).cast("double")),
    })
    b = b.withColumns({"near_breakout": (F.col("dist_high") > -0.02).cast("double"), "near_breakdown": (F.col("dist_low") < 0.02).cast("double")})
    return b.select("ticker", "date", "close", *SIGNALS, "return_ytd")


SIGNALS = (
    "return_1d return_5d return_20d return_1m return_1y volume_ratio dist_high dist_low rsi volume_rsi atr atr_pct above_sma50 near_breakout near_breakdown".split()
)


def _return_ytd() -> Column:
    """Against the first bar of the year, in the same order of rows as all other signals; null for a ticker without a bar
    in an earlier year."""
    so_far = by_ticker().rowsBetween(Window.unboundedPreceding, 0)
    opens = F.coalesce(F.year(F.lag("date").over(by_ticker())) < F.year("date"), F.lit(True))
    first = F.last(F.when(opens, F.col("close")), ignorenulls=True).over(so_far)
    started = F.first("date").over(so_far) < F.trunc("date", "year")
    return F.when(started, (F.col("close") - first) / F.nullif(first, F.lit(0.0)))


def ytd_return(bars: DataFrame) -> DataFrame:
    return bars.select("ticker", "date", _return_ytd().alias("return_ytd"))


def mention_velocity(mentions: DataFrame) -> DataFrame:
    """24-hour and 7-row velocity of total mention rows."""
    prior = rows(-7, -1)
    week = F.when(F.count(F.lit(1)).over(prior) == 7, F.col("mention_count") / F.nullif(F.avg("mention_count").over(prior), F.lit(0.0)))
    totals = mentions.where("subreddit = ''")
    return totals.select("ticker", "date", (F.col("mention_count") / F.nullif(F.col("mentions_24h_ago"), F.lit(0))).alias("velocity_24h"), week.alias("velocity_7d"))


def chart_lines(bars: DataFrame, n: int = 20, width: float = 2.0) -> DataFrame:
    """Moving average, Bollinger bands (sample deviation), and the mean volume of 30 prior bars, 1 at least."""
    mean = full(n, F.avg("close").over(rows(1 - n, 0)))
    spread = full(n, F.stddev_samp("close").over(rows(1 - n, 0))) * width
    volume = F.greatest(F.lit(1.0), F.avg("volume").over(rows(-30, -1)))
    return bars.select("ticker", "date", mean.alias("sma"), (mean + spread).alias("upper"), (mean - spread).alias("lower"), volume.alias("avg_volume_30d"))


def long_signals(bars: DataFrame) -> DataFrame:
    """(ticker, date, signal_name, value): every signal that has a value."""
    return price_signals(bars).drop("close").unpivot(["ticker", "date"], [*SIGNALS, "return_ytd"], "signal_name", "value").where("value is not null")


def latest_signals(bars: DataFrame) -> DataFrame:
    """(ticker, signal_name, date, value): each signal's newest value. Taken per ticker from the wide rows, so a row a signal is made of a
    ticker, not of a bar."""
    names = [*SIGNALS, "return_ytd"]
    at = {n: F.when(F.col(n).isNotNull(), F.col("date")) for n in names}
    last = price_signals(bars).groupBy("ticker").agg(*(F.max(at[n]).alias(f"{n}_date") for n in names), *(F.max_by(n, at[n]).alias(n) for n in names))
    each = F.array(*(F.struct(F.lit(n).alias("signal_name"), F.col(f"{n}_date").alias("date"), F.col(n).alias("value")) for n in names))
    return last.select("ticker", F.inline(each)).where("date is not null")


def latest(df: DataFrame, keys: list[str], order: str = "date") -> DataFrame:
    """The newest row of each key: an aggregate, which combines before the shuffle as a window doesn't."""
    others = [c for c in df.columns if c not in keys]
    return df.groupBy(keys).agg(F.max_by(F.struct(*others), order).alias("r")).select(*keys, "r.*")


def last_rows(df: DataFrame, keys: list[str], n: int, *order: Column) -> DataFrame:
    """The first n rows of each key in an order. Two steps: each salted part keeps its n, so no key meets whole."""
    salt = F.pmod(F.xxhash64(*df.columns), F.lit(32))
    w1 = Window.partitionBy(*keys, "__salt").orderBy(*order)
    w2 = Window.partitionBy(*keys).orderBy(*order)
    part = df.withColumn("__salt", salt).withColumn("__n", F.row_number().over(w1)).where(F.col("__n") <= n)
    return part.withColumn("rank", F.row_number().over(w2)).where(F.col("rank") <= n).drop("__salt", "__n")
