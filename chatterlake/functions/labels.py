"""Status classes and windows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def sign_class(x: Column) -> Column:
    return F.when(x > 0, "up").when(x < 0, "down").when(x == 0, "flat")


def volatility_arrow(x: Column) -> Column:
    return F.when(x > 0.002, "up").when(x < -0.002, "down").when(x.isNotNull(), "flat")


def setup_class(near_breakout: Column, near_breakdown: Column) -> Column:
    return F.when(near_breakout, "green").when(near_breakdown, "red").otherwise("gray")


def volume_class(ratio: Column) -> Column:
    return F.when(ratio > 1.5, "green").when(ratio < 0.5, "red").otherwise("gray")


def rsi_class(rsi: Column) -> Column:
    return F.when(rsi >= 60, "yellow").when(rsi < 30, "green").otherwise("gray")


def rsi_label(rsi: Column) -> Column:
    """Null without a value."""
    return F.when(rsi > 70, "Overbought").when(rsi >= 60, "Approaching overbought").when(rsi < 30, "Oversold").when(rsi.isNotNull(), "Neutral")


def short_class(share: Column) -> Column:
    return F.when(share > 0.15, "yellow").otherwise("gray")


def earnings_near(days: Column) -> Column:
    return F.when((days >= 0) & (days < 7), "yellow").otherwise("gray")


def colour_of_sign(x: Column) -> Column:
    return F.when(x > 0, "green").when(x < 0, "red").otherwise("gray")


def earnings_class(utc: Column) -> Column:
    """BMO before 9:30 and AMC from 16:00 on in New York, else null."""
    local = F.from_utc_timestamp(utc, "America/New_York")
    minute = F.hour(local) * 60 + F.minute(local)
    return F.when(minute < 570, "BMO").when(minute >= 960, "AMC")


def window_start(last_good: Column, now: Column, fixed_days: int | None = None) -> Column:
    """Where the next ingest begins: 3 days before the last good run, at most 14 back; 7 days on a first run."""
    back = lambda n: now - F.make_dt_interval(F.lit(n))
    if fixed_days is not None:
        return back(fixed_days)
    return F.when(last_good.isNull(), back(7)).otherwise(F.greatest(last_good - F.make_dt_interval(F.lit(3)), back(14)))
