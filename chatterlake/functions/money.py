"""Money ranges as text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The bands of disclosed amounts.
BANDS = ((1, 1_000), (1_001, 15_000), (15_001, 50_000), (50_001, 100_000), (100_001, 250_000), (250_001, 500_000), (500_001, 1_000_000), (1_000_001, 5_000_000), (5_000_001, 25_000_000), (25_000_001, 50_000_000))


#: Fixed value: what "over" the last band begins at.
OVER = 50_000_001.0


def amount_range(text: Column) -> tuple[Column, Column]:
    """(low, high) of a range as text: two numbers give both, "over $50,000,000" and one number give the low only."""
    numbers = F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"[\d,]+"), F.lit(0)), lambda x: F.translate(x, ",", "").try_cast("double"))
    numbers = F.array_compact(numbers)
    over = F.regexp_like(text, F.lit(r"(?i)over\s*\$50,000,000|50,000,001$"))
    return F.when(over, OVER).otherwise(F.get(numbers, 0)), F.when(~F.coalesce(over, F.lit(False)), F.get(numbers, 1))
