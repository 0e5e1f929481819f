"""Tables kept as folders by day: a batch reads and rewrites the days that it touches, retention drops whole days.

A table lies under ``path/day=.../``. What a job reads is named by days, so the scan lists those folders only; what it writes
replaces those folders by dynamic partition overwrite and leaves the files of all others as they are. All merges are
idempotent, so a job that was lost on the way is run again.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chatterlake.sources import landed


@dataclass
class DayTable:
    spark: SparkSession
    path: str
    #: Columns and types but ``day``, a date.
    schema: str

    def _folder(self, name: str = ""):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)
        return path, path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def days(self) -> list[date]:
        """The days stored, from the names of folders: nothing is read."""
        path, fs = self._folder()
        found = fs.listStatus(path) if fs.exists(path) else []
        names = [s.getPath().getName() for s in found]
        return sorted(date.fromisoformat(n.removeprefix("day=")) for n in names if n.startswith("day="))

    def read(self, days: Iterable[date] | None = None) -> DataFrame:
        """All rows, or those of some days: their folders alone are scanned."""
        stored = self.days()
        wanted = stored if days is None else sorted(set(days) & set(stored))
        if not wanted:
            return self.spark.createDataFrame([], f"{self.schema}, day date")
        rows = self.spark.read.schema(f"{self.schema}, day date").parquet(self.path)
        return rows if days is None else rows.where(F.col("day").isin(wanted))

    def replace(self, rows: DataFrame, days: Iterable[date]) -> DataFrame:
        """``rows`` become all that the days hold; days that have none left are dropped. Returns the rows as written."""
        rows = landed.saved(rows.select(*self.read([]).columns), "days")  # before the folders that they come from change
        landed.overwrite_parts(rows, self.path, "day")
        left = {r["day"] for r in rows.select("day").distinct().collect()}  # some of the days named
        self.drop(set(days) - left)
        return rows

    def merge(self, batch: DataFrame, with_stored: Callable[[DataFrame, DataFrame], DataFrame]) -> tuple[list[date], DataFrame]:
        """Merge a batch (with ``day``) into the days that it touches. Returns these and their rows as written."""
        days = [r["day"] for r in batch.select("day").distinct().collect()]  # a batch spans the days of a retention at most
        return days, self.replace(with_stored(self.read(days), batch), days)

    def drop(self, days: Iterable[date]) -> None:
        for d in days:
            path, fs = self._folder(f"day={d.isoformat()}")
            fs.delete(path, True)
