"""Late-data jobs as Structured Streaming; each gives the rows of its batch twin once the input is read."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from chatterlake.operators.merges import first_wins
from chatterlake.sources import landed
from chatterlake.sources.daystore import DayTable

LATE = "3 days"
STATE_DAYS = 90
DAY_MICROS = 86_400_000_000
#: Groups of posts that the change log keeps a state for; a checkpoint holds to it.
STATE_GROUPS = 256
_LAST, NO_NUMBER = ["post", "score", "comments", "seen"], -(2**63)


def stream_table(spark: SparkSession, path: str, files: int = 1) -> DataFrame:
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def run_available(stream: DataFrame, name: str, mode: str = "append", path: str | None = None) -> DataFrame:
    """Run a stream over all that is there, into a table in the shared folder, and read that. A later run with the same ``path``
    goes on where this one ended: its state lies beside the table."""
    spark = stream.sparkSession
    path = path or landed.scratch(spark, name)
    q = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{path}-state").trigger(availableNow=True).format("parquet").start(path)
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


def daily_counts(posts: DataFrame, key: str, time: str) -> DataFrame:
    """Rows per key and day; a day closes three days after the newest row seen."""
    day = F.window(time, "1 day")
    posts = posts.withColumn(time, F.col(time).cast("timestamp"))
    return posts.withWatermark(time, LATE).groupBy(day.alias("w"), key).agg(F.count("*").alias("n")).select(key, F.to_date("w.start").alias("date"), "n")


def first_of_each(rows: DataFrame, key: str, time: str) -> DataFrame:
    """The first row of each key within the late allowance."""
    return rows.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, LATE).dropDuplicatesWithinWatermark([key])


class FirstWinsSink:
    """Micro-batches merged into a table by day: the first row of a key is stored, only ``seen`` moves on.

    A row keeps the number of the batch that stored it, and a ledger has a row for each batch that is done. So a batch that
    comes again changes nothing: if it was done it is passed over, and if it was lost between the merge and the ledger's
    row the merge gives the same rows and the same counts again."""

    def __init__(self, spark: SparkSession, path: str, schema: str, key: str, time: str, seen: str, order: str):
        self.spark, self.key, self.time, self.seen, self.order, self.ledger_path = spark, key, time, seen, order, f"{path}/ledger"
        self.rows = DayTable(spark, f"{path}/rows", f"{schema}, batch long")

    def ledger(self) -> DataFrame:
        """(batch, inserted, ignored) of the batches that are done."""
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.ledger_path)
        fs = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not fs.exists(path):
            return self.spark.createDataFrame([], "batch long, inserted long, ignored long")
        return self.spark.read.schema("inserted long, ignored long, batch long").parquet(self.ledger_path).select("batch", "inserted", "ignored")

    def merged(self, rows: DataFrame, batch: int) -> tuple[int, int]:
        """Merge a batch; returns how many of its rows' keys were new, and how many rows weren't."""
        rows = landed.saved(rows.withColumns({"batch": F.lit(batch).cast("long"), "day": F.to_date(self.time)}), "batch")
        _, written = self.rows.merge(rows, lambda old, new: first_wins(old, new.select(*old.columns), self.key, self.seen, self.order).drop("inserted"))
        inserted = written.where(F.col("batch") == batch).count()
        return inserted, rows.count() - inserted

    def __call__(self, rows: DataFrame, batch: int) -> None:
        if self.ledger().where(F.col("batch") == batch).count():
            return
        inserted, ignored = self.merged(rows, batch)
        done = self.spark.createDataFrame([(inserted, ignored)], "inserted long, ignored long")
        done.coalesce(1).write.mode("overwrite").parquet(f"{self.ledger_path}/batch={batch}")  # one row

    def run(self, stream: DataFrame, checkpoint: str) -> DataFrame:
        """Take in all that is there; a later run with the same checkpoint goes on."""
        stream.writeStream.foreachBatch(self).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
        return self.rows.read()


def change_log(sightings: DataFrame) -> DataFrame:
    """Sightings whose score or comment count differs from the post's last; a post not seen for 90 days is forgotten.
    Columns: post_id long, seen_at timestamp, event_id long, score long, num_comments long.

    Posts are dealt out by hash over STATE_GROUPS groups, and a group's rows of an arrival are compared at once. A group's state holds its
    posts' last counts and when they were seen. By that time they are too old, whether or not the watermark has come to remove them; the
    timeout only frees the state."""

    def changes(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = pd.DataFrame(np.frombuffer(bytes(state.get[0]), np.int64).reshape(-1, 4), columns=_LAST) if state.exists else None
        parts = [] if state.hasTimedOut else [b for b in batches if len(b)]
        if parts:
            rows = pd.concat(parts, ignore_index=True)
            rows = rows.sort_values(["seen_at", "event_id"], kind="stable", ignore_index=True)
            number = lambda c: rows[c].fillna(NO_NUMBER).astype("int64")
            new = pd.DataFrame({"post": number("post_id"), "score": number("score"), "comments": number("num_comments"), "seen": rows["seen_at"].astype("datetime64[us]").astype("int64")})
            both = pd.concat([last, new], keys=[0, 1]) if last is not None else pd.concat([new], keys=[1])
            both = both.sort_values("post", kind="stable")  # the state's row of a post comes first, then its sightings in order
            both["seen"] = both.groupby("post", sort=False)["seen"].cummax()
            v = both[_LAST].to_numpy(np.int64)
            changed = np.ones(len(v), bool)
            changed[1:] = (v[1:, :3] != v[:-1, :3]).any(axis=1) | (v[1:, 3] - v[:-1, 3] > STATE_DAYS * DAY_MICROS)
            found = both.index[changed & (both.index.get_level_values(0) == 1)].get_level_values(1)
            if len(found):
                yield rows.loc[np.sort(found), ["post_id", "seen_at", "event_id", "score", "num_comments"]]
            last = both.groupby("post", sort=False).tail(1)
        if last is not None:
            last = last[last["seen"] // 1000 + STATE_DAYS * DAY_MICROS // 1000 + 1 > state.getCurrentWatermarkMs()]
        if last is not None and len(last):
            state.update((last[_LAST].to_numpy(np.int64).tobytes(),))
            state.setTimeoutTimestamp(int(last["seen"].min()) // 1000 + STATE_DAYS * DAY_MICROS // 1000 + 1)
        elif state.exists:
            state.remove()

    rows = sightings.select("post_id", F.col("seen_at").cast("timestamp").alias("seen_at"), "event_id", "score", "num_comments", F.pmod(F.xxhash64("post_id"), F.lit(STATE_GROUPS)).alias("part"))
    rows = rows.withWatermark("seen_at", LATE).groupBy("part")
    out = "post_id long, seen_at timestamp, event_id long, score long, num_comments long"
    return rows.applyInPandasWithState(changes, out, "last binary", "append", GroupStateTimeout.EventTimeTimeout)
