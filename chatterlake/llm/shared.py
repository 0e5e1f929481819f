"""What the operators share: saved tables in the cluster's shared folder, document keys, connected components."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Widest table, in rows, that an operator sends to every task; above it, the operator takes another way.
BROADCAST_ROWS = 200_000
FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``; where it is unset (local tests), a new temporary one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the application's own part of the shared folder, which can be removed when the application is done."""
    return f"{shared_folder(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def saved(df: DataFrame, name: str = "table") -> DataFrame:
    """Write a table to the shared folder and read it back: lineage ends there, and lost executors lose nothing."""
    path = scratch_path(df.sparkSession, name)
    # what a finished write has shuffled is of no more use: its files go at once, not when the driver happens to clean up
    conf = df.sparkSession.conf
    before = conf.get(FREE_SHUFFLES, None)
    conf.set(FREE_SHUFFLES, "true")
    try:
        df.write.parquet(path)
    finally:
        conf.set(FREE_SHUFFLES, before) if before is not None else conf.unset(FREE_SHUFFLES)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small(df: DataFrame) -> DataFrame:
    """Broadcast a saved table if its rows are few; else leave it to a shuffled join, whose hot keys Spark splits."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def held_out(id_col: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``, is 1. A null id isn't held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % modulus == 1, F.lit(False))


def fraction(*cols: Column) -> Column:
    """A reproducible number in [0, 1) from the values of columns."""
    return F.pmod(F.xxhash64(*cols), F.lit(1 << 53)) / F.lit(float(1 << 53))


def connected_components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root) for each node of undirected ``links`` (a, b); root is the smallest node reachable.

    Alternating large-star and small-star contraction: each round moves the neighbours of a node to the smallest of
    them, until every node hangs on its root. Each round is written to the shared folder, so lineage stays short.
    Loops and repeated links are harmless; empty links give an empty result.
    """
    a, b = F.col("a"), F.col("b")

    def tidy(df: DataFrame) -> DataFrame:
        return df.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).where(a != b).distinct()

    def mark(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0))).first())

    edges = saved(tidy(links), "links")
    before = mark(edges)
    for _ in range(most_rounds):
        if not before[0]:
            break
        both = edges.select("a", "b").union(edges.select(b.alias("a"), a.alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = tidy(both.join(least, "a").where(b > a).select(b.alias("a"), F.col("m").alias("b")))
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(b.alias("a"), F.col("m").alias("b"))
        edges = saved(tidy(small.union(low.select("a", F.col("m").alias("b")))), "links")
        after = mark(edges)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    roots = edges.select(b.alias("node"), b.alias("root")).distinct()
    return edges.select(a.alias("node"), b.alias("root")).union(roots)
