"""Benchmark decontamination: size-partitioned MinHash containment search, verified by exact shingle containment.

A short item inside a long document has a Jaccard similarity near zero, so the sketches are made for containment.
Items are partitioned by their number of distinct shingles, a power of two a partition. An item's sketch is MinHash in
its bottom-k form, the k smallest shingle hashes, with k one more than the shingles that a document may lack (for 0.8: a
fifth), so every document that contains the item holds at least one of the k: the search misses nothing. That costs
sketches as long as a fifth of all items; signatures of a fixed length would be shorter and lose items. A partition's threshold is the
largest hash in its sketches; a document's sketch for it is all its hashes up to there, and documents too short for
the partition skip it. What shares a sketch value is verified with all shingles.

Words are runs of letters and digits in lower case. Defined results: items with null text or fewer words than a
shingle are never found (they'd match by chance); null, empty and short documents contain nothing; repeated rows each
give their own result; a null id is kept; empty tables give no pairs. Other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chatterlake.llm.shared import saved
from chatterlake.llm.simhash import SEED

WORDS = re.compile(r"[^\W_]+")
#: Shingles of the items that may go to every task (8 bytes each, twice); above this, items and documents are joined.
BROADCAST_SHINGLES = 4_000_000


def distinct_shingles(text: str | None, size: int) -> np.ndarray:
    from xxhash import xxh64_intdigest

    words = WORDS.findall(text.lower()) if text else []
    grams = map(" ".join, zip(*(words[i:] for i in range(size)), strict=False))  # none for fewer words
    return np.unique(np.fromiter((xxh64_intdigest(g, SEED) for g in grams), dtype="<u8"))


@dataclass
class Partition:
    """Items of similar size: sketch values in order, each with the item it is of; the least document size."""

    values: np.ndarray
    items: np.ndarray
    least: int


@dataclass
class ItemIndex:
    ids: list
    shingles: list[np.ndarray]
    share: float
    partitions: list[Partition] = field(default_factory=list)

    def __post_init__(self) -> None:
        by: dict[int, list[int]] = {}
        for i, s in enumerate(self.shingles):
            by.setdefault(len(s).bit_length(), []).append(i)
        for members in by.values():
            sketches = [np.sort(self.shingles[i])[: len(self.shingles[i]) - self.needed(i) + 1] for i in members]
            values = np.concatenate(sketches)
            owners = np.repeat(members, [len(s) for s in sketches])
            order = np.argsort(values, kind="stable")
            self.partitions.append(Partition(values[order], owners[order], min(map(self.needed, members))))

    def needed(self, i: int) -> int:
        """The least number of an item's shingles that reach the share."""
        return max(1, int(np.ceil(self.share * len(self.shingles[i]) - 1e-9)))

    def search(self, doc: np.ndarray) -> list[tuple[int, int]]:
        """(item, shared shingles) for the items that a document of sorted distinct hashes contains."""
        found = []
        for p in self.partitions:
            if len(doc) < p.least:
                continue
            sketch = doc[: np.searchsorted(doc, p.values[-1], side="right")]
            first = np.searchsorted(p.values, sketch)
            met = p.values[first] == sketch
            if not met.any():  # most documents share nothing
                continue
            last = np.searchsorted(p.values, sketch[met], side="right")  # the runs of the values met, and no others
            for i in np.unique(np.concatenate([p.items[a:b] for a, b in zip(first[met], last, strict=True)])):
                shared = int(np.isin(self.shingles[i], doc, assume_unique=True).sum())
                if shared >= self.needed(i):
                    found.append((int(i), shared))
        return found


def item_index(items: DataFrame, id_col: str, text_col: str, shingle: int, share: float) -> ItemIndex | None:
    """All items as one index, if their shingles surely are within BROADCAST_SHINGLES; else None."""
    rows = items.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where(F.col("text").isNotNull())
    most = rows.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0] // 2  # a word takes two characters at least
    if most > BROADCAST_SHINGLES:
        return None
    part = [(r["id"], distinct_shingles(r["text"], shingle)) for r in rows.collect()]
    part = [x for x in part if len(x[1])]
    return ItemIndex([x[0] for x in part], [x[1] for x in part], share)


def shingle_arrays(text: Column, shingle: int) -> Column:
    """The distinct shingle hashes of a text in unsigned order, shifted to signed longs that keep this order."""

    @F.pandas_udf("array<long>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([(distinct_shingles(t, shingle) ^ np.uint64(1 << 63)).view("<i8") for t in texts], dtype=object)

    return run(text)


def contained_by_join(docs: DataFrame, items: DataFrame, id_col: str, text_col: str, item_id_col: str, item_text_col: str, shingle: int, share: float) -> DataFrame:
    """(id, text_key, item, n_shared, n_shingles) for any number of items: sketch values and the documents' hashes up to
    their partition's largest meet in a shuffled join, whose hot values Spark splits; pairs are verified on all shingles."""
    each = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("text_key"), shingle_arrays(F.col(text_col), shingle).alias("held"))
    each = saved(each.where(F.size("held") > 0).withColumn("row", F.monotonically_increasing_id()), "document-shingles")
    wanted = items.select(F.col(item_id_col).alias("item"), shingle_arrays(F.col(item_text_col), shingle).alias("shingles")).where(F.size("shingles") > 0)
    n = F.size("shingles")
    needed = F.greatest(F.lit(1), F.ceil(share * n - 1e-9)).cast("int")
    wanted = wanted.select("*", needed.alias("needed"), F.floor(F.log2(n)).cast("int").alias("part"), F.slice("shingles", F.lit(1), n - needed + 1).alias("sketch"))
    wanted = saved(wanted.withColumn("item_row", F.monotonically_increasing_id()), "item-shingles")
    parts = wanted.groupBy("part").agg(F.max(F.element_at("sketch", -1)).alias("top"), F.min("needed").alias("least")).collect()  # 32 rows at most
    tops = [F.when(F.size("held") >= p["least"], F.lit(p["top"])) for p in parts]
    top = F.greatest(*tops, F.lit(None).cast("long"), F.lit(None).cast("long"))
    values = each.select("row", F.explode(F.filter("held", lambda h: h <= top)).alias("value"))
    sketches = wanted.select("item_row", F.explode("sketch").alias("value"))
    pairs = values.join(sketches, "value").select("row", "item_row").distinct()
    shared = F.size(F.array_intersect("held", "shingles"))
    found = pairs.join(each, "row").join(wanted, "item_row").select("id", "text_key", "item", shared.cast("long").alias("n_shared"), n.cast("long").alias("n_shingles"), "needed")
    return found.where("n_shared >= needed").drop("needed")


def contained_items(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", shingle: int = 5, share: float = 0.8) -> DataFrame:
    """(id, item id, n_shared, n_shingles, containment): documents that hold ``share`` or more of an item's shingles."""
    index = item_index(items, item_id_col, item_text_col, shingle, share)
    if index is None:
        found = contained_by_join(docs, items, id_col, text_col, item_id_col, item_text_col, shingle, share).select("id", "item", "n_shared", "n_shingles")
    else:
        held = docs.sparkSession.sparkContext.broadcast(index)

        # ids stay with Spark: in pandas a null among them would turn all to floats
        @F.pandas_udf(f"array<struct<item:{items.schema[item_id_col].dataType.simpleString()},n_shared:bigint,n_shingles:bigint>>")
        def search(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            x = held.value
            for texts in batches:
                yield pd.Series([[(x.ids[k], shared, len(x.shingles[k])) for k, shared in x.search(distinct_shingles(t, shingle))] for t in texts], dtype=object)

        found = docs.select(F.col(id_col).alias("id"), F.explode(search(F.col(text_col))).alias("found")).select("id", "found.*")
    found = found.withColumn("containment", F.col("n_shared") / F.col("n_shingles"))
    return found.withColumnsRenamed({"id": id_col, "item": item_id_col})


def without_contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", shingle: int = 5, share: float = 0.8) -> DataFrame:
    """The rows of ``docs`` that contain no item, as they were."""
    index = item_index(items, item_id_col, item_text_col, shingle, share)
    if index is None:
        found = contained_by_join(docs, items, id_col, text_col, item_id_col, item_text_col, shingle, share)
        found = found.select(F.col("id").alias("__id"), F.col("text_key").alias("__text_key")).distinct()
        return docs.join(found, F.col(id_col).eqNullSafe(F.col("__id")) & (F.xxhash64(text_col) == F.col("__text_key")), "left_anti")
    held = docs.sparkSession.sparkContext.broadcast(index)

    @F.pandas_udf("boolean")
    def search(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([bool(held.value.search(distinct_shingles(t, shingle))) for t in texts], dtype=bool)

    return docs.where(~search(F.col(text_col)))
