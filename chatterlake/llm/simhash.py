"""SimHash near-dedup: fingerprints, pigeonhole blocks, Hamming verification, components.

Defined results: null or wordless text has fingerprint 0; fewer words than a shingle give one shingle of all words;
equal texts share a fingerprint; a null id keeps its row but can't name a component; an empty table gives an empty
result; columns other than the id and the text are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chatterlake.llm.shared import connected_components, saved

SEED = 42


def words_of(text: str | None) -> list[bytes]:
    """UTF-8 words between ASCII white space, A-Z in lower case."""
    return text.encode("utf-8", "replace").lower().split() if text else []


def shingles_of(words: list[bytes], size: int) -> list[bytes]:
    if len(words) <= size:
        return [b" ".join(words)] if words else []
    return list(map(b" ".join, zip(*(words[i:] for i in range(size)), strict=False)))


def shingle_hashes(words: list[bytes], size: int) -> np.ndarray:
    from xxhash import xxh64_intdigest

    return np.array([xxh64_intdigest(s, SEED) for s in shingles_of(words, size)], dtype="<u8")


def majority_bits(hashes: np.ndarray) -> np.ndarray:
    """For hashes [n, 64-bit words]: the bits set in over half of the rows, packed again."""
    ones = np.zeros(hashes.shape[1] * 64, dtype=np.int64)
    for i in range(0, len(hashes), 8192):
        part = np.ascontiguousarray(hashes[i : i + 8192]).view(np.uint8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(ones * 2 > len(hashes), bitorder="little").view("<u8")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """(id, fingerprint long): bit i is 1 where it is in over half of the shingles' XXH64, repeats included."""

    # ids stay with Spark: in pandas a null among them would turn all to floats
    @F.pandas_udf("long")
    def fingerprint(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            out = np.zeros(len(texts), dtype="<u8")
            for i, text in enumerate(texts):
                h = shingle_hashes(words_of(text), shingle)
                if len(h):
                    out[i] = majority_bits(h[:, None])[0]
            yield pd.Series(out.view("<i8"))

    return docs.select(F.col(id_col).alias(id_col), fingerprint(F.col(text_col)).alias("fingerprint"))


def block_masks(blocks: int, bits_apart: int) -> list[int]:
    """Masks of all choices of blocks - bits_apart blocks: fingerprints so close agree wholly on one of them."""
    edges = [round(64 * i / blocks) for i in range(blocks + 1)]
    block = [((1 << edges[i + 1]) - (1 << edges[i])) for i in range(blocks)]
    masks = [sum(block[i] for i in kept) for kept in combinations(range(blocks), blocks - bits_apart)]
    return [m - (1 << 64) if m >= 1 << 63 else m for m in masks]


def bits_between(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def close_links(prints: DataFrame, bits_apart: int = 2, full_bucket: int = 64, blocks: int | None = None) -> DataFrame:
    """(a, b) links that connect all distinct ``fingerprint`` values at ``bits_apart`` (0 to 2) or fewer bits.

    Buckets are the fingerprints that agree on a choice of blocks. Those of up to ``full_bucket`` members are joined
    with themselves and each pair's distance is verified. Larger ones, where pairs would be too many, are linked by
    midpoints, which is as exact: two fingerprints at two bits or fewer have a common value at one bit or fewer
    from both, and all that share such a value are linked to the smallest of them; a value gathers 65 at most.
    """
    if bits_apart not in (0, 1, 2):
        raise ValueError("bits_apart must be 0, 1 or 2")
    if blocks is None:
        n = prints.count()
        blocks = 4 if n < 50_000_000 else 5 if n < 1_000_000_000 else 6
    masks = F.array(*(F.lit(m) for m in block_masks(blocks, bits_apart)))
    rows = prints.select("fingerprint", F.posexplode(masks).alias("choice", "mask")).select(
        "fingerprint", "choice", F.col("fingerprint").bitwiseAND(F.col("mask")).alias("key")
    )
    sizes = rows.groupBy("choice", "key").agg(F.count("*").alias("n")).where("n > 1")
    rows = saved(rows.join(sizes, ["choice", "key"]), "blocks")
    few, many = rows.where(F.col("n") <= full_bucket), rows.where(F.col("n") > full_bucket)
    a = few.select("choice", "key", F.col("fingerprint").alias("a"))
    b = few.select("choice", "key", F.col("fingerprint").alias("b"))
    pairs = a.join(b, (a.choice == b.choice) & (a.key == b.key) & (a.a > b.b) & (bits_between(F.col("a"), F.col("b")) <= bits_apart))
    flips = F.array(F.lit(0), *(F.lit(1 << i if i < 63 else -(1 << 63)) for i in range(64))) if bits_apart == 2 else F.array(F.lit(0))
    middle = many.select("fingerprint").distinct().select("fingerprint", F.explode(flips).alias("flip"))
    middle = middle.select("fingerprint", F.col("fingerprint").bitwiseXOR(F.col("flip")).alias("z"))
    if bits_apart == 1:  # the smaller of a pair is the value they share
        ones = F.array(*(F.lit(1 << i if i < 63 else -(1 << 63)) for i in range(64)))
        near = many.select("fingerprint").distinct().select("fingerprint", F.explode(ones).alias("flip"))
        middle = middle.union(near.select("fingerprint", F.col("fingerprint").bitwiseXOR(F.col("flip"))).where(F.col("fingerprint") > F.col("fingerprint").bitwiseXOR(F.col("flip"))))
    least = middle.groupBy("z").agg(F.min("fingerprint").alias("b"), F.count("*").alias("n")).where("n > 1")
    stars = middle.join(least, "z").where(F.col("fingerprint") != F.col("b"))
    stars = stars.where(bits_between(F.col("fingerprint"), F.col("b")) <= bits_apart)
    return pairs.select("a", "b").union(stars.select(F.col("fingerprint").alias("a"), "b")).distinct()


def near_duplicate_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, bits_apart: int = 2) -> DataFrame:
    """(id, fingerprint long, component_id): component_id is the smallest id reachable over links of close fingerprints."""
    each = saved(fingerprints(docs, id_col, text_col, shingle), "prints")
    firsts = saved(each.groupBy("fingerprint").agg(F.min(id_col).alias("first_id")), "firsts")
    parts = saved(connected_components(close_links(firsts, bits_apart)), "parts")
    named = firsts.join(parts.withColumnRenamed("node", "fingerprint"), "fingerprint")
    smallest = named.groupBy("root").agg(F.min("first_id").alias("component_id"))
    linked = named.join(smallest, "root").select("fingerprint", "component_id")
    names = saved(firsts.join(linked, "fingerprint", "left").select("fingerprint", F.coalesce("component_id", "first_id").alias("component_id")), "names")
    return each.join(names, "fingerprint").select(id_col, "fingerprint", "component_id")


# --- near duplicates by similarity of shingles: MinHash finds the candidates, the shingles decide ---

#: Words of 64 bits of the shingles' signature; keys, and the smallest shingle hashes that each takes. A key of two texts
#: agrees with a chance of their similarity to the power of SMALLEST_A_KEY: at 0.8 all keys fail for 3 pairs in a million.
SHINGLE_WORDS = 16
KEYS, SMALLEST_A_KEY = 32, 5
#: Signatures further apart than the bits of the similarity asked for, this many standard deviations, and so many bits
#: over the number of distinct words, are not compared: the bits of short texts vary by more.
DEVIATIONS, BITS_FOR_FEW_WORDS = 5, 600
#: Members of a bucket that are compared with each other in one place: larger buckets are cut into blocks of so many.
BLOCK_MEMBERS = 1000


def multipliers() -> np.ndarray:
    """An odd number for each smallest hash, from a fixed seed."""
    return np.random.default_rng(SEED).integers(0, 1 << 64, KEYS * SMALLEST_A_KEY, dtype="<u8") | np.uint64(1)


def shingle_keys(hashes: np.ndarray, factors: np.ndarray) -> np.ndarray:
    """KEYS longs, each from the smallest hashes under SMALLEST_A_KEY orders of the shingles."""
    least = np.full(len(factors), np.uint64(2**64 - 1))
    for i in range(0, len(hashes), 1024):
        x = hashes[i : i + 1024, None] * factors
        np.minimum(least, (x ^ (x >> np.uint64(32))).min(axis=0), out=least)
    keys = np.arange(1, KEYS + 1, dtype="<u8") * np.uint64(0x9E3779B97F4A7C15)
    for part in least.reshape(KEYS, SMALLEST_A_KEY).T:
        keys = (keys ^ part) * np.uint64(0xBF58476D1CE4E5B9)
        keys ^= keys >> np.uint64(29)
    return keys.view("<i8")


def spread_majority(hashes: np.ndarray, size: int) -> np.ndarray:
    """The majority bits over 64-bit hashes, each spread over ``size`` 64-bit words."""
    if not len(hashes):
        return np.zeros(size, dtype="<u8")
    x = hashes[:, None] + np.arange(1, size + 1, dtype="<u8") * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return majority_bits(x ^ (x >> np.uint64(31)))


def signatures(docs: DataFrame, id_col: str, text_col: str, shingle: int) -> DataFrame:
    """(node struct<id, text_key>, d1, d2: digest of the words, signature, keys). The signature holds
    the shingles' 16 longs and the number of distinct words."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from xxhash import xxh64_intdigest

        factors = multipliers()
        for pdf in batches:
            out = []
            for text in pdf["text"]:
                words = words_of(text)
                joined = b" ".join(words)
                digests = (np.array([xxh64_intdigest(joined, SEED), xxh64_intdigest(joined, SEED + 1)], dtype="<u8")).view("<i8")
                hashes = np.unique(shingle_hashes(words, shingle))
                grams = spread_majority(hashes, SHINGLE_WORDS)
                out.append((digests[0], digests[1], np.concatenate([grams.view("<i8"), [len(set(words))]]), shingle_keys(hashes, factors)))
            yield pd.concat([pdf[["id", "text_key"]], pd.DataFrame(out, columns=["d1", "d2", "signature", "keys"], index=pdf.index)], axis=1)

    rows = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("text_key"), F.col(text_col).alias("text"))
    each = rows.mapInPandas(run, f"id {kind}, text_key long, d1 long, d2 long, signature array<long>, keys array<long>")
    return each.select(F.struct("id", "text_key").alias("node"), "d1", "d2", "signature", "keys")


def similar_pairs(pairs: DataFrame, docs: DataFrame, id_col: str, text_col: str, shingle: int, similarity: float) -> DataFrame:
    """The pairs (a, b) of nodes whose sets of shingles have at least this Jaccard similarity: exact verification."""
    pairs = saved(pairs, "pairs")
    nodes = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            sets = [np.unique(shingle_hashes(words_of(t), shingle)).view("<i8") for t in pdf["text"]]
            yield pdf[["id", "text_key"]].assign(shingles=sets)

    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("text_key"), F.col(text_col).alias("text"))
    rows = rows.join(nodes.select("node.*"), ["id", "text_key"], "left_semi")
    sets = rows.mapInPandas(run, f"id {kind}, text_key long, shingles array<long>").select(F.struct("id", "text_key").alias("node"), "shingles")
    sets = saved(sets.groupBy("node").agg(F.first("shingles").alias("shingles")), "shingles")
    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa")), "a").join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb")), "b")
    shared = F.size(F.array_intersect("sa", "sb"))
    union = F.size("sa") + F.size("sb") - shared
    return both.where((union == 0) | (shared >= similarity * union - 1e-9)).select("a", "b")


def compared_in_blocks(members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Two sides of a join on (key, i, j) in which each two members of a key meet once: members are dealt out over blocks by a
    hash, and every two blocks, and every block with itself, are a place of their own. ``members``: key, n (of the key), node and others."""
    blocks = F.ceil(F.col("n") / BLOCK_MEMBERS).cast("int")
    dealt = members.withColumn("blocks", blocks).withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    others = [c for c in members.columns if c not in ("key", "n")]
    a = dealt.select("key", F.col("own").alias("i"), F.explode(F.sequence("own", F.col("blocks") - 1)).alias("j"), *(F.col(c).alias(f"{c}_a") for c in others))
    b = dealt.select("key", F.explode(F.sequence(F.lit(0), F.col("own"))).alias("i"), F.col("own").alias("j"), *(F.col(c).alias(f"{c}_b") for c in others))
    return a, b


def duplicate_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """(node, first) for every distinct (id, text): first is the smallest node of its group of near copies.

    Texts of equal words are one from the start. Keys are made of the shingles' smallest hashes (MinHash), so their
    chance of agreeing follows from the similarity alone, be a copy cut, extended or changed in places; the 32 keys miss
    3 pairs in a million at 0.8 and fewer above. In a first round each member of
    a key's bucket is compared with the member that most buckets agree on, which in a large group is the text that the
    others were made from; so large groups close without pairs among their members. The second round compares what
    still is in different groups, large buckets block by block in many places. Every link is verified on the shingles themselves.
    """
    each = saved(signatures(docs, id_col, text_col, shingle), "signatures")
    firsts = each.groupBy("d1", "d2").agg(F.min("node").alias("node"), F.first("signature").alias("signature"), F.first("keys").alias("keys"))
    firsts = saved(firsts, "firsts")
    keyed = firsts.select("node", F.explode("keys").alias("key"))
    sizes = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    rows = saved(keyed.join(sizes, "key"), "buckets")
    degree = rows.groupBy("node").agg(F.sum("n").alias("degree"))
    rows = saved(rows.join(degree, "node").join(firsts.select("node", "signature"), "node"), "members")
    pivots = rows.groupBy("key").agg(F.max(F.struct("degree", "node", "signature")).alias("pivot"))

    def close(a: str, b: str) -> Column:
        apart = lambda first, n: sum((bits_between(F.col(a)[i], F.col(b)[i]) for i in range(first, first + n)), F.lit(0))
        few = BITS_FOR_FEW_WORDS / F.greatest(F.least(F.col(a)[SHINGLE_WORDS], F.col(b)[SHINGLE_WORDS]), F.lit(1))
        return apart(0, SHINGLE_WORDS) <= most_grams_apart + few

    # a similarity of s is a cosine of 2s / (1 + s) at least, of a cut copy too
    share = math.acos(2 * similarity / (1 + similarity)) / math.pi
    most_grams_apart = 64 * SHINGLE_WORDS * share + DEVIATIONS * math.sqrt(64 * SHINGLE_WORDS * share * (1 - share))

    to_pivot = rows.join(pivots, "key").where((F.col("node") != F.col("pivot.node")) & close("signature", "pivot.signature"))
    links = similar_pairs(to_pivot.select(F.col("node").alias("a"), F.col("pivot.node").alias("b")).distinct(), docs, id_col, text_col, shingle, similarity)
    links = saved(links, "links-1")
    groups = connected_components(links)
    named = saved(rows.join(groups, "node", "left").select("key", "n", "node", "signature", F.coalesce("root", "node").alias("root")), "named")
    # buckets that have become one group have nothing left to compare
    split = named.groupBy("key").agg((F.min("root") < F.max("root")).alias("split")).where("split")
    named = named.join(split.select("key"), "key", "left_semi")
    a, b = compared_in_blocks(named)
    here = (a.key == b.key) & (a.i == b.i) & (a.j == b.j) & ((a.i < a.j) | (F.col("node_a") < F.col("node_b")))
    apart = a.join(b, here & (F.col("root_a") != F.col("root_b")) & close("signature_a", "signature_b"))
    apart = apart.select(F.least("node_a", "node_b").alias("a"), F.greatest("node_a", "node_b").alias("b")).distinct()
    more = similar_pairs(apart, docs, id_col, text_col, shingle, similarity)
    groups = saved(connected_components(links.union(more)), "groups")
    first_of = firsts.select("d1", "d2", "node").join(groups, "node", "left").select("d1", "d2", F.coalesce("root", "node").alias("first"))
    return each.select("node", "d1", "d2").join(first_of, ["d1", "d2"]).select("node", "first")


def without_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """One row of each group of near copies, the one of the smallest id, as it was; rows with a null id all stay."""
    groups = duplicate_groups(docs, id_col, text_col, shingle, similarity)
    first = groups.where(F.col("node") == F.col("first")).select(F.col("node.id").alias("__id"), F.col("node.text_key").alias("__text_key")).distinct()
    kept = docs.join(first, (F.col(id_col) == F.col("__id")) & (F.xxhash64(text_col) == F.col("__text_key")), "left_semi")
    order = Window.partitionBy(F.col(id_col), F.xxhash64(text_col)).orderBy(F.lit(0))  # rows equal in id and text
    kept = kept.withColumn("__copy", F.row_number().over(order)).where("__copy = 1").drop("__copy")
    return kept.unionByName(docs.where(F.col(id_col).isNull()))
