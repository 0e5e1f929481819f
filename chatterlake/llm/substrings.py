"""Substring dedup by fixed-block anchors: words of passages that stand earlier in the corpus go.

A window is ``window`` consecutive words of one document. It is a repeat if the same words also start earlier: in a
document of smaller id, or before it in its own. All words that a repeat covers are removed; judged is the input, not
what is left of it.

Every document is cut into non-overlapping reference blocks of half a window, so each window holds one whole block
wherever it starts. The blocks are the index; it is probed with the rolling windows of a block's length from every
place of every text. A block that meets the same words elsewhere is an anchor. The hits are then extended: every full window around an
anchor asks, by a hash of all its words, for its earliest place, and overlapping repeats are joined to the maximal
exact repeats, the ``spans`` of the result.

Documents are dealt out in chunks of about as many words each, by a hash of id and text. A chunk asks a bucket of the index for
its distinct hashes, packed, and the bucket answers the chunk; so a passage in a third of all documents is one hash a
chunk, and no pairs of places are made. Chunks grow with the root of the corpus, so that packets stay worth sending.
Anchors are told by 48 bits, which only costs needless questions; windows by 96.

Defined results: null and empty texts have no words; a row with a null id has no place in the order: it stays whole and
nothing is measured by it. Rows equal in id and text get the same result each; texts of one id are ordered by their hash. An
empty table gives an empty result; columns other than id and text are not read. Ids are whole numbers.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatterlake.llm.shared import saved, small

WINDOW = 20
#: Words of a chunk at least, and hashes that a chunk should have for each bucket at least.
CHUNK_WORDS, PACKET = 250_000, 100
CHARS_A_WORD = 6
#: Odd multipliers of the rolling hashes.
FIRST, SECOND = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
#: For hashes of words: a random number for each byte, an odd factor and its inverse modulo 2^64.
BYTE_NUMBERS = np.random.default_rng(20).integers(0, 1 << 64, 256, dtype="<u8")
WORD_FACTOR = np.uint64(0xA0761D6478BD642F)
WORD_FACTOR_INVERSE = np.uint64(pow(int(WORD_FACTOR), -1, 1 << 64))
#: Bytes that aren't the white space of ASCII.
IN_WORD = np.array([b not in b" \t\n\r\x0b\x0c" for b in range(256)])
ANCHOR_BYTES = 6
ANCHOR_MASK = np.uint64((1 << 8 * ANCHOR_BYTES) - 1)


def word_bounds(texts: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts one after another, where words begin and end in them, and each text's number of words."""
    whole = pc.fill_null(texts, "").cast(pa.large_string()).combine_chunks()
    _, offsets, data = whole.buffers()
    offsets = np.frombuffer(offsets, np.int64)[whole.offset : whole.offset + len(whole) + 1] if len(whole) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    offsets = offsets - offsets[0]
    inside = IN_WORD[raw]
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    edges = offsets[(offsets > 0) & (offsets < len(raw))]
    begins[edges], ends[edges - 1] = inside[edges], inside[edges - 1]  # words end with their text
    starts, stops = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return raw, starts, stops, np.diff(np.searchsorted(starts, offsets))


def word_count_and_hashes(texts: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """For each text its number of words, and a 64-bit hash of each word, all words one after another.

    A word's hash is a sum of random numbers for its bytes times powers of an odd number, taken from the sums over all bytes before its
    end and its start, then brought down to the power at its start."""
    raw, starts, stops, counts = word_bounds(texts)
    powers = np.full(len(raw) + 1, WORD_FACTOR)
    powers[:1] = 1
    powers = np.cumprod(powers)
    sums = np.zeros(len(raw) + 1, "<u8")
    np.cumsum(BYTE_NUMBERS[raw] * powers[:-1], out=sums[1:])
    back = np.full(len(raw) + 1, WORD_FACTOR_INVERSE)
    back[:1] = 1
    back = np.cumprod(back)
    return counts.astype(np.int64), mixed((sums[stops] - sums[starts]) * back[starts] + (stops - starts).astype("<u8"))


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def rolled(words: np.ndarray, size: int, factor: np.uint64) -> np.ndarray:
    """A hash of the ``size`` words from each place on."""
    n = max(0, len(words) - size + 1)
    out = np.zeros(n, dtype="<u8")
    for i in range(size):
        out = out * factor + words[i : i + n]
    return mixed(out)


@dataclass
class Chunk:
    """The words of some documents in the order of places. ``start``: the place of a word in its document; ``left``: the words from there to its end."""

    counts: np.ndarray
    words: np.ndarray
    start: np.ndarray
    left: np.ndarray

    @staticmethod
    def of(texts: pa.ChunkedArray) -> Chunk:
        counts, words = word_count_and_hashes(texts)
        ends = np.cumsum(counts)
        start = np.arange(len(words)) - np.repeat(ends - counts, counts)
        return Chunk(counts, words, start, np.repeat(counts, counts) - start)

    def anchors(self, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places that a block's length fits at, their hashes, and which of them begin a reference block."""
        at = np.flatnonzero(self.left >= size)
        return at, rolled(self.words, size, FIRST)[at], self.start[at] % size == 0

    def windows(self, at: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        return rolled(self.words, size, FIRST)[at], (rolled(self.words, size, SECOND)[at] >> np.uint64(32)).astype("<u4")


def bucket_edges(hashes: np.ndarray, buckets: int) -> list[tuple[int, int, int]]:
    """(bucket, from, to) of the parts of sorted hashes: buckets are ranges of their highest bits."""
    of = ((hashes >> np.uint64(40)) * np.uint64(buckets)) >> np.uint64(24)
    first = group_starts(of)
    return list(zip(of[first].tolist(), first.tolist(), [*first.tolist(), len(hashes)][1:], strict=True))


def distinct(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct values, and how often each occurs."""
    x = np.sort(x)
    first = group_starts(x)
    return x[first], np.diff(np.append(first, len(x)))


def held(x: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Which of x are among sorted values."""
    if not len(values):
        return np.zeros(len(x), bool)
    at = np.searchsorted(values, x)
    return values[np.minimum(at, len(values) - 1)] == x


def packed(hashes: np.ndarray) -> bytes:
    return np.ascontiguousarray(hashes.astype("<u8")).view(np.uint8).reshape(-1, 8)[:, :ANCHOR_BYTES].tobytes()


def unpacked(data: list[bytes]) -> np.ndarray:
    raw = np.frombuffer(b"".join(data), np.uint8).reshape(-1, ANCHOR_BYTES)
    out = np.zeros((len(raw), 8), np.uint8)
    out[:, :ANCHOR_BYTES] = raw
    return out.view("<u8").ravel()


def in_order(docs: pa.Table) -> pa.Table:
    return docs.sort_by([("id", "ascending"), ("text_key", "ascending")])


def group_starts(*sorted_columns: np.ndarray) -> np.ndarray:
    """Where groups of rows equal in all columns begin."""
    n = len(sorted_columns[0])
    new = np.zeros(n, bool)
    new[:1] = True
    for c in sorted_columns:
        new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


# --- anchors: chunks ask, buckets answer ---


def ask_anchors(size: int, buckets: int) -> Callable[[pa.Table], pa.Table]:
    def ask(docs: pa.Table) -> pa.Table:
        _, hashes, is_block = Chunk.of(docs["text"]).anchors(size)
        blocks, others = distinct(hashes[is_block])[0], distinct(hashes[~is_block])[0]
        others = others[~held(others, blocks)]
        rows: dict[int, list[bytes]] = {}
        for k, some in enumerate((blocks, others)):
            for b, i, j in bucket_edges(some, buckets):
                rows.setdefault(b, [b"", b""])[k] = packed(some[i:j])
        chunk = docs["chunk"][0].as_py()
        return pa.table({"bucket": pa.array(rows, pa.int64()), "chunk": pa.array([chunk] * len(rows), pa.int64()), "blocks": pa.array([v[0] for v in rows.values()], pa.binary()), "others": pa.array([v[1] for v in rows.values()], pa.binary())})

    return ask


def answer_anchors(asked: pa.Table) -> pa.Table:
    """For each chunk those of its hashes that are a reference block anywhere and are in another chunk too."""
    chunks = asked["chunk"].to_numpy()
    parts = [unpacked([x]) for c in ("blocks", "others") for x in asked[c].to_pylist()]
    values = np.concatenate(parts)
    owner = np.repeat(np.tile(np.arange(len(chunks)), 2), [len(p) for p in parts])
    is_block = np.arange(len(values)) < sum(len(p) for p in parts[: len(chunks)])
    order = np.argsort(values, kind="stable")
    values, owner, is_block = values[order], owner[order], is_block[order]
    first = group_starts(values)
    size = np.diff(np.append(first, len(values)))
    hit = np.repeat((size > 1) & np.logical_or.reduceat(is_block, first), size) if len(values) else is_block
    values, owner = values[hit], owner[hit]
    order = np.argsort(owner, kind="stable")
    cuts = np.searchsorted(owner[order], np.arange(len(chunks) + 1))
    found = [(int(c), packed(values[order[i:j]])) for c, i, j in zip(chunks, cuts, cuts[1:], strict=False) if j > i]
    return pa.table({"chunk": pa.array([c for c, _ in found], pa.int64()), "hits": pa.array([h for _, h in found], pa.binary())})


# --- extension: full windows around anchors ask for their earliest place ---


def ask_windows(window: int, buckets: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    size = (window + 1) // 2

    def ask(docs: pa.Table, answers: pa.Table) -> pa.Table:
        kinds = {"bucket": pa.int64(), "chunk": pa.int64(), "h1": pa.binary(), "h2": pa.binary(), "ids": pa.binary(), "keys": pa.binary(), "starts": pa.binary()}
        rows: list[tuple] = []
        if docs.num_rows:
            docs = in_order(docs)
            chunk = Chunk.of(docs["text"])
            at, hashes, is_block = chunk.anchors(size)
            own, n = distinct(hashes)
            own = own[n > 1]
            own = own[held(own, distinct(hashes[is_block])[0])]  # met within the chunk
            hits = distinct(np.concatenate([unpacked(answers["hits"].to_pylist()), own & ANCHOR_MASK]))[0]
            hit = np.zeros(len(chunk.words) + 1, np.int64)
            hit[at + 1] = held(hashes & ANCHOR_MASK, hits)
            hit = np.cumsum(hit)
            full = np.flatnonzero(chunk.left >= window)
            full = full[hit[full + size] > hit[full]]  # an anchor begins at one of the first places of the window
            h1, h2 = chunk.windows(full, window)
            order = np.lexsort((h2, h1))  # stable: within a group, in the order of places
            first = order[group_starts(h1[order], h2[order])] if len(order) else order
            doc = np.repeat(np.arange(len(chunk.counts)), chunk.counts)[full[first]]
            h1, h2, start = h1[first], h2[first], chunk.start[full[first]].astype("<i4")
            ids, keys = docs["id"].to_numpy()[doc].astype("<i8"), docs["tie"].to_numpy()[doc].astype("<i8")
            name = docs["chunk"][0].as_py()
            rows = [(b, name, *(x[i:j].tobytes() for x in (h1, h2, ids, keys, start))) for b, i, j in bucket_edges(h1, buckets)]
        return pa.table({c: pa.array([r[k] for r in rows], kind) for k, (c, kind) in enumerate(kinds.items())})

    return ask


def answer_windows(asked: pa.Table) -> pa.Table:
    """For each chunk those of its windows that another chunk has at an earlier place."""
    chunks = asked["chunk"].to_numpy()
    h1, h2, ids, keys, starts = (np.frombuffer(b"".join(asked[c].to_pylist()), kind) for c, kind in (("h1", "<u8"), ("h2", "<u4"), ("ids", "<i8"), ("keys", "<i8"), ("starts", "<i4")))
    owner = np.repeat(np.arange(len(chunks)), [len(x) // 8 for x in asked["h1"].to_pylist()])
    order = np.lexsort((h2, h1))
    h1, h2, owner, place = h1[order], h2[order], owner[order], [x[order].astype(np.int64) for x in (ids, keys, starts)]
    first = group_starts(h1, h2)
    size = np.diff(np.append(first, len(h1)))
    earliest = np.ones(len(h1), bool)
    for x in place:  # by id, then by the order of texts of one id, then by the start
        x = np.where(earliest, x, np.iinfo(np.int64).max)
        earliest &= x == np.repeat(np.minimum.reduceat(x, first), size)
    later = np.flatnonzero(~earliest)
    later = later[np.argsort(owner[later], kind="stable")]
    cuts = np.searchsorted(owner[later], np.arange(len(chunks) + 1))
    found = [(int(c), h1[later[i:j]].tobytes(), h2[later[i:j]].tobytes()) for c, i, j in zip(chunks, cuts, cuts[1:], strict=False) if j > i]
    return pa.table({"chunk": pa.array([r[0] for r in found], pa.int64()), "h1": pa.array([r[1] for r in found], pa.binary()), "h2": pa.array([r[2] for r in found], pa.binary())})


def among(h1: np.ndarray, h2: np.ndarray, of1: np.ndarray, of2: np.ndarray) -> np.ndarray:
    """Which pairs are among the pairs of another list."""
    order = np.lexsort((of2, of1))
    of1, of2 = of1[order], of2[order]
    at, found = np.searchsorted(of1, h1), np.zeros(len(h1), bool)
    open_ = np.arange(len(h1))
    while len(open_):  # one turn, but for pairs that share a first hash
        i = at[open_]
        open_ = open_[(i < len(of1)) & (of1[np.minimum(i, len(of1) - 1)] == h1[open_])] if len(of1) else open_[:0]
        same = of2[at[open_]] == h2[open_]
        found[open_[same]] = True
        open_ = open_[~same]
        at[open_] += 1
    return found


def kept_texts(docs: pa.Table, counts: np.ndarray, gone: np.ndarray) -> pa.Table:
    """``gone``: for all words one after another, whether they are removed."""
    ends = np.cumsum(counts)
    texts, spans, removed = [], [], []
    for text, i, j in zip(docs["text"].to_pylist(), ends - counts, ends, strict=True):
        words, mine = (text or "").encode().split(), gone[i:j]
        n = int(mine.sum())
        edges = np.flatnonzero(np.diff(np.concatenate([[0], mine.view(np.int8), [0]]))).tolist() if n else []
        texts.append((b" ".join(compress(words, (~mine).tolist())) if n else b" ".join(words)).decode())
        removed.append(n)
        spans.append([{"start": a, "end": b} for a, b in zip(edges[::2], edges[1::2], strict=True)])
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    return pa.table({"id": docs["id"], "copies": docs["copies"], "text": pa.array(texts, pa.large_string()).cast(pa.string()), "n_words": pa.array(counts, pa.int64()), "n_removed": pa.array(removed, pa.int64()), "spans": pa.array(spans, span)})


def remove(window: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def run(docs: pa.Table, answers: pa.Table) -> pa.Table:
        docs = in_order(docs)
        chunk = Chunk.of(docs["text"])
        full = np.flatnonzero(chunk.left >= window)
        h1, h2 = chunk.windows(full, window)
        repeat = among(h1, h2, *(np.frombuffer(b"".join(answers[c].to_pylist()), kind) for c, kind in (("h1", "<u8"), ("h2", "<u4"))))
        order = np.lexsort((h2, h1))
        own = np.ones(len(order), bool)  # all but the first in the chunk
        if len(order):
            own[order[group_starts(h1[order], h2[order])]] = False
        change = np.zeros(len(chunk.words) + 1, np.int64)
        change[full[repeat | own]] += 1  # places differ
        change[full[repeat | own] + window] -= 1
        return kept_texts(docs, chunk.counts, np.cumsum(change)[:-1] > 0)

    return run


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, chunk_words: int = CHUNK_WORDS) -> DataFrame:
    """(id, text: the kept words with one space between, n_words, n_removed, spans: removed words [start, end) by their numbers)."""
    kind = docs.schema[id_col].dataType.simpleString()
    if kind not in ("tinyint", "smallint", "int", "bigint"):
        raise TypeError(f"ids must be whole numbers, not {kind}")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("text_key"))
    own, no_id = rows.where("id is not null"), rows.where("id is null")
    known = saved(own.groupBy("id", "text_key").agg(F.count("*").alias("copies"), F.max(F.length("text")).alias("chars")), "texts")
    total = known.agg(F.sum("chars")).first()[0] or 0
    words = max(1, total // CHARS_A_WORD)
    parts = math.ceil(words / max(chunk_words, math.isqrt(PACKET * words)))
    # rows equal in id and text are one from here on, with their number; they are few or none
    often = saved(known.where("copies > 1").select(F.col("id").alias("__id"), F.col("text_key").alias("__key"), F.col("copies").alias("__copies")), "often")
    if often.limit(1).count():
        each = own.join(small(often), (F.col("id") == F.col("__id")) & (F.col("text_key") == F.col("__key")), "left")
        more = each.where("__copies is not null").groupBy("id", "text_key").agg(F.first("text").alias("text"), F.max("__copies").alias("copies"))
        own = each.where("__copies is null").select("id", "text", "text_key", F.lit(1).cast("long").alias("copies")).unionByName(more)
    else:
        own = own.withColumn("copies", F.lit(1).cast("long"))
    one_text = known.groupBy("id").count().where("count > 1").limit(1).count() == 0
    own = own.withColumn("tie", F.lit(0).cast("long") if one_text else F.col("text_key")).withColumn("chunk", F.pmod(F.xxhash64("id", "text_key"), F.lit(parts)))
    chunks = own.groupBy("chunk")

    asked = chunks.applyInArrow(ask_anchors((window + 1) // 2, parts), "bucket long, chunk long, blocks binary, others binary")
    hits = saved(asked.groupBy("bucket").applyInArrow(answer_anchors, "chunk long, hits binary"), "anchors")
    asked = chunks.cogroup(hits.groupBy("chunk")).applyInArrow(ask_windows(window, parts), "bucket long, chunk long, h1 binary, h2 binary, ids binary, keys binary, starts binary")
    later = saved(asked.groupBy("bucket").applyInArrow(answer_windows, "chunk long, h1 binary, h2 binary"), "repeats")
    result = "id long, copies long, text string, n_words long, n_removed long, spans array<struct<start: long, end: long>>"
    left = chunks.cogroup(later.groupBy("chunk")).applyInArrow(remove(window), result)

    def whole(batches):  # noqa: ANN001, ANN202
        for batch in batches:
            part = pa.Table.from_batches([batch])
            counts, hashes = word_count_and_hashes(part["text"])
            yield from kept_texts(part, counts, np.zeros(len(hashes), bool)).to_batches()

    left = left.unionByName(no_id.withColumn("copies", F.lit(1).cast("long")).mapInArrow(whole, result))
    each = left.withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
    return each.select(F.col("id").cast(kind).alias(id_col), "text", "n_words", "n_removed", "spans")
