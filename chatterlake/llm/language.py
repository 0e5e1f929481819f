"""Language identification by compression: the language whose dictionary packs a text smallest.

Each language has a raw-content zstandard dictionary of sample text. A whole text is cut into blocks, every block is
compressed with each dictionary on its own, and the language with the smallest total wins. The margin to the second
tells whether to trust it.

Defined results: null text or text without a letter is ``und`` with score 0 and rejected; equal totals go to the
language that sorts first, with score 0; without labelled rows every text is ``und``; a language whose labelled texts hold less than
eight bytes of letters, too few for a dictionary, is not learned; rows are never joined, so
repeated ids and extra columns are harmless; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chatterlake.llm.shared import fraction

UNKNOWN = "und"
NO_LETTERS, LETTER = regex.compile(r"[^\p{L}\p{M}]+"), regex.compile(r"\p{L}")
BLOCK_BYTES = 2048
LEVEL = 3
#: Characters of the pieces of which dictionaries are sampled: most texts are one piece.
SAMPLE_CHARS = 4096
#: Bytes of the dictionary's start put before a block: few bytes alone would be stored as they are, whatever they match.
CARRIER_BYTES = 96
#: Below this margin, as a share of the second size, the two best languages can't be told apart.
NARROW = 0.004


@dataclass(frozen=True)
class LanguageModel:
    """Languages in order, and for each the content of its dictionary."""

    languages: tuple[str, ...]
    contents: tuple[bytes, ...]


def plain(text: str) -> bytes:
    """What is compressed: lower case, runs of anything but letters and their marks as one space; nothing without a letter."""
    spaced = NO_LETTERS.sub(" ", text.lower()).strip()
    return spaced.encode("utf-8", "replace") if LETTER.search(spaced) else b""


def learn_languages(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", budget_bytes: int = 160_000) -> LanguageModel:
    """Dictionaries from labelled rows: for each language pieces of texts, picked by a hash of the piece up to ``budget_bytes``.

    The sample is bounded: it takes about twice the budget a language to the driver. Equal pieces count once, in the
    rate and in the sample, so neither a large group of copies nor a long text can fill a dictionary or leave it empty.
    """
    rows = docs.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).where(
        F.col("lang").isNotNull() & (F.col("lang") != UNKNOWN) & F.col("text").rlike(r"\p{L}")
    )
    places = F.sequence(F.lit(0), F.floor((F.length("text") - 1) / SAMPLE_CHARS).cast("int"))
    pieces = F.transform(places, lambda i: F.substring(F.col("text"), i * SAMPLE_CHARS + 1, F.lit(SAMPLE_CHARS)))
    rows = rows.select("lang", F.explode(pieces).alias("text"))
    each = rows.select("lang", F.xxhash64("text").alias("key"), F.octet_length("text").alias("bytes")).distinct()
    sizes = each.groupBy("lang").agg(F.sum("bytes").alias("bytes")).select("lang", (2.0 * budget_bytes / F.col("bytes")).alias("rate"))
    rates = {r["lang"]: min(1.0, r["rate"]) for r in sizes.collect()}
    if not rates:
        return LanguageModel((), ())
    rate = F.element_at(F.create_map(*(F.lit(x) for kv in rates.items() for x in kv)), F.col("lang"))
    order = fraction(F.col("text"))
    sample = rows.where(order < rate).select("lang", order.alias("order"), "text").distinct()
    by: dict[str, list] = {lang: [] for lang in rates}
    for r in sample.collect():
        by[r["lang"]].append((r["order"], r["text"]))
    contents = {lang: b" ".join(plain(text) for _, text in sorted(texts))[:budget_bytes] for lang, texts in by.items()}
    languages = tuple(sorted(k for k, v in contents.items() if len(v) >= 8))  # shorter content is no dictionary
    return LanguageModel(languages, tuple(contents[k] for k in languages))


def identify(docs: DataFrame, model: LanguageModel, text_col: str = "text", narrow: float = NARROW) -> Column:
    """A struct column: lang_pred, score (1 - best / second size), rejected (no letter, or a margin below ``narrow``)."""
    context = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double, rejected boolean")
    def classify(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        import zstandard

        m = context.value

        def sizer(content: bytes) -> Callable[[bytes], int]:
            held = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            held.precompute_compress(level=LEVEL)
            pack = zstandard.ZstdCompressor(dict_data=held, write_content_size=False, write_checksum=False, write_dict_id=False).compress
            carrier = content[:CARRIER_BYTES] + b" "
            alone = len(pack(carrier))
            return lambda block: len(pack(carrier + block)) - alone

        sizers = [sizer(c) for c in m.contents]
        for texts in batches:
            out = []
            for text in texts:
                data = plain(text) if text else b""
                if not data or not sizers:
                    out.append((UNKNOWN, 0.0, True))
                    continue
                blocks = [data[i : i + BLOCK_BYTES] for i in range(0, len(data), BLOCK_BYTES)]
                totals = [max(1, sum(map(size, blocks))) for size in sizers]
                best = min(range(len(totals)), key=totals.__getitem__)
                second = min((t for k, t in enumerate(totals) if k != best), default=2 * totals[best])
                score = 1 - totals[best] / second
                out.append((m.languages[best], score, score < narrow))
            yield pd.DataFrame(out, columns=["lang_pred", "score", "rejected"])

    return classify(F.col(text_col))


def identified(docs: DataFrame, model: LanguageModel, keep: tuple[str, ...] = ("doc_id",), text_col: str = "text", narrow: float = NARROW) -> DataFrame:
    """The columns ``keep``, then lang_pred, score and rejected, for every row."""
    got = docs.select(*keep, identify(docs, model, text_col, narrow).alias("__language"))
    return got.select(*keep, "__language.lang_pred", "__language.score", "__language.rejected")


def keep_identified(docs: DataFrame, model: LanguageModel, text_col: str = "text", narrow: float = NARROW) -> DataFrame:
    """The rows whose language is told by a sufficient margin, with their columns as they were."""
    return docs.where(~identify(docs, model, text_col, narrow)["rejected"])
