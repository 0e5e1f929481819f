"""Token counts behind a digest cache: only texts that no run has counted yet are encoded.

Defined results: null text counts as empty; special strings inside a text are handled as the tokenizer's default does;
no special tokens are added, nothing is truncated. Rows with the same id each keep their row; a null id keeps its row;
an empty table gives an empty result. Columns other than id and text are not read.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator
from importlib import metadata
from pathlib import Path

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chatterlake.llm.shared import saved

CACHE_SCHEMA = "tokenizer binary, digest binary, n_tokens long"
TEXTS_AT_ONCE = 64


def tokenizer_version(path: str) -> bytes:
    """The digest of a tokenizer's file and its library's version: with another of either, counts may differ."""
    library = "sentencepiece" if path.endswith(".model") else "tokenizers"
    return hashlib.sha256(f"{library} {metadata.version(library)}\n".encode() + Path(path).read_bytes()).digest()


def load_counter(path: str):
    """A function from texts to token counts, for a ``.json`` (tokenizers) or ``.model`` (sentencepiece) file."""
    if path.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return lambda texts: [len(x) for x in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]


def read_cache(spark: SparkSession, path: str) -> DataFrame:
    try:
        return spark.read.schema(CACHE_SCHEMA).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], CACHE_SCHEMA)


def encode_misses(misses: DataFrame, path: str) -> DataFrame:
    """(digest, n_tokens) for rows (digest, text)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        count = load_counter(path)
        for pdf in batches:
            texts = pdf["text"].tolist()
            counts = [n for i in range(0, len(texts), TEXTS_AT_ONCE) for n in count(texts[i : i + TEXTS_AT_ONCE])]
            yield pd.DataFrame({"digest": pdf["digest"], "n_tokens": counts})

    return misses.mapInPandas(run, "digest binary, n_tokens long")


def token_counts(docs: DataFrame, tokenizer_path: str, cache_path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 512) -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) of every row.

    ``cache_path`` is a table (tokenizer, digest, n_tokens) in a folder that driver and executors share; it is read,
    and the counts of distinct texts that it lacks are appended. Two runs that append the same text do no harm.
    """
    spark = docs.sparkSession
    version = F.lit(tokenizer_version(tokenizer_path))
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), text.alias("text"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest"))
    keys = saved(rows.select("id", "digest", F.octet_length("text").cast("long").alias("n_bytes")), "digests")
    stored = read_cache(spark, cache_path).where(F.col("tokenizer") == version)
    wanted = saved(keys.select("digest").distinct().join(stored, "digest", "left_anti"), "uncounted")
    # one text a digest, whatever rows share it; copies meet before the shuffle
    misses = rows.join(wanted, "digest", "left_semi").groupBy("digest").agg(F.any_value("text").alias("text"))
    fresh = encode_misses(misses, tokenizer_path)
    fresh.select(version.alias("tokenizer"), "digest", "n_tokens").write.mode("append").parquet(cache_path)
    counts = read_cache(spark, cache_path).where(F.col("tokenizer") == version)
    counts = saved(counts.groupBy("digest").agg(F.max("n_tokens").alias("n_tokens")), "counts")
    out = keys.join(counts, "digest")
    return out.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
