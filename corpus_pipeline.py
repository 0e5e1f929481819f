"""Documents made ready for training: five stages, each written as Parquet and read again for the next.

Every stage takes (spark, docs, sf_dir) and returns the columns of documents; the last adds the copy and its position
in the mixed stream. Python on the executors is used by language ID, SimHash near-dedup and decontamination; line
dedup and mixing are DataFrame operations only.

Defined results, for all stages: extra columns of the input are left out, whatever their names; an empty table gives an
empty result; rows of one id with different texts are told apart by their texts. Each stage says what it does with nulls,
empty texts, ties and repeated rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chatterlake.llm import decontaminate, language, lines, mixing, simhash
from chatterlake.llm.queries import table
from chatterlake.llm.shared import scratch_path

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _documents(docs: DataFrame) -> DataFrame:
    docs.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "500")
    return docs.select(*COLUMNS)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told by a sufficient margin stay.

    Null and empty texts and texts without a letter go; a tie between two languages is no margin, so it goes; repeated
    rows are judged alike. A null language isn't learned from, a null id or source doesn't matter."""
    docs = _documents(docs)
    return language.keep_identified(docs, language.learn_languages(docs))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that stand earlier in the corpus go; a document goes when none of its lines is left.

    Earlier is by id, then by place. A null id or text stays as it is; blank lines are no repeats; repeated rows of an id
    keep the same lines each. A document of blank lines only, or empty, has lost nothing and stays."""
    out = lines.dedup_lines(_documents(docs), least_words=1).where((F.col("n_dropped") == 0) | (F.col("text") != ""))
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, the one of the smallest id.

    Rows with a null id stay; rows equal in id and text are one; texts without a word are copies of each other."""
    return simhash.without_near_copies(_documents(docs)).select(*COLUMNS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go.

    Null and empty texts hold nothing and stay; items that are null or shorter than a shingle are held by none; repeated
    rows are judged alike."""
    return decontaminate.without_contaminated(_documents(docs), table(spark, sf_dir, "benchmark")).select(*COLUMNS)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources mixed towards equal weights as far as two passes over a source allow; every document occurs.

    A null source is a source of its own; a null text has no tokens and occurs once for each pass; rows equal in id, text
    and source get the same copies each."""
    return mixing.mixed(_documents(docs), mixing.Target(most_repeats=2.0))


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("source_mixing", source_mixing),
]

#: Compression, SimHash and shingle verification can't be said in SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
