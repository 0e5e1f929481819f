"""Line dedup by a deletion-neighbourhood join: of lines within the edit bound of each other the earliest stays.

A line is compared by its words in lower case. The edit distance counts words put in, taken out or replaced; the
bound is one for lines of ``edit_words`` words and none for shorter ones, where one word is too much of the line.
Lines of fewer than ``least_words`` words are never compared and always stay. Order is by id, then place in the text.

Each line emits the hashes of all its deletion variants (the line, and the line without word i). Two lines are one
replacement apart exactly if their variants without the same place i are equal, one insertion apart exactly if one
line equals a variant of the other. So the earliest line of each group of equal variants is all that a member must
know: the join never forms pairs within a group. The match is then verified on the words themselves.

Defined results: rows with a null id or null text stay as they are; of rows equal in id and text each keeps the same
lines; rows of one id with different texts are told apart by the text's hash; an empty table gives an empty result;
columns other than id and text are carried along untouched (a count of characters is the caller's to renew).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chatterlake.llm.shared import saved


#: What tells a line from all others, in the order of lines.
PLACE = ["id", "text_key", "line_no"]


def tidy(line: Column) -> Column:
    """The words of a line in lower case with one space between."""
    uneven = F.contains(line, F.lit("  ")) | F.contains(line, F.lit("\t")) | F.contains(line, F.lit("\r")) | F.contains(line, F.lit("\x0b")) | F.contains(line, F.lit("\x0c"))
    return F.trim(F.when(uneven, F.regexp_replace(F.lower(line), "[ \\t\\x0B\\f\\r]+", " ")).otherwise(F.lower(line)))


def has_words(line: Column, n: int) -> Column:
    """At least n words: a look at the start of the line, no more."""
    return line.rlike(rf"^[ \t\x0B\f\r]*+(?:[^ \t\x0B\f\r]++[ \t\x0B\f\r]++){{{n - 1}}}[^ \t\x0B\f\r]") if n > 0 else F.lit(True)


def word_count(tidied: Column) -> Column:
    return F.when(tidied == "", 0).otherwise(F.length(tidied) - F.length(F.replace(tidied, F.lit(" "), F.lit(""))) + 1)


def first_words(tidied: Column, n: Column) -> Column:
    return F.call_function("substring_index", tidied, F.lit(" "), n)


def without(tidied: Column, n: Column, place: Column) -> Column:
    """The line of n words without the word at a place (1 on); place 0 takes nothing out."""
    rest = F.concat(first_words(tidied, place - 1), F.lit(" "), first_words(tidied, place - n))
    return F.when(place == 0, tidied).otherwise(F.trim(rest))


def block_keys(tidied: Column, n: Column, edit_words: int) -> Column:
    """Hashes of halves: lines one edit apart agree on a half of the shorter one's length, from the start or the end."""

    def halves(m: Column) -> list[Column]:
        half = F.floor(m / 2).cast("int")
        return [F.xxhash64(F.lit("start"), m, first_words(tidied, half)), F.xxhash64(F.lit("end"), m, first_words(tidied, half - m))]

    both = F.array(*halves(n), *halves(n - 1))
    return F.when(n > edit_words, both).when(n == edit_words, F.array(*halves(n))).otherwise(F.array().cast("array<bigint>"))


def flags(places: Column) -> Column:
    """An array with true at the given places (from 0) and false between them: a line is looked up in constant time."""
    placed = F.sort_array(places)
    ones = F.zip_with(placed, F.concat(F.array(F.lit(-1)), placed), lambda x, before: F.when(x.isNull(), "").otherwise(F.concat(F.repeat(F.lit("0"), x - before - 1), F.lit("1"))))
    return F.transform(F.split(F.array_join(ones, ""), ""), lambda c: c == "1")


def comparable_lines(docs: DataFrame, id_col: str, text_col: str, least_words: int) -> DataFrame:
    """(id, text_key, line_no, line: its words, n)."""
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("text_key"), F.posexplode(F.split(text_col, "\n", -1)).alias("line_no", "line"))
    rows = rows.where(F.col("id").isNotNull() & has_words(F.col("line"), least_words)).select("id", "text_key", "line_no", tidy(F.col("line")).alias("line"))
    return rows.select("*", word_count(F.col("line")).alias("n"))


def ranked_candidates(docs: DataFrame, firsts: DataFrame, id_col: str, text_col: str, least_words: int) -> DataFrame:
    """(rank, id, text_key, line_no, line, n) of the lines that share a block key with another; ranks follow the order of places."""
    keyed = firsts.select(F.explode("keys").alias("key"), "id", "line_no")
    shared = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    wanted = keyed.join(shared, "key", "left_semi").groupBy("id").agg(F.collect_set("line_no").alias("places"))
    wanted = saved(wanted.select("id", flags(F.col("places")).alias("wanted")), "wanted-lines")
    sources = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(wanted, "id")
    some = F.filter(F.transform(F.split("text", "\n", -1), lambda line, i: F.struct(i.alias("line_no"), line.alias("line"))), lambda x: F.coalesce(F.get("wanted", x["line_no"]), F.lit(False)))
    lines = sources.select("id", F.xxhash64("text").alias("text_key"), F.explode(some).alias("at"))
    lines = lines.select("id", "text_key", "at.line_no", tidy(F.col("at.line")).alias("line"))
    lines = lines.select(*PLACE, "line", word_count(F.col("line")).alias("n"))
    # rows equal in id and text count once; later occurrences of an equal line were settled before
    lines = lines.join(firsts, PLACE, "left_semi").distinct()
    # sorted by ranges, so the ids that grow with the partition and the row follow the order of places
    return saved(lines.orderBy(*PLACE).withColumn("rank", F.monotonically_increasing_id()), "near-lines")


def dropped_near_lines(docs: DataFrame, firsts: DataFrame, id_col: str, text_col: str, edit_words: int, least_words: int) -> DataFrame:
    """(id, text_key, line_no) of first occurrences that are one edit from an earlier line. ``firsts``: those and keys."""
    lines = ranked_candidates(docs, firsts, id_col, text_col, least_words)
    gaps = lines.select("rank", "line", "n", F.explode(F.sequence(F.lit(0), F.col("n"))).alias("gap"))
    rests = gaps.select("rank", "gap", without(F.col("line"), F.col("n"), F.col("gap")).alias("rest"))
    variants = rests.select("rank", "gap", F.xxhash64("rest").alias("v1"), F.xxhash64(F.lit(1), "rest").alias("v2"))
    often = variants.groupBy("v1").agg(F.min("rank").alias("a"), F.max("rank").alias("b")).where("a < b").select("v1")
    variants = saved(variants.join(often, "v1", "left_semi"), "variants")
    whole, taken = F.col("gap") == 0, F.col("gap") > 0
    equal = variants.groupBy("v1", "v2", "gap").agg(F.min("rank").alias("least"), F.max("rank").alias("most"))
    replaced = variants.where(taken).join(equal.where(taken & (F.col("least") < F.col("most"))).select("v1", "v2", "gap", "least"), ["v1", "v2", "gap"])
    replaced = replaced.select("rank", "gap", F.col("least").alias("other"), F.col("gap").alias("other_gap"))
    ends = equal.groupBy("v1", "v2").agg(F.min(F.when(whole, F.col("least"))).alias("whole"), F.min(F.when(taken, F.struct("least", "gap"))).alias("longer"))
    ends = ends.where(F.col("whole").isNotNull() & F.col("longer").isNotNull())
    inserted = variants.join(ends, ["v1", "v2"]).select(
        "rank",
        "gap",
        F.when(whole, F.col("longer.least")).otherwise(F.col("whole")).alias("other"),
        F.when(whole, F.col("longer.gap")).otherwise(F.lit(0)).alias("other_gap"),
    )
    matches = replaced.union(inserted).where(F.col("other") < F.col("rank"))
    other = lines.select(F.col("rank").alias("other"), F.col("line").alias("other_line"), F.col("n").alias("other_n"))
    matches = matches.join(lines, "rank").join(other, "other")
    one_edit = without(F.col("line"), F.col("n"), F.col("gap")) == without(F.col("other_line"), F.col("other_n"), F.col("other_gap"))
    return matches.where(one_edit & (F.least("n", "other_n") >= edit_words)).select(*PLACE).distinct()


def kept_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_words: int = 1, edit_words: int = 10) -> DataFrame:
    """(id, text_key, stays: for each line up to the last that stays, whether it is a comparable one that does)."""
    lines = comparable_lines(docs, id_col, text_col, least_words)
    hashed = lines.select(
        F.xxhash64("line").alias("h1"),
        F.xxhash64(F.lit(1), "line").alias("h2"),
        F.struct("id", "text_key", "line_no").alias("place"),
        block_keys(F.col("line"), F.col("n"), edit_words).alias("keys"),
    )
    firsts = saved(hashed.groupBy("h1", "h2").agg(F.min("place").alias("place"), F.first("keys").alias("keys")).select("place.*", "keys"), "first-lines")
    dropped = dropped_near_lines(docs, firsts, id_col, text_col, edit_words, least_words)
    kept = firsts.select(*PLACE).join(dropped, PLACE, "left_anti")
    kept = kept.groupBy("id", "text_key").agg(F.collect_set("line_no").alias("places"))
    return saved(kept.select("id", "text_key", flags(F.col("places")).alias("stays")), "kept-lines")


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_words: int = 1, edit_words: int = 10) -> DataFrame:
    """The rows of ``docs`` with their text reduced to the lines that stay, then ``n_lines`` and ``n_dropped``."""
    kept = kept_lines(docs, id_col, text_col, least_words, edit_words).select(
        F.col("id").alias("__id"), F.col("text_key").alias("__text_key"), F.col("stays").alias("__stays")
    )
    joined = docs.join(kept, (F.col(id_col) == F.col("__id")) & (F.xxhash64(text_col) == F.col("__text_key")), "left")
    stays = F.filter(F.split(text_col, "\n", -1), lambda line, i: F.coalesce(F.get("__stays", i), F.lit(False)) | ~has_words(line, least_words))
    whole = F.col(id_col).isNull() | F.col(text_col).isNull()
    text = F.when(whole, F.col(text_col)).otherwise(F.array_join(stays, "\n"))
    breaks = lambda c: F.length(c) - F.length(F.replace(c, F.lit("\n"), F.lit("")))
    joined = joined.withColumn("__text", text)
    # an empty text has one line left if there was an empty line, else none
    blank = F.startswith(F.col(text_col), F.lit("\n")) | F.endswith(F.col(text_col), F.lit("\n")) | F.contains(F.col(text_col), F.lit("\n\n"))
    n_lines = F.when(F.col(text_col).isNull(), 0).otherwise(breaks(F.col(text_col)) + 1)
    left = F.when((F.col("__text") == "") & (F.col(text_col) != "") & ~blank, 0).otherwise(breaks(F.col("__text")) + 1)
    return joined.select(
        *((F.col("__text").alias(c) if c == text_col else F.col(c)) for c in docs.columns if c not in ("n_lines", "n_dropped")),
        n_lines.alias("n_lines"),
        F.when(whole, 0).otherwise(n_lines - left).alias("n_dropped"),
    )
