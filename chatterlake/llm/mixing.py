"""Mixing sources to target weights: temperature, bisection, budgeted block permutations.

A source with share p of all tokens gets weight p**a, normalised. The exponent a in [0, 1] is the largest that reaches
a target entropy, or the smallest at which no source is repeated more than a limit; both are monotone in a, so it is
found by bisection, five levels a pass over the table of sources. Within a token budget each source then gets whole
passes over its documents and a last part of a pass: the documents' order is a hash permutation, cut into 1024 blocks;
whole blocks are taken while they fit, then the block at the cut is taken apart in the same way, three levels deep, so
the cut is exact to a 2**-30th of a source and no source is ever sorted or gathered.

Tokens are white-space words. Defined results: a null source is a source of its own; null text has no tokens; a source
without tokens keeps one copy of each document; rows of the same id each count; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chatterlake.llm.shared import fraction, saved, small

LEVELS_A_PASS, PASSES = 5, 6
BITS, DEPTH = 10, 3
CELLS = 1 << (BITS * DEPTH)


@dataclass(frozen=True)
class Target:
    """What the exponent must meet: entropy as a share of that of equal weights, or the repeats of any source."""

    entropy_share: float | None = None
    most_repeats: float | None = 2.0
    #: Tokens to realise; None: as many as give each source one whole pass at least, so that nothing is lost.
    budget_tokens: float | None = None


def document_tokens(docs: DataFrame, id_col: str, text_col: str, source_col: str, seed: int) -> DataFrame:
    """(id, text_key, source, tokens, cell): cell is a document's place in its source's permutation, in CELLS parts."""
    words = F.size(F.array_remove(F.split(F.coalesce(F.col(text_col), F.lit("")), r"[ \t\n\x0b\x0c\r]+"), ""))
    key = F.xxhash64(text_col)
    return docs.select(
        F.col(id_col).alias("id"),
        key.alias("text_key"),
        F.col(source_col).alias("source"),
        words.cast("long").alias("tokens"),
        F.floor(fraction(F.lit(seed), F.col(id_col), key) * CELLS).cast("int").alias("cell"),
    )


def find_exponent(shares: DataFrame, total: int, target: Target) -> float:
    """Bisect the exponent over (source, tokens); every pass evaluates the 31 midpoints of five levels at once."""
    low, high = 0.0, 1.0
    p = F.col("tokens") / F.lit(float(total))
    for _ in range(PASSES):
        step = (high - low) / 2**LEVELS_A_PASS
        grid = [low + step * i for i in range(1, 2**LEVELS_A_PASS)]
        weight = F.pow(p, F.col("a"))
        rows = shares.where("tokens > 0").select("tokens", F.explode(F.array(*(F.lit(a) for a in grid))).alias("a")).groupBy("a").agg(
            F.sum(weight).alias("z"),
            F.sum(weight * F.col("a") * F.log(p)).alias("zlog"),
            F.count("*").alias("n"),
            F.max(weight / p).alias("most"),
            F.min(weight / p).alias("least"),
        )
        met = {r["a"]: _meets(r, total, target) for r in rows.collect()}
        # below the wanted exponent a target of entropy is met and a limit on repeats is broken
        below = [a for a in grid if met.get(a, True) == (target.entropy_share is not None)]
        low, high = (max(below), max(below) + step) if below else (low, low + step)
    return low if target.entropy_share is not None else high


def _meets(row, total: int, target: Target) -> bool:
    if target.entropy_share is not None:
        entropy = math.log(row["z"]) - row["zlog"] / row["z"]
        return entropy >= target.entropy_share * math.log(row["n"]) - 1e-12
    if target.budget_tokens is None:
        return row["most"] / row["least"] <= target.most_repeats + 1e-12
    return target.budget_tokens / total * row["most"] / row["z"] <= target.most_repeats + 1e-12


def source_quotas(shares: DataFrame, total: int, exponent: float, target: Target) -> DataFrame:
    """(source, tokens, weight, quota in tokens, passes, need): need is what the last part of a pass may hold."""
    p = F.col("tokens") / F.lit(float(max(total, 1)))
    raw = shares.select("*", F.when(F.col("tokens") > 0, F.pow(p, F.lit(exponent))).otherwise(0.0).alias("raw"))
    sums = raw.agg(F.sum("raw").alias("z"), F.min(F.when(F.col("tokens") > 0, F.col("raw") / p)).alias("least")).first()
    z, budget = sums["z"] or 1.0, target.budget_tokens
    if budget is None:
        budget = total * z / (sums["least"] or 1.0)
    quota = F.col("raw") / z * budget
    # a quota within a millionth of whole passes is whole: it comes from rounding
    ratio = F.when(F.col("tokens") > 0, quota / F.col("tokens")).otherwise(1.0)
    passes = F.floor(ratio + 1e-6).cast("int")
    need = F.greatest(F.lit(0.0), (ratio - passes) * F.col("tokens"))
    return raw.select("source", "tokens", (F.col("raw") / z).alias("weight"), quota.alias("quota"), passes.alias("passes"), need.alias("need"))


def cut_cells(each: DataFrame, quotas: DataFrame) -> DataFrame:
    """(source, cut): documents at cells below the cut are in the last part of a pass."""
    state = quotas.where("need > 0").select("source", "need", F.lit(0).alias("start"))
    for depth in range(DEPTH):
        width = CELLS >> (BITS * (depth + 1))
        state = saved(state, "cuts")
        near = each.join(small(state.select(F.col("source").alias("s"), "start")), F.col("source").eqNullSafe(F.col("s")))
        near = near.where((F.col("cell") >= F.col("start")) & (F.col("cell") < F.col("start") + (width << BITS)))
        blocks = near.groupBy("source", F.floor(F.col("cell") / width).cast("int").alias("block")).agg(F.sum("tokens").alias("tokens"))
        # at most 1024 blocks a source, whatever the number of its documents
        order = Window.partitionBy("source").orderBy("block")
        blocks = blocks.select("source", "block", "tokens", F.sum("tokens").over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("upto"))
        fit = blocks.join(small(state.select(F.col("source").alias("s"), "need", "start")), F.col("source").eqNullSafe(F.col("s")))
        over = F.when(F.col("upto") > F.col("need"), F.struct("block", F.col("need") - (F.col("upto") - F.col("tokens"))))
        state = fit.groupBy("source").agg(F.min(over).alias("over"), F.min("need").alias("need"), F.max("start").alias("start")).select(
            "source",
            F.when(F.col("over").isNotNull(), F.col("over.col2")).otherwise(F.lit(0.0)).alias("need"),
            F.when(F.col("over").isNotNull(), F.col("over.block") * width).otherwise(F.lit(CELLS)).alias("start"),
        )
    return saved(state.select("source", F.col("start").alias("cut")), "cuts")


def mixture(docs: DataFrame, target: Target = Target(), id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 0) -> DataFrame:
    """(id, text_key, source, tokens, weight, copies, cell, rate) of every row; copies may be 0 under a given budget."""
    each = saved(document_tokens(docs, id_col, text_col, source_col, seed), "tokens")
    shares = saved(each.groupBy("source").agg(F.sum("tokens").alias("tokens")), "shares")
    total = shares.agg(F.sum("tokens")).first()[0] or 0
    exponent = find_exponent(shares, total, target) if total else 1.0
    quotas = saved(source_quotas(shares, total, exponent, target), "quotas")
    cuts = cut_cells(each, quotas)
    plan = quotas.join(cuts.select(F.col("source").alias("s"), "cut"), F.col("source").eqNullSafe(F.col("s")), "left")
    plan = saved(plan.select(F.col("source").alias("s"), "weight", "passes", F.coalesce("cut", F.lit(0)).alias("cut"), F.when(F.col("tokens") > 0, F.col("quota") / F.col("tokens")).otherwise(1.0).alias("rate")), "plan")
    joined = each.join(small(plan), F.col("source").eqNullSafe(F.col("s")))
    copies = F.col("passes") + F.when(F.col("cell") < F.col("cut"), 1).otherwise(0)
    return joined.select("id", "text_key", "source", "tokens", "weight", copies.alias("copies"), "cell", "rate")


def copy_positions(copies: Column, cell: Column, rate: Column, seed: int) -> Column:
    """An array of (copy, position): each pass permutes its blocks anew; position in [0, 1) is the place in the mixed
    stream, at which every source is spread evenly. The last pass keeps the order in which it was cut."""

    def place(copy: Column) -> Column:
        block = F.shiftright(cell, BITS * (DEPTH - 1))
        inside = F.pmod(cell, F.lit(1 << (BITS * (DEPTH - 1)))) / float(1 << (BITS * (DEPTH - 1)))
        moved = F.floor(fraction(F.lit(seed), copy, block) * (1 << BITS)) + inside
        at = F.when(copy + 1 >= copies, cell / float(CELLS)).otherwise(moved / float(1 << BITS))
        return F.struct(copy.alias("copy"), F.least((copy + at) / F.greatest(rate, copies.cast("double")), F.lit(1.0)).alias("position"))

    return F.when(copies > 0, F.transform(F.sequence(F.lit(0), copies - 1), place))


def mixed(docs: DataFrame, target: Target = Target(), id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 0) -> DataFrame:
    """The rows of ``docs``, once for each copy, with ``copy`` and ``position``; sort by position to get the stream."""
    plan = mixture(docs, target, id_col, text_col, source_col, seed)
    plan = plan.select(F.col("id").alias("__id"), F.col("text_key").alias("__text_key"), F.col("source").alias("__source"), "copies", "cell", "rate").distinct()
    same = F.col(id_col).eqNullSafe(F.col("__id")) & (F.xxhash64(text_col) == F.col("__text_key")) & F.col(source_col).eqNullSafe(F.col("__source"))
    joined = docs.drop("copy", "position", "copies", "cell", "rate").join(plan, same)
    columns = [c for c in docs.columns if c not in ("copy", "position", "copies", "cell", "rate")]
    return joined.select(*columns, F.explode(copy_positions(F.col("copies"), F.col("cell"), F.col("rate"), seed)).alias("__copy")).select(*columns, "__copy.copy", "__copy.position")
