"""Quality rules with risk-controlled thresholds.

Each rule rejects texts whose rate is above a cutoff. Trials are the distinct labelled texts, so that neither repeated ids
nor copies make a bound look tighter than it is. They are split in two by a hash of the text: one part proposes cutoffs,
the other, the holdout, certifies them. A cutoff is used in a stratum only if the exact binomial
test on the stratum's good holdout texts shows that it rejects at most ``risk / number of rules`` of good texts, at
level ``delta`` divided by the number of tests made (Bonferroni over strata, rules and cutoffs). So all rules together
reject at most ``risk`` of a stratum's good texts, with probability 1 - delta over all strata at once. Of the certified
cutoffs the one that parts bad from good best on the proposing part is used; a rule without one is off in the stratum.

Defined results: null text has no words, symbols or lines; a null stratum is a stratum of its own; labels that are null
are not used, of several labels of an id or text the lowest counts, of several texts of an id one; without labels no rule is on, and only the base rule
decides; rows of the same id each keep their row; empty tables give an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chatterlake.llm.shared import fraction, saved, small

BLANKS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
CAPITALS = "A-Z"
WINDOW = 8
RULES = ("symbol_rate", "repeat_rate", "dup_line_rate", "shout_rate", "long_word_rate")
#: Proposed cutoffs: these quantiles of the good texts' rates, and the greatest of them with some room.
QUANTILES = (0.98, 0.99, 0.995, 0.998, 1.0)
ROOM = 1.1


def _count_of(text: Column, chars: str) -> Column:
    """How many characters of the text are of these: all others go, run by run."""
    return F.length(F.regexp_replace(text, f"[^{chars}]++", "")).cast("long")


def _no_hashes() -> Column:
    return F.array().cast("array<bigint>")


def _runs(parts: Column, step: int, times: int) -> Column:
    """The hash at each place of the parts there and ``step``, 2 ``step``, ... places on, ``times`` of them."""
    n = F.size(parts) - step * (times - 1)
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.xxhash64(*(F.get(parts, i + step * k) for k in range(times))))).otherwise(_no_hashes())


def _repeats(hashes: Column) -> Column:
    return F.size(F.array_distinct(hashes)) < F.size(hashes)


def text_measures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum: str | None = "lang") -> DataFrame:
    """(id, stratum, text_key, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_capitals) of whole texts."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), (F.col(stratum) if stratum else F.lit(None)).cast("string").alias("stratum"), text.alias("text"))
    rows = rows.select("*", F.array_remove(F.split("text", f"[{BLANKS}]+"), "").alias("words"), F.filter(F.split("text", "\n", -1), lambda x: x.rlike(f"[^{BLANKS}]")).alias("lines"))
    rows = rows.select(
        "id",
        "stratum",
        F.xxhash64("text").alias("text_key"),
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        _count_of(F.col("text"), SYMBOLS).alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.size("lines").cast("long").alias("n_lines"),
        _count_of(F.col("text"), CAPITALS + "!").alias("n_capitals"),
        _runs(F.col("words"), 1, WINDOW // 2).alias("runs"),
    )
    # Words inside windows that occur twice or more. A window of 8 words can't repeat where no run of 4 does, so most texts
    # are done with their runs of 4. The rest sort the hashes of their windows, mark equal neighbours, and add up the
    # stretch that each marked window covers beyond the one before it.
    rows = rows.withColumn("runs", F.when(_repeats(F.col("runs")), _runs(F.col("runs"), WINDOW // 2, 2)).otherwise(_no_hashes()))
    windows = F.transform("runs", lambda h, i: F.struct(h.alias("h"), (i + 1).alias("i")))
    rows = rows.withColumn("sorted", F.when(_repeats(F.col("runs")), F.array_sort(windows))).drop("runs")
    twice = F.filter(
        F.transform("sorted", lambda w, i: F.struct(w.i.alias("i"), ((i > 0) & (F.get("sorted", i - 1).h == w.h) | F.coalesce(F.get("sorted", i + 1).h == w.h, F.lit(False))).alias("twice"))),
        lambda w: w.twice,
    )
    rows = rows.select("*", F.array_sort(F.transform(twice, lambda w: w.i)).alias("at")).drop("sorted")
    cover = F.aggregate(
        F.transform("at", lambda p, i: F.when(i == 0, WINDOW).otherwise(F.least(F.lit(WINDOW), p - F.get("at", i - 1)))), F.lit(0), lambda total, x: total + x
    )
    return rows.select(*(c for c in rows.columns if c != "at"), F.coalesce(cover, F.lit(0)).cast("long").alias("n_repeat_words"))


def with_rates(measures: DataFrame) -> DataFrame:
    """Adds the rate of each rule; a text without words has rates of zero."""
    words, chars = F.greatest(F.col("n_words"), F.lit(1)), F.greatest(F.col("word_chars"), F.lit(1))
    return measures.withColumns({
        "symbol_rate": F.col("n_symbols") / words,
        "repeat_rate": F.col("n_repeat_words") / words,
        "dup_line_rate": F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)),
        "shout_rate": F.col("n_capitals") / chars,
        "long_word_rate": F.col("word_chars") / words,
    })


def log_factorial(n: Column) -> Column:
    """ln n! by Stirling's series at n + 8, exact to about 1e-12, stepped down by the eight factors."""
    x = n.cast("double") + 9.0
    series = (x - 0.5) * F.log(x) - x + 0.9189385332046727 + 1 / (12 * x) - 1 / (360 * x * x * x) + 1 / (1260 * x * x * x * x * x)
    product = F.lit(1.0)
    for k in range(1, 9):
        product = product * (n.cast("double") + float(k))
    return series - F.log(product)


def binomial_tail(k: Column, n: Column, p: float) -> Column:
    """P(X <= k) for X ~ Bin(n, p), summed from the term at k down; terms beyond a million are nil to double precision.

    For k at or above the mean the tail is no evidence, and 1 is returned.
    """
    log_top = log_factorial(n) - log_factorial(k) - log_factorial(n - k) + k * F.log(F.lit(p)) + (n - k) * F.log1p(F.lit(-p))
    below = F.when(k > 0, F.sequence(F.lit(1), F.least(k, F.lit(1_000_000)).cast("int"))).otherwise(F.array().cast("array<int>"))
    start = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("total"))

    def add(acc: Column, j: Column) -> Column:
        term = acc.term * ((k - j + 1) * (1 - p)) / ((n - k + j) * p)
        return F.struct(term.alias("term"), (acc.total + term).alias("total"))

    return F.when(k >= n * p, F.lit(1.0)).otherwise(F.least(F.lit(1.0), F.exp(log_top) * F.aggregate(below, start, add, lambda acc: acc.total)))


def certified_cutoffs(measures: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality", risk: float = 0.05, delta: float = 0.05) -> DataFrame:
    """(stratum, one column per rule): the cutoff in use, null where the rule is off. ``measures``: ids, strata, rates."""
    good = labels.select(F.col(id_col).alias("id"), F.col(label_col).alias("label")).where("id is not null and label is not null").groupBy("id").agg(F.min("label").alias("label"))
    once = measures.join(good, "id").groupBy("id").agg(F.min(F.struct("stratum", "text_key", "label", *RULES)).alias("row")).select("row.*")
    trials = once.groupBy("stratum", "text_key").agg(F.min("label").alias("label"), *(F.first(r).alias(r) for r in RULES))
    rows = trials.select(
        F.coalesce("stratum", F.lit("")).alias("stratum"),
        F.col("stratum").isNull().alias("no_stratum"),
        (fraction(F.lit("split"), F.col("text_key")) < 0.5).alias("proposes"),
        (F.col("label") > 0).alias("good"),
        *RULES,
    )
    pairs = ", ".join(f"'{r}', {r}" for r in RULES)
    rates = saved(rows.selectExpr("stratum", "no_stratum", "proposes", "good", f"stack({len(RULES)}, {pairs}) as (rule, rate)"), "rates")
    key = ["stratum", "no_stratum", "rule"]
    quantiles = rates.where("proposes and good").groupBy(key).agg(F.percentile_approx("rate", list(QUANTILES), F.lit(100_000)).alias("q"))
    cutoffs = quantiles.select(*key, F.explode(F.array_distinct(F.concat("q", F.array(F.element_at("q", -1) * ROOM + 1e-6)))).alias("cutoff"))
    above = F.col("rate") > F.col("cutoff")
    count = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    tallies = rates.join(small(saved(cutoffs, "proposed")), key).groupBy(*key, "cutoff").agg(
        count(~F.col("proposes") & F.col("good")).alias("n"),
        count(~F.col("proposes") & F.col("good") & above).alias("k"),
        count(F.col("proposes") & ~F.col("good") & above).alias("bad_cut"),
        count(F.col("proposes") & F.col("good") & above).alias("good_cut"),
        count(F.col("proposes") & F.col("good")).alias("good_all"),
        count(F.col("proposes") & ~F.col("good")).alias("bad_all"),
    )
    tallies = saved(tallies, "tallies")
    tests = max(1, tallies.count())
    tallies = tallies.where(binomial_tail(F.col("k"), F.col("n"), risk / len(RULES)) <= delta / tests)
    gain = F.col("bad_cut") / F.greatest(F.col("bad_all"), F.lit(1)) - 20 * F.col("good_cut") / F.greatest(F.col("good_all"), F.lit(1))
    best = tallies.select(*key, "cutoff", gain.alias("gain")).where("gain > 0").groupBy(key).agg(F.max(F.struct("gain", "cutoff"))["cutoff"].alias("cutoff"))
    each = (F.max(F.when(F.col("rule") == r, F.col("cutoff"))).alias(f"max_{r}") for r in RULES)
    return best.groupBy("stratum", "no_stratum").agg(*each)


def quality_verdicts(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum: str | None = "lang", label_col: str = "quality", risk: float = 0.05, delta: float = 0.05, least_words: int = 20, most_repeat_percent: int = 30) -> DataFrame:
    """(id, the base measures, base_failed, kept, failed_rules) of every row."""
    measures = saved(with_rates(text_measures(docs, id_col, text_col, stratum)), "measures")
    cutoffs = saved(certified_cutoffs(measures, labels, id_col, label_col, risk, delta), "cutoffs")
    cutoffs = cutoffs.select(F.when(~F.col("no_stratum"), F.col("stratum")).alias("s"), *(f"max_{r}" for r in RULES))
    joined = measures.join(small(cutoffs), F.col("stratum").eqNullSafe(F.col("s")), "left")
    failed = F.array_compact(F.array(*(F.when(F.col(r) > F.col(f"max_{r}"), F.lit(r)) for r in RULES)))
    base_failed = (F.col("n_words") < least_words) | (100 * F.col("n_repeat_words") > most_repeat_percent * F.col("n_words"))
    return joined.select(
        F.col("id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        base_failed.alias("base_failed"), (~base_failed & (F.size(failed) == 0)).alias("kept"), failed.alias("failed_rules"),
    )
