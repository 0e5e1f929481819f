"""Tweet archive and fetch ledger: provider comparison, reconciliation, coverage, account statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chatterlake.operators.signals import last_rows

#: Statuses after which a day is settled; tolerated gaps.
TERMINAL = ("complete", "exhausted", "empty")
STATUSES = ("pending", "running", "complete", "exhausted", "empty", "failed", "skipped")
COUNT_GAP, RUN_SPREAD, RUN_OVERLAP = 0.10, 0.05, 0.95


def by_id(tweets: DataFrame, keys: list[str], a: str = "A", b: str = "B") -> DataFrame:
    """One row per tweet with a flag for each provider: one shuffle in place of four set operations."""
    return tweets.groupBy(*keys, "tweet_id").agg(F.bool_or(F.col("provider") == a).alias("in_a"), F.bool_or(F.col("provider") == b).alias("in_b"), F.min("created_at").alias("created_at"))


def compare_providers(tweets: DataFrame) -> DataFrame:
    """Per account: counts of each provider, of both, of one only, of either, and the first tweet."""
    f = by_id(tweets, ["handle"])
    a, b = F.col("in_a"), F.col("in_b")
    return f.groupBy("handle").agg(
        F.count_if(a).alias("n_a"), F.count_if(b).alias("n_b"), F.count_if(a & b).alias("n_both"), F.count_if(a & ~b).alias("a_only"),
        F.count_if(b & ~a).alias("b_only"), F.count("*").alias("n_union"), F.min("created_at").alias("earliest"),
    )


def union_lift(counts: DataFrame) -> DataFrame:
    """What the union adds to the first provider."""
    lift = F.col("n_union") - F.col("n_a")
    return counts.select("handle", lift.alias("lift"), (100 * lift / F.nullif(F.col("n_a"), F.lit(0))).alias("lift_pct"))


def account_totals(tweets: DataFrame) -> DataFrame:
    return tweets.groupBy("handle").agg(F.count_distinct("tweet_id").alias("total"), F.min("created_at").alias("earliest"), F.max("created_at").alias("latest"))


def status_counts(log: DataFrame) -> DataFrame:
    return log.groupBy("handle").pivot("status", list(STATUSES)).count().fillna(0)


def coverage_floor(log: DataFrame, ok: str = "complete") -> DataFrame:
    """The first date at which as many providers are ok as the account ever had."""
    total = log.groupBy("handle").agg(F.count_distinct("provider").alias("all"))
    day = log.where(F.col("status") == ok).groupBy("handle", "date").agg(F.count_distinct("provider").alias("n"))
    return day.join(total, "handle").where(F.col("n") == F.col("all")).groupBy("handle").agg(F.min("date").alias("floor"))


def count_gap(high: Column, low: Column) -> Column:
    return (high - low) / F.greatest(high, F.lit(1))


def reconcile(log: DataFrame, configured: DataFrame | None = None) -> DataFrame:
    """Per account and day: ok or mismatch once all providers are settled, else skipped; a missing count is 0.

    With ``configured`` (handle, providers) an account's configured providers must be there and settled; an account that
    it lacks, and all accounts without it, need two providers at least, all settled."""
    n = F.coalesce("tweets_fetched", F.lit(0))
    g = log.groupBy("handle", "date").agg(
        F.max(n).alias("high"), F.min(n).alias("low"), F.count("*").alias("seen"), F.count_if(F.col("status") == "failed").alias("failed"), F.count_if(F.col("status").isin(*TERMINAL)).alias("settled"),
        F.collect_set(F.when(F.col("status").isin(*TERMINAL), F.col("provider"))).alias("settled_providers"), F.map_from_entries(F.collect_list(F.struct("provider", n))).alias("counts"),
    )
    g = g.join(configured, "handle", "left") if configured is not None else g.withColumn("providers", F.lit(None).cast("array<string>"))
    wanted = F.col("providers").isNotNull() & (F.size("providers") > 0)
    ready = F.when(wanted, F.size(F.array_except("providers", "settled_providers")) == 0).otherwise((F.col("seen") >= 2) & (F.col("settled") == F.col("seen")))
    of_wanted = F.transform(F.col("providers"), lambda p: F.element_at("counts", p))
    high = F.when(wanted, F.array_max(of_wanted)).otherwise(F.col("high"))
    low = F.when(wanted, F.array_min(of_wanted)).otherwise(F.col("low"))
    verdict = F.when(~ready, "skipped").when(count_gap(high, low) <= COUNT_GAP, "ok").otherwise("mismatch")
    day = F.when((F.col("failed") == F.col("seen")), "failed").when(count_gap(F.col("high"), F.col("low")) <= COUNT_GAP, "ok").otherwise("mismatch")
    return g.select("handle", "date", verdict.alias("verdict"), day.alias("day_verdict"))


def run_stability(runs: DataFrame, marks: DataFrame) -> DataFrame:
    """Per account. ``runs``: handle, run, tweet_id; ``marks``: handle, run, aborted, reached_floor. First failing rule wins."""
    counts = marks.join(runs.groupBy("handle", "run").agg(F.count_distinct("tweet_id").alias("n")), ["handle", "run"], "left").fillna(0, ["n"])
    flags = counts.groupBy("handle").agg(F.bool_or("aborted").alias("aborted"), F.bool_and("reached_floor").alias("floor"), F.max("n").alias("high"), F.min("n").alias("low"))
    per_id = runs.groupBy("handle", "tweet_id").agg(F.collect_set("run").alias("in_runs"))
    later = marks.select("handle", "run").where("run > 1")
    both = per_id.join(later, "handle").groupBy("handle", "run").agg(
        F.count_if(F.array_contains("in_runs", 1) & F.array_contains("in_runs", F.col("run"))).alias("shared"),
        F.count_if(F.array_contains("in_runs", 1) | F.array_contains("in_runs", F.col("run"))).alias("either"),
    )
    least = both.groupBy("handle").agg(F.min(F.col("shared") / F.nullif(F.col("either"), F.lit(0))).alias("overlap"))
    spread = (F.col("high") - F.col("low")) / F.col("high")
    verdict = (
        F.when(F.col("aborted"), "VARIABLE (abort)").when(~F.col("floor"), "VARIABLE (floor not reached)").when(F.col("high") == 0, "VARIABLE (zero tweets)")
        .when(spread > RUN_SPREAD, "VARIABLE (count spread)").when(F.col("overlap") < RUN_OVERLAP, "VARIABLE (overlap)").otherwise("STABLE")
    )
    return flags.join(least, "handle", "left").select("handle", "high", "low", F.round("overlap", 6).alias("overlap"), verdict.alias("verdict"))


def calendar_gaps(log: DataFrame, providers: list[str]) -> DataFrame:
    """Pending rows for every account, day and provider of the account's span that the ledger lacks."""
    span = log.groupBy("handle").agg(F.min("date").alias("a"), F.max("date").alias("b"))
    days = span.select("handle", F.explode(F.sequence("a", "b")).alias("date")).select("handle", "date", F.explode(F.array(*map(F.lit, providers))).alias("provider"))
    return days.join(log, ["handle", "date", "provider"], "left_anti").withColumn("status", F.lit("pending"))


def mismatch_register(log: DataFrame, known: DataFrame) -> DataFrame:
    """Account days that disagree and aren't registered yet, with each provider's count."""
    bad = reconcile(log).where("day_verdict = 'mismatch'").join(known, ["handle", "date"], "left_anti")
    counts = log.groupBy("handle", "date").pivot("provider", ["A", "B"]).agg(F.max("tweets_fetched"))
    return counts.join(bad.select("handle", "date"), ["handle", "date"]).withColumnsRenamed({"A": "n_a", "B": "n_b"})


def decode_snowflake(tweet_id: Column) -> Column:
    """The UTC time in a tweet id, to the second."""
    return F.date_trunc("second", F.timestamp_millis(F.shiftright(tweet_id, 22) + F.lit(1288834974657)))


def tweet_type(is_retweet: Column, is_quote: Column, is_reply: Column) -> Column:
    return F.when(is_retweet, "retweet").when(is_quote, "quote").when(is_reply, "reply").otherwise("original")


def cashtags(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"(\$[A-Z]{1,5})\b"), F.lit(1)))


def account_profiles(tweets: DataFrame) -> DataFrame:
    """Per account: tweets, those with cashtags, their share."""
    with_tags = F.size(cashtags(F.col("text"))) > 0
    g = tweets.groupBy("handle").agg(F.count("*").alias("tweets"), F.count_if(with_tags).alias("with_ticker"))
    return g.withColumn("share", F.col("with_ticker") / F.col("tweets"))


def ticker_mentions(tweets: DataFrame) -> DataFrame:
    """Mentions per account and cashtag, once a tweet."""
    return tweets.select("handle", F.explode(cashtags(F.col("text"))).alias("ticker")).groupBy("handle", "ticker").agg(F.count("*").alias("mentions"))


def sector_concentration(mentions: DataFrame, sectors: DataFrame) -> DataFrame:
    """Mentions per sector, overall (handle null) and per account; tickers without a sector as 'unmapped'."""
    j = mentions.join(sectors, "ticker", "left").withColumn("sector", F.coalesce("sector", F.lit("unmapped")))
    return j.groupingSets([["sector"], ["handle", "sector"]], "handle", "sector").agg(F.sum("mentions").alias("mentions"), F.array_join(F.array_sort(F.collect_set("ticker")), ",").alias("tickers"))


def cashtag_sample(tweets: DataFrame, n: int = 10) -> DataFrame:
    """The n tweets with the most cashtags, a report."""
    return tweets.select("tweet_id", F.size(cashtags(F.col("text"))).alias("tags")).orderBy(F.desc("tags"), "tweet_id").limit(n)


def cashtag_samples(tweets: DataFrame, n: int = 10) -> DataFrame:
    """Each account's n tweets with the most cashtags, the rest filled up by id: (handle, tweet_id, tags, rank)."""
    counted = tweets.select("handle", "tweet_id", F.size(F.regexp_extract_all("text", F.lit(r"(\$[A-Z]{1,5})"), F.lit(1))).alias("tags"))
    return last_rows(counted, ["handle"], n, F.desc("tags"), F.col("tweet_id"))


def daily_counts(tweets: DataFrame) -> DataFrame:
    """Tweets by account, day and provider."""
    return tweets.groupBy("handle", F.to_date("created_at").alias("date"), "provider").agg(F.count("*").alias("tweets_fetched"))
