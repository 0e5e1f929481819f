"""Claims: identity within a batch, novelty against known claims, corroboration, ranking, storage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chatterlake.functions.text import claim_tokens, fingerprint
from chatterlake.operators.claim_index import SIMILAR, ClaimIndex, of_keys
from chatterlake.operators.rollups import ranked_within
from chatterlake.sources import landed

#: Days that a claim is known after it was seen last.
LOOK_BACK = 90
#: Claims of a wording that one task brings to the wording's citations.
CLAIMS_A_LIST = 1000


def batch_claims(rows: DataFrame) -> DataFrame:
    """One claim per ticker, kind and fingerprint: first wording, distinct citations, number of videos.
    ``rows``: ticker, kind, text, position, video_id, second, channel_id."""
    r = rows.withColumn("tokens", claim_tokens(F.col("text")))
    r = r.withColumn("fingerprint", fingerprint(F.col("kind"), F.col("tokens")))
    return r.groupBy("ticker", "kind", "fingerprint").agg(
        F.min_by("text", "position").alias("text"), F.first("tokens").alias("tokens"), F.min("position").alias("position"),
        F.array_sort(F.collect_set(F.struct("video_id", "second"))).alias("citations"), F.count_distinct("video_id").alias("source_count"), F.collect_set("channel_id").alias("channels"),
    )


def cited(citations: DataFrame) -> DataFrame:
    """(ticker, fingerprint, citations, channels): a wording's sorted citations, one row a wording."""
    return citations.groupBy("ticker", "fingerprint").agg(F.sort_array(F.collect_set(F.struct("video_id", "second"))).alias("citations"), F.collect_set("channel_id").alias("channels"))


def known_claims(claims: DataFrame, lists: DataFrame, now: Column, days: int = LOOK_BACK) -> DataFrame:
    """Claims last seen in the look-back with their wording's row of ``lists`` (as of ``cited``, or what was made of it), null where there is none.

    All claims of a wording have the whole list, so what is made of lists is best made before: once a wording, not once a
    claim. A wording of many claims is dealt out over tasks. Of a task's rows those of the most repeated wordings, so the longest,
    come first: a writer that guesses from the rows it has had how many more it may keep in memory then never guesses too many."""
    recent, keys = claims.where(F.to_date("last_seen_at") >= F.date_sub(F.to_date(now), days)), ["ticker", "fingerprint"]
    shares = F.ceil(F.count("*") / CLAIMS_A_LIST).cast("int")
    hubs = landed.small(landed.saved(recent.groupBy(*keys).agg(shares.alias("__shares")).where("__shares > 1"), "hubs"))
    marked = lambda df: df.join(hubs, keys, "left").withColumn("__shares", F.coalesce("__shares", F.lit(1))).withColumn("__first", -F.col("__shares"))
    each = marked(lists).withColumn("__share", F.explode(F.sequence(F.lit(0), F.col("__shares") - 1))).drop("__shares")
    asking = marked(recent).withColumn("__share", F.pmod(F.xxhash64(*(c for c in recent.columns if c not in keys)), F.col("__shares")).cast("int")).drop("__shares")
    # merged, so that a task's rows stand in the order of the keys; an outer join gives a claim's row at once, an inner one would gather those of a list
    return each.hint("merge").join(asking, ["__first", *keys, "__share"], "right").drop("__first", "__share")


def similar_claims(new: DataFrame, known: DataFrame) -> DataFrame:
    """(ticker, new_id, known_id, similarity) of pairs of a ticker at SIMILAR or more. Both: ticker, claim_id, tokens.

    A known claim as similar as that lacks few of a new claim's n tokens, so it holds one of any n - ceil(SIMILAR n) + 1
    of them. The rarest are taken, by how many known claims hold them: known claims meet new ones by those tokens only,
    and pairs of too different sizes are dropped before their tokens are compared."""
    each = known.select("ticker", "claim_id", F.size("tokens").alias("nb"), F.explode("tokens").alias("token"))
    mine = new.select("ticker", "claim_id", F.size("tokens").alias("na"), F.explode("tokens").alias("token"))
    wanted = mine.select("ticker", "token").distinct()
    df = each.join(wanted, ["ticker", "token"], "left_semi").groupBy("ticker", "token").agg(F.count("*").alias("df"))
    rarest = Window.partitionBy("ticker", "claim_id").orderBy("df", "token")  # the tokens of one claim
    keyed = mine.join(df, ["ticker", "token"], "left").fillna(0, ["df"]).withColumn("k", F.row_number().over(rarest))
    keyed = keyed.where((F.col("k") <= F.col("na") - F.ceil(F.col("na") * SIMILAR - 1e-9) + 1) & (F.col("df") > 0)).select("ticker", "token", F.col("claim_id").alias("new_id"), "na")
    near = F.least("na", "nb") >= F.greatest("na", "nb") * SIMILAR - 1e-9
    pairs = each.withColumnRenamed("claim_id", "known_id").join(keyed, ["ticker", "token"]).where(near).select("ticker", "new_id", "known_id").distinct()
    pairs = pairs.join(new.select("ticker", F.col("claim_id").alias("new_id"), F.col("tokens").alias("ta")), ["ticker", "new_id"])
    pairs = pairs.join(known.select("ticker", F.col("claim_id").alias("known_id"), F.col("tokens").alias("tb")), ["ticker", "known_id"])
    return pairs.select("ticker", "new_id", "known_id", (F.size(F.array_intersect("ta", "tb")) / F.size(F.array_union("ta", "tb"))).alias("similarity")).where(F.col("similarity") >= SIMILAR)


def novelty(new: DataFrame, known: DataFrame) -> DataFrame:
    """(ticker, claim_id, status, known_id): known by fingerprint, else by the most similar claim, the newest and then
    smallest of equals; else a candidate.

    Claims of the same tokens are one on either side before any pair is made, so repeated claims don't meet each other."""
    # one row for a known claim's tokens, saved: it is read for exact matches, for counts of tokens and for pairs
    once = known.groupBy("ticker", "fingerprint").agg(F.min("claim_id").alias("exact_id"), F.max(F.struct("first_seen_at", (-F.col("claim_id")).alias("minus"), "tokens")).alias("k"))
    once = landed.saved(once.select("ticker", "fingerprint", "exact_id", "k.first_seen_at", (-F.col("k.minus")).alias("claim_id"), "k.tokens"), "known-claims")
    n = landed.saved(new.join(once.select("ticker", "fingerprint", "exact_id"), ["ticker", "fingerprint"], "left"), "new-claims")
    rest = n.where("exact_id is null").groupBy("ticker", "tokens").agg(F.min("claim_id").alias("claim_id"))
    newest = once.select("ticker", "tokens", "claim_id", "first_seen_at")
    near = similar_claims(rest, newest).join(newest.select("ticker", F.col("claim_id").alias("known_id"), "first_seen_at"), ["ticker", "known_id"])
    best = near.groupBy("ticker", "new_id").agg(F.max_by("known_id", F.struct("similarity", "first_seen_at", -F.col("known_id"))).alias("near_id"))
    named = rest.join(best.withColumnRenamed("new_id", "claim_id"), ["ticker", "claim_id"]).select("ticker", "tokens", "near_id")
    j = n.join(named, ["ticker", "tokens"], "left")
    known_id = F.coalesce("exact_id", F.when(F.col("exact_id").isNull(), F.col("near_id")))
    return j.select("ticker", "claim_id", F.when(known_id.isNotNull(), "known").otherwise("candidate").alias("status"), known_id.alias("known_id"))


def corroborated() -> Column:
    """A claim known before, repeated by a channel that its history lacks; a history with an unknown channel says nothing.
    Of rows with channels and known_channels."""
    return F.col("known_channels").isNotNull() & (F.size("known_channels") > 0) & ~F.array_contains("known_channels", "") & (F.size(F.array_except("channels", "known_channels")) > 0)


def claim_rank(status: Column, corroboration: Column) -> Column:
    """New, developing, known but corroborated anew, known; claims of a place follow by their sources, most first."""
    return F.when(status == "new", 0).when(status == "developing", 1).when(corroboration, 2).otherwise(3)


def merge_claims(old: DataFrame, new: DataFrame) -> DataFrame:
    """First text and first_seen stay, novelty and last_seen move: both (ticker, fingerprint, text, novelty, seen_at)."""
    both = old.unionByName(new)
    return both.groupBy("ticker", "fingerprint").agg(F.min_by("text", "seen_at").alias("text"), F.max_by("novelty", "seen_at").alias("novelty"), F.min("seen_at").alias("first_seen_at"), F.max("seen_at").alias("last_seen_at"))


def valid_citations(rows: DataFrame, videos: DataFrame) -> DataFrame:
    """Citations of videos of the run; what has none left is gone."""
    return rows.join(videos.select("video_id"), "video_id", "left_semi")


def novelty_pass(batch: DataFrame, known: DataFrame, citations: DataFrame, now: Column, index: ClaimIndex | None = None) -> DataFrame:
    """A batch's claims judged and ranked: (ticker, claim_id, fingerprint, text, source_count, status, place, rank).

    ``batch``: as of ``batch_claims``, with claim_id; ``known``: as of ``known_claims``; ``citations``: as of ``cited``; ``index``: the stored index
    of ``known``, if there is one. Both are read for the claims that the batch repeats only. A claim known by
    its fingerprint or a similar one is new again, to a degree, where a channel repeats it that its history lacks. Places:
    new, corroborated, known; within a place the claims with most sources come first."""
    recent = known.where(F.to_date("last_seen_at") >= F.date_sub(F.to_date(now), LOOK_BACK))
    batch = landed.saved(batch, "batch")
    mine = batch.select("ticker", "claim_id", "fingerprint", "tokens")
    if index is None:
        judged = novelty(mine, recent.select("ticker", "claim_id", "fingerprint", "tokens", "first_seen_at"))
    else:  # it holds all known claims
        judged = index.novelty(mine, F.date_sub(F.to_date(now), LOOK_BACK).cast("timestamp"))
    judged = landed.saved(judged, "judged")
    asked = landed.saved(of_keys(recent, landed.saved(judged.select(F.col("known_id").alias("claim_id")).distinct(), "known-ids"), "claim_id").select("ticker", "fingerprint", "claim_id", "last_seen_at"), "asked")
    cites = of_keys(citations, landed.saved(asked.select("ticker", "fingerprint").distinct(), "asked-wordings"), "ticker", "fingerprint")
    history = known_claims(asked, cited(cites).drop("citations"), now).select(F.col("claim_id").alias("known_id"), F.col("channels").alias("known_channels"))
    j = batch.join(judged, ["ticker", "claim_id"]).join(history, "known_id", "left")
    status = F.when(F.col("status") == "candidate", "new").otherwise(F.col("status"))
    rows = j.select("ticker", "claim_id", "fingerprint", "text", "source_count", status.alias("status"), claim_rank(status, F.coalesce(corroborated(), F.lit(False))).alias("place"))
    return ranked_within(rows, ["ticker"], [F.col("place"), F.desc("source_count"), F.col("claim_id")])


def with_channels(citations: DataFrame, channels: DataFrame) -> DataFrame:
    """Adds the channel of each citation's video, '' where it isn't known."""
    return citations.join(channels, "video_id", "left").withColumn("channel", F.coalesce("channel", F.lit("")))
