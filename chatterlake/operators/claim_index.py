"""Known claims as a stored index: a claim's text is tokenised by the run that brings it, and never again.

Two claims of Jaccard similarity SIMILAR or more share one of the first tokens of each, when all claims put their tokens
in one order; so many that the rest couldn't make up for them. The index holds these first tokens only. The order is by
rarity and settled when the index is made: tokens that were common then come last, which a stored list says; all others
by their hash, new ones too. So a later run's tokens are ordered as those stored. Whether a token is common is asked of a
filter of that list, which may take a few others for common ones: any order will do, if it is the same for all. The index
holds tokens as hashes; two tokens of one hash make a pair more, which the comparison of all tokens drops.

Disk is what an index costs at scale. A run's claims are written once, as they come, and are read from there. A wording has one row of
first tokens, as hashes of 31 bits, bucketed by ticker and fingerprint. What is stored passes a filter of what a run asks for, and
only what is let through is dealt out by first token, or brings its tokens. A token that has become so frequent that
it would make too many pairs is a hub: its pairs are dealt out by salts.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chatterlake.operators.forum import HUB_PAIRS, constant_token_filter, filter_longs, hash_held, hub_join, may_hold, token_filter
from chatterlake.sources import landed

#: A claim at or above this Jaccard similarity to a known one is known.
SIMILAR = 0.72
#: A token is common that so many claims of the first run hold, or this share of them.
COMMON, COMMON_SHARE = 50, 0.0005
CLAIMS = "ticker string, fingerprint string, claim_id long, first_seen_at timestamp, last_seen_at timestamp, tokens array<string>"
FIRST_TOKENS = "ticker string, fingerprint string, n int, bits long, firsts array<int>"


def of_keys(rows: DataFrame, wanted: DataFrame, *keys: str) -> DataFrame:
    """The rows that have the keys of a saved table's row. Where that is too long to be sent to every task, rows pass a filter of its keys before
    they are shuffled."""
    if wanted.limit(landed.BROADCAST_ROWS + 1).count() <= landed.BROADCAST_ROWS:
        return rows.join(F.broadcast(wanted), [*keys], "left_semi")
    return filtered(rows, wanted, *keys).join(wanted, [*keys], "left_semi")


def filtered(rows: DataFrame, wanted: DataFrame, *keys: str) -> DataFrame:
    """The rows that may have the keys of a saved table's row: all that have, and a few others."""
    longs = filter_longs(wanted.count())
    return rows.where(may_hold(token_filter(wanted.select(F.xxhash64(*keys).alias("token")), longs), F.xxhash64(*keys), longs))


@dataclass
class ClaimIndex:
    spark: SparkSession
    path: str
    buckets: int = 32

    def _table(self, name: str, schema: str, buckets: str = "") -> str:
        """The table's name in the session, made known where it isn't: its files lie under the path."""
        known_as = f"{name}_{hashlib.sha1(self.path.encode()).hexdigest()[:12]}"
        self.spark.sql(f"CREATE TABLE IF NOT EXISTS {known_as} ({schema}) USING parquet OPTIONS (compression 'zstd') {buckets} LOCATION '{self.path}/{name}'")
        return known_as

    @property
    def claims(self) -> str:
        return self._table("claims", CLAIMS)

    @property
    def first_tokens(self) -> str:
        return self._table("first_tokens", FIRST_TOKENS, f"CLUSTERED BY (ticker, fingerprint) INTO {self.buckets} BUCKETS")

    def common_tokens(self, made_from: DataFrame | None = None) -> DataFrame:
        """Tokens that were common in the first run; made from its claims."""
        path = f"{self.path}/common"
        place = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        if not place.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(place):
            if made_from is None:
                return self.spark.createDataFrame([], "token string")
            least = max(COMMON, int(COMMON_SHARE * made_from.count()))
            made_from.select(F.explode("tokens").alias("token")).groupBy("token").count().where(F.col("count") >= least).select("token").write.parquet(path)
        return self.spark.read.schema("token string").parquet(path)

    def _listed(self, claims: DataFrame, *keep: str) -> DataFrame:
        """A claim's first tokens in the index's order, as numbers, and a bit of 64 set for each of all its tokens: (ticker, n, bits, firsts) and the
        columns kept."""
        common = constant_token_filter(self.common_tokens())
        # 31 bits of a token's hash stand for it, with the sign of its place: below zero unless common
        order = lambda h: (h.bitwiseAND(2**31 - 1) - F.when(hash_held(common, h), 0).otherwise(2**31)).cast("int")
        hashed = claims.select("ticker", *keep, F.size("tokens").alias("n"), F.transform("tokens", lambda w: F.xxhash64(w)).alias("hashes"))
        bits = F.aggregate("hashes", F.lit(0).cast("long"), lambda bits, h: bits.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftright(h, 40).bitwiseAND(63).cast("int"))))
        ordered = hashed.select("ticker", *keep, "n", bits.alias("bits"), F.sort_array(F.transform("hashes", order)).alias("ordered"))
        return ordered.select("ticker", *keep, "n", "bits", F.slice("ordered", F.lit(1), F.col("n") - F.ceil(F.col("n") * SIMILAR - 1e-9).cast("int") + 1).alias("firsts"))

    def _firsts(self, claims: DataFrame, *keep: str) -> DataFrame:
        """First tokens in the index's order, with their place: (ticker, token, n, bits, place) and the columns kept."""
        return self._listed(claims, *keep).select("ticker", *keep, "n", "bits", F.posexplode("firsts").alias("place", "token")).select("ticker", "token", *keep, "n", "bits", "place")

    def append(self, claims: DataFrame) -> None:
        """Store a run's claims: ticker, fingerprint, claim_id, first_seen_at, last_seen_at, tokens. Only wordings that have no entry yet get
        one, so appending claims again, or after a run that broke off, changes no answer."""
        rows, stored = claims.select("ticker", "fingerprint", "claim_id", "first_seen_at", "last_seen_at", "tokens"), self.spark.table(self.claims)
        if stored.limit(1).count():
            rows = landed.saved(rows, "claims")
            rows.write.insertInto(self.claims)
        else:  # the first run's claims are the table
            rows.write.insertInto(self.claims)
            rows = self.spark.table(self.claims)
        self.common_tokens(rows)
        wordings = self._listed(rows, "fingerprint").where("size(firsts) > 0").repartition(self.buckets, "ticker", "fingerprint").distinct()
        entries = self.spark.table(self.first_tokens)
        if entries.limit(1).count():
            wordings = landed.saved(wordings.join(entries, ["ticker", "fingerprint"], "left_anti"), "fresh")
        wordings.select("ticker", "fingerprint", "n", "bits", "firsts").write.insertInto(self.first_tokens)

    def known(self, wordings: DataFrame, since: Column | None = None) -> DataFrame:
        """Stored claims of some wordings (ticker, fingerprint), of those seen since a time, if one is given."""
        rows = self.spark.table(self.claims)
        rows = rows if since is None else rows.where(F.col("last_seen_at") >= since)
        return of_keys(rows, landed.saved(wordings.select("ticker", "fingerprint").distinct(), "wordings"), "ticker", "fingerprint")

    def candidate_pairs(self, new: DataFrame) -> DataFrame:
        """(ticker, new_id, fingerprint) of pairs that may be as similar as SIMILAR: they share a first token, their sizes allow it, and so do
        the tokens that are left after it on either side and the bits of all tokens. ``new``: ticker, claim_id, tokens."""
        mine = landed.saved(self._firsts(new, "claim_id").select("ticker", "token", F.col("claim_id").alias("new_id"), F.col("n").alias("na"), F.col("bits").alias("ba"), F.col("place").alias("i")), "new-tokens")
        keys = ["ticker", "token"]
        stored = self.spark.table(self.first_tokens).select("ticker", "fingerprint", F.col("n").alias("nb"), F.col("bits").alias("bb"), F.posexplode("firsts").alias("j", "token"))
        stored = filtered(stored, landed.saved(mine.select(*keys).distinct(), "asked-tokens"), *keys)
        counts = mine.groupBy(*keys).agg(F.count("*").alias("na")).join(stored.groupBy(*keys).agg(F.count("*").alias("nb")), keys)
        hubs = landed.saved(counts.where(F.col("na") * F.col("nb") > HUB_PAIRS).select(*keys), "hub-tokens")
        if hubs.limit(1).count():
            few = landed.small(hubs)
            met = mine.join(few, keys, "left_anti").join(stored, keys).unionByName(hub_join(mine.join(few, keys, "left_semi"), stored.join(few, keys, "left_semi"), keys, HUB_PAIRS))
        else:
            met = mine.join(stored, keys)
        shared = F.ceil(SIMILAR / (1 + SIMILAR) * (F.col("na") + F.col("nb")) - 1e-9)
        sizes = F.least("na", "nb") >= F.greatest("na", "nb") * SIMILAR - 1e-9
        left = F.least(F.col("na") - F.col("i"), F.col("nb") - F.col("j"))  # the token met and those after it
        lacking = lambda a, b: F.bit_count(F.col(a).bitwiseAND(F.bitwise_not(b)))  # noqa: E731  so many tokens at least that the other side lacks
        most = F.least(F.col("na") - lacking("ba", "bb"), F.col("nb") - lacking("bb", "ba"))
        return met.where(sizes & (left >= shared) & (most >= shared)).select("ticker", "new_id", "fingerprint").distinct()

    def novelty(self, new: DataFrame, since: Column | None = None) -> DataFrame:
        """(ticker, claim_id, status, known_id) of a run's claims: ticker, claim_id, fingerprint, tokens. Known by fingerprint, else by the
        most similar known claim, the newest and then smallest of equals; else a candidate."""
        new = landed.saved(new.select("ticker", "claim_id", "fingerprint", "tokens"), "run")
        exact = self.known(new, since).groupBy("ticker", "fingerprint").agg(F.min("claim_id").alias("exact_id"))
        n = landed.saved(new.join(exact, ["ticker", "fingerprint"], "left"), "new-claims")
        rest = landed.saved(n.where("exact_id is null").groupBy("ticker", "tokens").agg(F.min("claim_id").alias("claim_id")), "new-wordings")
        pairs = landed.saved(self.candidate_pairs(rest), "pairs")
        # the newest claim of a wording and of these the least, in two aggregates of numbers, which are hashed
        times = self.known(pairs, since).groupBy("ticker", "fingerprint", F.col("tokens").alias("tb"), "first_seen_at").agg(F.min("claim_id").alias("least"))
        once = times.groupBy("ticker", "fingerprint", "tb").agg(F.max_by("least", "first_seen_at").alias("known_id"), F.max("first_seen_at").alias("first_seen_at"))
        both = pairs.join(once, ["ticker", "fingerprint"]).join(rest.select("ticker", F.col("claim_id").alias("new_id"), F.col("tokens").alias("ta")), ["ticker", "new_id"])
        shared = F.size(F.array_intersect("ta", "tb"))
        near = both.select("ticker", "new_id", "known_id", "first_seen_at", (shared / (F.size("ta") + F.size("tb") - shared)).alias("similarity")).where(F.col("similarity") >= SIMILAR)
        best = near.groupBy("ticker", "new_id").agg(F.max_by("known_id", F.struct("similarity", "first_seen_at", -F.col("known_id"))).alias("near_id"))
        named = rest.join(best.withColumnRenamed("new_id", "claim_id"), ["ticker", "claim_id"]).select("ticker", "tokens", "near_id")
        j = n.join(named, ["ticker", "tokens"], "left")
        known_id = F.coalesce("exact_id", "near_id")
        return j.select("ticker", "claim_id", F.when(known_id.isNotNull(), "known").otherwise("candidate").alias("status"), known_id.alias("known_id"))
