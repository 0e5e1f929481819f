"""Merges without a lakehouse: each takes the stored and the new rows and gives the merged table to write.

All are idempotent: merging the same batch twice equals merging it once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def last_wins(old: DataFrame, new: DataFrame, keys: list[str], order: str | None = None) -> DataFrame:
    """New rows replace stored ones of the same key; within the batch the greatest ``order`` wins, else the greatest row."""
    others = [c for c in old.columns if c not in keys]
    rank = F.struct(*([order] if order else []), *others)
    both = old.select(*old.columns, F.lit(0).alias("__v")).unionByName(new.select(*old.columns, F.lit(1).alias("__v")))
    return both.groupBy(keys).agg(F.max_by(F.struct(*others), F.struct("__v", rank)).alias("r")).select(*keys, "r.*").select(*old.columns)


def first_wins(old: DataFrame, new: DataFrame, key: str, seen: str, order: str) -> DataFrame:
    """Stored rows stay; only ``seen`` moves on. Of new rows of a key the smallest ``order`` is stored."""
    others = [c for c in old.columns if c not in (key, seen)]
    both = old.select(*old.columns, F.lit(0).alias("__v")).unionByName(new.select(*old.columns, F.lit(1).alias("__v")))
    g = both.groupBy(key).agg(F.min_by(F.struct(*others), F.struct("__v", order)).alias("r"), F.max(seen).alias(seen), F.min("__v").alias("__v"))
    return g.select(key, "r.*", seen, (F.col("__v") == 1).alias("inserted"))


def provenance(old: DataFrame, new: DataFrame) -> DataFrame:
    """First and last time that each provider saw each tweet."""
    return old.unionByName(new).groupBy("tweet_id", "provider").agg(F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"))


def column_wise(old: DataFrame, new: DataFrame, key: str, owned: list[str], kept: list[str]) -> DataFrame:
    """The writer owns some columns and leaves the others as they are; a row without a stored one has nulls there."""
    o, n = old.alias("o"), new.alias("n")
    j = o.join(n, F.col(f"o.{key}") == F.col(f"n.{key}"), "full")
    mine = lambda c: F.when(F.col(f"n.{key}").isNotNull(), F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c)
    return j.select(F.coalesce(f"o.{key}", f"n.{key}").alias(key), *map(mine, owned), *(F.col(f"o.{c}").alias(c) for c in kept))


def refresh_posts(old: DataFrame, new: DataFrame, kept: tuple[str, ...] = ()) -> DataFrame:
    """Counts are replaced, texts only by texts that aren't empty; first_seen stays, and so do the columns ``kept``."""
    j = old.alias("o").join(new.alias("n"), "post_id", "full")
    there = F.col("n.score").isNotNull()
    text = lambda c: F.when(F.coalesce(F.col(f"n.{c}"), F.lit("")) != "", F.col(f"n.{c}")).otherwise(F.coalesce(f"o.{c}", f"n.{c}")).alias(c)
    count = lambda c: F.when(there, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c)
    return j.select("post_id", text("title"), text("body"), count("score"), count("num_comments"), F.coalesce("o.first_seen", "n.first_seen").alias("first_seen"), F.greatest("o.last_seen", "n.last_seen").alias("last_seen"), *(F.coalesce(f"o.{c}", f"n.{c}").alias(c) for c in kept))


def link_precedence(links: DataFrame) -> DataFrame:
    """One row per post and ticker: the subreddit's own link beats one by search."""
    return links.groupBy("post_id", "ticker").agg(F.min_by(F.struct("via", "matched"), F.struct(F.col("via") != "subreddit", "via", "matched")).alias("r")).select("post_id", "ticker", "r.*")


def merge_links(old: DataFrame, new: DataFrame) -> DataFrame:
    """A stored link by the subreddit stays; otherwise a new one replaces the stored one, by the subreddit before by search."""
    both = old.withColumn("__new", F.lit(False)).unionByName(new.withColumn("__new", F.lit(True)))
    feed = F.col("via") == "subreddit"
    order = F.struct(~feed, F.col("__new") != ~feed, "via", "matched")  # of feeds the stored one first, of searches the new one
    others = [c for c in old.columns if c not in ("post_id", "ticker")]
    return both.groupBy("post_id", "ticker").agg(F.min_by(F.struct(*others), order).alias("r")).select("post_id", "ticker", "r.*").select(*old.columns)


def merge_digests(old: DataFrame, new: DataFrame) -> DataFrame:
    """Strictly newer replaces older, but what isn't ok never replaces ok."""
    j = old.alias("o").join(new.alias("n"), ["ticker", "digest_date"], "full")
    new_wins = F.col("o.created_at").isNull() | ((F.col("n.created_at") > F.col("o.created_at")) & ((F.col("n.status") == "ok") | (F.col("o.status") != "ok")))
    pick = lambda c: F.when(new_wins & F.col("n.created_at").isNotNull(), F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c)
    return j.select("ticker", "digest_date", pick("created_at"), pick("status"))


def prune_posts(posts: DataFrame, now: Column) -> DataFrame:
    """Posts that stay: younger than 90 days, and than 14 if few care."""
    age = F.datediff(now, F.to_date("created_at"))
    return posts.where(~((age > 90) | ((age > 14) & (F.col("score") < 5) & (F.col("num_comments") < 3))))


def cascade(children: DataFrame, kept: DataFrame, key: str) -> DataFrame:
    return children.join(kept.select(key), key, "left_semi")


def keep_since(df: DataFrame, col: str, first: Column) -> DataFrame:
    return df.where(F.col(col) >= first)


def backfill(df: DataFrame, target: str, source: str) -> DataFrame:
    return df.withColumn(target, F.coalesce(target, source))


def score_log(sightings: DataFrame) -> DataFrame:
    """Sightings at which a post's score or comment count differs from the sighting before."""
    w = Window.partitionBy("post_id").orderBy("seen_at", "event_id")
    now, before = F.struct("score", "num_comments"), F.lag(F.struct("score", "num_comments")).over(w)
    return sightings.withColumn("changed", ~now.eqNullSafe(before)).where("changed").drop("changed")


def merge_lists(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """For keys in the new list: its entries, then manual stored ones not among them; other keys untouched.
    Entries are unique without regard to case, in order. Columns: key, position, name, source."""
    touched = new.select(key).distinct()
    manual = old.join(touched, key, "left_semi").where("source = 'manual'").select(key, F.lit(1).alias("o"), "position", "name", "source")
    both = new.select(key, F.lit(0).alias("o"), "position", "name", "source").union(manual)
    first = F.row_number().over(Window.partitionBy(key, F.lower("name")).orderBy("o", "position"))
    both = both.withColumn("__first", first).where("__first = 1")
    place = F.row_number().over(Window.partitionBy(key).orderBy("o", "position"))
    merged = both.select(key, place.alias("position"), "name", "source")
    return merged.unionByName(old.join(touched, key, "left_anti").select(key, F.col("position").cast("int").alias("position"), "name", "source"))


def merge_universe(base: DataFrame, user: DataFrame) -> DataFrame:
    """Base memberships, then user ones of known themes with a settled status that aren't members yet."""
    themes = base.select("sector").distinct()
    ok = user.where(F.col("status").isin("complete", "pending")).join(themes, "sector", "left_semi").join(base, ["sector", "ticker"], "left_anti")
    return base.select("sector", "ticker").unionByName(ok.select("sector", "ticker").distinct())


def dedupe(df: DataFrame, keys: list[str], order: str, last: bool = False) -> DataFrame:
    """One row a key: the first or the last by ``order``."""
    others = F.struct(*(c for c in df.columns if c not in keys))
    pick = F.max_by(others, order) if last else F.min_by(others, order)
    return df.groupBy(keys).agg(pick.alias("r")).select(*keys, "r.*")
