"""The forum's archive as tables by day, brought up to date a batch at a time: posts, links to tickers, the log of
scores, comments and when they were fetched. Every table is kept under the day of its post, so a batch touches the same
few folders in all of them, and posts take what belongs to them along when they go.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date, datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chatterlake.operators import forum, merges
from chatterlake.sources import landed
from chatterlake.sources.daystore import DayTable

KEEP_DAYS, QUIET_DAYS = 90, 14
TABLES = {
    "posts": "post_id long, subreddit string, author string, created_at timestamp, title string, body string, score long, num_comments long, first_seen timestamp, last_seen timestamp",
    "links": "post_id long, ticker string, via string, matched string",
    "scores": "post_id long, seen_at timestamp, score long, num_comments long",
    "comments": "post_id long, comment_id long, parent_id long, author string, body string, score long, fetched_at timestamp",
    "fetches": "post_id long, fetched_at timestamp",
}


@dataclass
class Report:
    new: int
    updated: int
    comments: int
    pruned: int


def archive(spark: SparkSession, path: str) -> dict[str, DayTable]:
    return {name: DayTable(spark, f"{path}/{name}", schema) for name, schema in TABLES.items()}


def new_scores(stored: DataFrame, batch: DataFrame) -> DataFrame:
    """Rows of a batch whose counts differ from the stored ones: the log's next rows."""
    before = stored.select("post_id", F.col("last_seen").alias("seen_at"), F.lit(0).alias("event_id"), "score", "num_comments", "day")
    now = batch.select("post_id", F.col("last_seen").alias("seen_at"), F.lit(1).alias("event_id"), "score", "num_comments", "day")
    return merges.score_log(before.unionByName(now)).where("event_id = 1").drop("event_id")


def prune(tables: dict[str, DayTable], now: datetime) -> int:
    """Drop what retention lets go; returns the number of posts that went.

    Days past the last one are dropped as folders. Of younger days those are rewritten that have quiet posts past their
    time, and there the other tables keep what belongs to posts that stay."""
    posts, age = tables["posts"], lambda d: (now.date() - d).days
    gone = [d for d in posts.days() if age(d) > KEEP_DAYS]
    n = posts.read(gone).count()
    for table in tables.values():
        table.drop([d for d in table.days() if age(d) > KEEP_DAYS])
    aging = posts.read([d for d in posts.days() if age(d) > QUIET_DAYS])
    kept = merges.prune_posts(aging, F.lit(now.date()))
    left = {r["day"]: r["n"] for r in kept.groupBy("day").agg(F.count("*").alias("n")).collect()}  # days
    doomed = {r["day"]: r["n"] - left.get(r["day"], 0) for r in aging.groupBy("day").agg(F.count("*").alias("n")).collect()}
    edge = [d for d, lost in doomed.items() if lost]
    if not edge:
        return n
    stays = posts.replace(kept.where(F.col("day").isin(edge)), edge).select("post_id")
    for name, table in tables.items():
        if name != "posts" and set(table.days()) & set(edge):
            table.replace(merges.cascade(table.read(edge), stays, "post_id"), edge)
    return n + sum(doomed.values())


def ingest(tables: dict[str, DayTable], batch: DataFrame, links: DataFrame, comments: DataFrame, now: datetime) -> Report:
    """One run: what is linked to a ticker is stored or refreshed, changed counts are logged, notable posts get their top
    comments, and what is past its time goes.

    ``batch``: post_id, subreddit, author, created_at, title, body, score, num_comments; ``links``: post_id, ticker, via,
    matched; ``comments``: those that can be fetched, with post_id."""
    at = F.lit(now).cast("timestamp")
    rows = batch.join(links.select("post_id").distinct(), "post_id", "left_semi")
    rows = landed.saved(rows.select("*", at.alias("first_seen"), at.alias("last_seen"), F.to_date("created_at").alias("day")), "batch")
    days = [r["day"] for r in rows.select("day").distinct().collect()]
    before = landed.saved(tables["posts"].read(days).join(rows.select("post_id"), "post_id", "left_semi").select("post_id", "last_seen", "score", "num_comments", "day"), "known")
    tables["posts"].merge(rows, lambda old, new: merges.refresh_posts(old, new, ("subreddit", "author", "created_at", "day")))
    log = new_scores(before, rows)
    tables["scores"].merge(log, lambda old, new: merges.last_wins(old, new.select(*old.columns), ["post_id", "seen_at"]))
    dated = links.join(rows.select("post_id", "day"), "post_id")
    tables["links"].merge(dated, merges.merge_links)
    updated = before.count()

    fetched = tables["fetches"].read().groupBy("post_id").agg(F.max("fetched_at").alias("fetched_at"))
    known = tables["posts"].read().select("post_id", "created_at", "score", "num_comments", "day")
    due = landed.saved(forum.need_comments(known.join(fetched, "post_id", "left"), at).select("post_id", "day"), "due")
    said = forum.top_comments(comments.join(F.broadcast(due), "post_id")).withColumn("fetched_at", at).drop("rank")  # due: 100 at most
    said = landed.saved(said, "said")
    tables["comments"].merge(said, lambda old, new: merges.last_wins(old, new, ["comment_id"]))
    tables["fetches"].merge(due.withColumn("fetched_at", at), lambda old, new: merges.last_wins(old, new, ["post_id"], "fetched_at"))
    return Report(new=rows.count() - updated, updated=updated, comments=said.count(), pruned=prune(tables, now))
