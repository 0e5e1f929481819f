"""The streaming jobs over the event tables, as rows arrive: three days of rows at a time, some rows an arrival late, and after
a closing row far ahead some that are later than the allowance. The job runs after each arrival and goes on from its checkpoint."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chatterlake.plans.registry import Tables, query
from chatterlake.sources import landed
from chatterlake.streaming import streams

DAYS_AN_ARRIVAL, CLOSING, TOO_LATE = 3, 1000, 1002
CLOSED = "2025-01-01"


def _arrival_of(ts: str, days: int = DAYS_AN_ARRIVAL) -> Column:
    """Arrivals by time; events are of one month."""
    return F.floor(F.datediff(ts, F.lit("2024-01-01")) / days).cast("int")


def _as_they_arrive(t: Tables, name: str, rows: DataFrame, arrival: Column, job: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Rows are written arrival by arrival, and the job is run after each; what the last run returns is the result."""
    path, out = landed.scratch(t.spark, name), None
    tagged = landed.saved(rows.withColumn("__arrival", arrival), name)
    for r in tagged.select("__arrival").distinct().orderBy("__arrival").collect():
        tagged.where(F.col("__arrival") == r["__arrival"]).drop("__arrival").write.mode("append").parquet(path)
        out = job(t.spark.readStream.schema(rows.schema).parquet(path))
    return out


def _to_table(t: Tables, name: str, job: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame], DataFrame]:
    path = landed.scratch(t.spark, name)
    return lambda stream: streams.run_available(job(stream), name, path=path)


def _closing(df: DataFrame, **values) -> DataFrame:
    """A row far ahead, which moves the watermark past all others."""
    last = df.limit(1).withColumn("ts", F.lit(CLOSED).cast(df.schema["ts"].dataType))
    return last.withColumns({c: F.lit(v).cast(df.schema[c].dataType) for c, v in values.items()})


@query("R01_stream_daily_counts", "SELECT user_id, CAST(ts AS DATE) AS date, count(*) AS n FROM events WHERE event_id % 97 <> 0 GROUP BY ALL")
def daily(t: Tables):
    """Rows that come an arrival late count; rows (event_id divisible by 97) that come after their days have closed don't."""
    e = t.read("events")
    # two closing rows in two arrivals: what is late is told by the watermark of the batch before
    rows = e.unionByName(_closing(e, user_id=-1, event_id=-1)).unionByName(_closing(e, user_id=-1, event_id=-2))
    k = F.col("event_id")
    arrival = F.when(k < 0, (F.lit(CLOSING - 1) - k).cast("int")).when(k % 97 == 0, TOO_LATE).otherwise(_arrival_of("ts") + F.when(k % 17 == 0, 1).otherwise(0))
    return _as_they_arrive(t, "events", rows, arrival, _to_table(t, "daily", lambda stream: streams.daily_counts(stream, "user_id", "ts"))).where("user_id >= 0")


def _copies(t: Tables) -> DataFrame:
    """Each provider's copy of each tweet, and a third one of some."""
    e = t.read("events")
    copies = e.where("event_id % 10 <> 0").withColumn("copy", F.lit(0)).unionByName(e.where("event_id % 7 <> 0").withColumn("copy", F.lit(1)))
    return copies.unionByName(e.where("event_id % 97 = 1 and event_id % 10 <> 0").withColumn("copy", F.lit(2)))


@query("R02_stream_first_wins", "SELECT DISTINCT event_id AS tweet_id, user_id AS handle FROM events WHERE event_id % 10 <> 0 OR event_id % 7 <> 0")
def first_wins(t: Tables):
    """Each tweet once: the second provider's copy comes an arrival later, and some come again after all has closed."""
    rows = _copies(t)
    rows = rows.unionByName(_closing(rows, user_id=-1, event_id=-1, copy=3))
    arrival = F.when(F.col("copy") == 3, CLOSING).when(F.col("copy") == 2, TOO_LATE).otherwise(_arrival_of("ts") + F.col("copy"))
    once = lambda stream: streams.first_of_each(stream, "event_id", "ts").select(F.col("event_id").alias("tweet_id"), F.col("user_id").alias("handle"))
    return _as_they_arrive(t, "tweets", rows, arrival, _to_table(t, "first", once)).where("tweet_id >= 0")


@query("R02_stream_last_seen", """WITH c AS (SELECT event_id, user_id, ts, copy FROM events, (VALUES (0), (1), (2)) v(copy) WHERE (copy = 0 AND event_id % 10 <> 0) OR (copy = 1 AND event_id % 7 <> 0) OR (copy = 2 AND event_id % 97 = 1 AND event_id % 10 <> 0))
 SELECT 'tweet' AS section, event_id AS id, arg_min('copy ' || copy, copy) AS text, max(ts + to_days(copy)) AS last_seen FROM c GROUP BY event_id UNION ALL SELECT 'inserted', count(DISTINCT event_id), NULL, NULL FROM c UNION ALL SELECT 'ignored', count(*) - count(DISTINCT event_id), NULL, NULL FROM c""")
def last_seen(t: Tables):
    """Each tweet as it came first, and when it was seen last; how many copies were stored and how many passed over, from the ledger."""
    rows = _copies(t).select("event_id", F.col("ts").cast("timestamp").alias("ts"), F.concat(F.lit("copy "), F.col("copy").cast("string")).alias("text"), "copy", (F.col("ts").cast("timestamp") + F.expr("make_interval(0, 0, 0, copy)")).alias("seen"))
    path = landed.scratch(t.spark, "seen")
    sink = streams.FirstWinsSink(t.spark, path, "event_id long, ts timestamp, text string, copy int, seen timestamp", "event_id", "ts", "seen", "copy")
    stored = _as_they_arrive(t, "seen", rows, _arrival_of("ts", 10) + F.col("copy"), lambda stream: sink.run(stream, f"{path}/state"))
    counts = sink.ledger().agg(F.sum("inserted").alias("inserted"), F.sum("ignored").alias("ignored")).unpivot([], ["inserted", "ignored"], "section", "id")
    out = stored.select(F.lit("tweet").alias("section"), F.col("event_id").alias("id"), "text", F.col("seen").cast("timestamp_ntz").alias("last_seen"))
    return out.unionByName(counts.select("section", "id", F.lit(None).cast("string").alias("text"), F.lit(None).cast("timestamp_ntz").alias("last_seen")))


_SEEN = "seen AS (SELECT post_id, event_id, seen_at + to_days(CASE WHEN event_id % 7 = 0 THEN 100 ELSE 0 END) AS seen_at, score, num_comments FROM sightings)"


@query("R03_stream_change_log", f"""WITH {_SEEN} SELECT post_id, event_id, seen_at, score, num_comments FROM (SELECT *, lag(score) OVER w AS s, lag(num_comments) OVER w AS c, lag(seen_at) OVER w AS before, row_number() OVER w AS k FROM seen WINDOW w AS (PARTITION BY post_id ORDER BY seen_at, event_id))
 WHERE k = 1 OR s IS DISTINCT FROM score OR c IS DISTINCT FROM num_comments OR seen_at - before > INTERVAL 90 DAY""")
def change_log(t: Tables):
    """The last sighting of a post is kept from one run to the next, for 90 days: one in seven sightings comes 100 days later."""
    later = F.when(F.col("event_id") % 7 == 0, F.expr("seen_at + interval 100 days")).otherwise(F.col("seen_at"))
    rows = t.sightings.withColumn("seen_at", later)
    return _as_they_arrive(t, "sightings", rows, _arrival_of("seen_at", 10), _to_table(t, "changes", streams.change_log))
