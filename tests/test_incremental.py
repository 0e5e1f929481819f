"""Jobs that go on from what is stored: what they leave alone, what a rerun changes, and what happens when they are lost on the way."""

import os
import random
from datetime import date, datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from chatterlake.functions import names
from chatterlake.functions import text as tx
from chatterlake.operators import claim_index, claims, communities, forum, ingest, merges, series, video
from chatterlake.sources import landed, loads
from chatterlake.sources.daystore import DayTable
from chatterlake.streaming import streams

NOW = datetime(2024, 5, 1)


def files(path):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


def post_rows(spark, rows):
    """(post_id, days before NOW, score)"""
    made = [(i, "s", "u", NOW - timedelta(days=d, hours=1), "t", "b", score, 0) for i, d, score in rows]
    return spark.createDataFrame(made, "post_id long, subreddit string, author string, created_at timestamp, title string, body string, score long, num_comments long")


def links_of(posts):
    return posts.select("post_id", F.lit("T").alias("ticker"), F.lit("search").alias("via"), F.lit("k").alias("matched"))


NO_COMMENTS = "post_id long, comment_id long, parent_id long, author string, body string, score long"


def test_a_batch_leaves_the_days_that_it_does_not_touch(spark, tmp_path):
    tables = ingest.archive(spark, str(tmp_path))
    comments = spark.createDataFrame([(3, 31, None, "a", "x", 1)], NO_COMMENTS)
    first = post_rows(spark, [(1, 2, 9), (2, 3, 9), (3, 4, 30)])
    report = ingest.ingest(tables, first, links_of(first), comments, NOW)
    assert (report.new, report.updated, report.comments, report.pruned) == (3, 0, 1, 0)
    before = {name: files(table.path) for name, table in tables.items()}
    batch = post_rows(spark, [(2, 3, 11), (4, 3, 1)])
    report = ingest.ingest(tables, batch, links_of(batch), comments, NOW + timedelta(hours=2))
    assert (report.new, report.updated) == (1, 1)
    touched = f"day={(NOW - timedelta(days=3, hours=1)).date()}"
    for name, table in tables.items():
        after = files(table.path)
        assert {f: t for f, t in after.items() if touched not in f} == {f: t for f, t in before[name].items() if touched not in f}, name
    assert sorted((r.post_id, r.score) for r in tables["posts"].read().collect()) == [(1, 9), (2, 11), (3, 30), (4, 1)]
    assert sorted((r.post_id, r.score) for r in tables["scores"].read().collect()) == [(1, 9), (2, 9), (2, 11), (3, 30), (4, 1)]


def test_the_same_batch_again_changes_nothing(spark, tmp_path):
    tables = ingest.archive(spark, str(tmp_path))
    posts = post_rows(spark, [(1, 2, 9), (2, 20, 9)])
    none = spark.createDataFrame([], NO_COMMENTS)
    for _ in range(2):
        report = ingest.ingest(tables, posts, links_of(posts), none, NOW)
        assert tables["posts"].read().count() == 2 and tables["scores"].read().count() == 2
    assert (report.new, report.updated) == (0, 2)


def test_retention_drops_whole_days_and_rewrites_the_edge_alone(spark, tmp_path):
    tables = ingest.archive(spark, str(tmp_path))
    posts = post_rows(spark, [(1, 10, 1), (2, 20, 1), (3, 20, 50), (4, 30, 50), (5, 80, 50), (6, 81, 1)]).withColumns({"first_seen": F.lit(NOW), "last_seen": F.lit(NOW), "day": F.to_date("created_at")})
    for name in ("posts", "links"):
        rows = posts if name == "posts" else links_of(posts).join(posts.select("post_id", "day"), "post_id")
        tables[name].replace(rows, [])
    day = lambda n: (NOW - timedelta(days=n, hours=1)).date()
    kept_files = {name: files(tables[name].path) for name in ("posts", "links")}
    later = NOW + timedelta(days=11)  # 80 and 81 days become 91 and 92: gone as folders; post 2 is quiet and past its time
    assert ingest.prune(tables, later) == 4
    assert sorted(r.post_id for r in tables["posts"].read().collect()) == [3, 4]
    assert sorted(r.post_id for r in tables["links"].read().collect()) == [3, 4]
    assert tables["posts"].days() == [day(30), day(20)]
    for name in ("posts", "links"):
        edge = f"day={day(30)}"
        assert {f: t for f, t in files(tables[name].path).items() if edge in f} == {f: t for f, t in kept_files[name].items() if edge in f}


def test_days_are_read_by_their_folders(spark, tmp_path):
    table = DayTable(spark, str(tmp_path / "t"), "id long")
    assert table.days() == [] and table.read().count() == 0
    rows = spark.range(40).select("id", F.expr("date_add(date'2024-01-01', int(id % 4))").alias("day"))
    table.replace(rows, [])
    some = table.read([date(2024, 1, 2), date(2024, 2, 2)])
    assert some.count() == 10 and {f.rsplit("day=", 1)[1][:10] for f in (r.f for r in some.select(F.input_file_name().alias("f")).distinct().collect())} == {"2024-01-02"}
    assert "PartitionFilters: [" in some._jdf.queryExecution().toString()


def test_link_precedence_over_runs(spark):
    cols = "post_id long, ticker string, via string, matched string"
    old = spark.createDataFrame([(1, "T", "subreddit", "a"), (2, "T", "search", "old"), (3, "T", "search", "old")], cols)
    new = spark.createDataFrame([(1, "T", "subreddit", "b"), (1, "T", "search", "c"), (2, "T", "search", "new"), (3, "T", "subreddit", "s"), (4, "T", "search", "x")], cols)
    assert sorted(tuple(r)[0::1] for r in merges.merge_links(old, new).collect()) == [(1, "T", "subreddit", "a"), (2, "T", "search", "new"), (3, "T", "subreddit", "s"), (4, "T", "search", "x")]


# --- streams ---

TWEETS = "tweet_id long, created_at timestamp, text string, seen timestamp, n int"


def tweet_batch(spark, rows):
    at = datetime(2024, 1, 1)
    return spark.createDataFrame([(i, at + timedelta(days=i % 3), text, at + timedelta(days=s), n) for n, (i, text, s) in enumerate(rows)], TWEETS)


def test_a_lost_batch_comes_again_and_changes_nothing(spark, tmp_path):
    batches = [[(1, "a", 1), (2, "b", 1), (1, "later", 2)], [(2, "other", 5), (3, "c", 5)], [(1, "x", 9), (4, "d", 9)]]
    path = str(tmp_path / "in")
    sink = streams.FirstWinsSink(spark, str(tmp_path / "out"), TWEETS, "tweet_id", "created_at", "seen", "n")

    class Lost(Exception):
        pass

    class Dying(streams.FirstWinsSink):
        """Is lost between the merge and the ledger's row of the second batch."""

        def __call__(self, rows, batch):
            if batch == 1:
                self.merged(rows, batch)
                raise Lost
            super().__call__(rows, batch)

    for i, rows in enumerate(batches):
        tweet_batch(spark, rows).coalesce(1).write.mode("append").parquet(path)
        stream = spark.readStream.schema(TWEETS).parquet(path)
        if i == 1:
            with pytest.raises(Exception, match="Lost"):
                Dying(spark, str(tmp_path / "out"), TWEETS, "tweet_id", "created_at", "seen", "n").run(stream, str(tmp_path / "state"))
        sink.run(stream, str(tmp_path / "state"))
    at = lambda d: datetime(2024, 1, 1) + timedelta(days=d)
    assert sorted((r.tweet_id, r.text, r.seen) for r in sink.rows.read().collect()) == [(1, "a", at(9)), (2, "b", at(5)), (3, "c", at(5)), (4, "d", at(9))]
    assert sorted(tuple(r) for r in sink.ledger().collect()) == [(0, 2, 1), (1, 1, 1), (2, 1, 1)]
    for batch, rows in enumerate(batches):  # all of them once more
        sink(tweet_batch(spark, rows), batch)
    assert sink.ledger().count() == 3 and sink.rows.read().count() == 4


SIGHTINGS = "post_id long, seen_at timestamp, event_id long, score long, num_comments long"


def test_change_log_forgets_after_90_days_and_goes_on_after_a_restart(spark, tmp_path):
    at = lambda d: datetime(2024, 1, 1) + timedelta(days=d)
    arrivals = [[(1, at(0), 1, 5, 0), (2, at(0), 2, 7, 0)], [(1, at(10), 3, 5, 0), (2, at(80), 4, 7, 0)], [(1, at(101), 5, 5, 0), (2, at(102), 6, 7, 0)], [(2, at(103), 7, 8, 0)]]
    write = lambda path, rows: spark.createDataFrame(rows, SIGHTINGS).coalesce(1).write.mode("append").parquet(path)
    job = lambda path, out: streams.run_available(streams.change_log(spark.readStream.schema(SIGHTINGS).option("maxFilesPerTrigger", 1).parquet(path)), "log", path=out)
    whole, parts = str(tmp_path / "whole"), str(tmp_path / "parts")
    for rows in arrivals:
        write(whole, rows)
    once = sorted(r.event_id for r in job(whole, str(tmp_path / "a")).collect())
    assert once == [1, 2, 5, 7]  # post 1 is seen again after 91 days and is new; post 2 after 22
    for half in (arrivals[:2], arrivals[2:]):
        for rows in half:
            write(parts, rows)
        twice = sorted(r.event_id for r in job(parts, str(tmp_path / "b")).collect())
    assert twice == once


def test_change_log_of_a_post_with_more_rows_than_a_batch_of_arrow(spark, tmp_path):
    n, rng = 25_000, random.Random(8)
    rows = [(p, datetime(2024, 1, 1) + timedelta(seconds=i), i * 10 + p, i // 700 % 3, None if p == 2 and i % 5000 < 900 else p) for p in (1, 2) for i in range(n if p == 1 else 3000)]
    rng.shuffle(rows)
    spark.createDataFrame(rows, SIGHTINGS).coalesce(1).write.parquet(str(tmp_path / "in"))
    got = streams.run_available(streams.change_log(spark.readStream.schema(SIGHTINGS).parquet(str(tmp_path / "in"))), "log", path=str(tmp_path / "out"))
    want, last = set(), {}
    for p, _, e, *now in sorted(rows, key=lambda r: (r[0], r[1])):
        if last.get(p) != now:
            want.add((p, e, *now))
        last[p] = now
    assert sorted((r.post_id, r.event_id, r.score, r.num_comments) for r in got.collect()) == sorted(want, key=lambda r: r[:2])


# --- series ---


def test_as_of_join_of_a_hot_key_over_ranges(spark):
    start, rng = date(2020, 1, 1), random.Random(3)
    known = [("hot", start + timedelta(days=3 * i), None if i % 5 == 0 else float(i)) for i in range(3000)] + [("rare", start + timedelta(days=40), 1.0), ("null", start, None)]
    asked = [("hot", start + timedelta(days=rng.randrange(-5, 9100)), i) for i in range(4000)] + [("rare", start, 0), ("rare", start + timedelta(days=99), 1), ("none", start, 2), ("null", start + timedelta(days=1), 3)]
    right = spark.createDataFrame(known, "ticker string, date date, value double")
    left = spark.createDataFrame(asked, "ticker string, date date, n int")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = sorted((r.ticker, r.date, r.n, r.value) for r in series.as_of_join(left, right, ["ticker"]).collect())
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    by = {}
    for t, d, v in known:
        by.setdefault(t, []).append((d, v))
    want = sorted((t, d, n, max([x for x in by.get(t, []) if x[0] <= d], default=(None, None), key=lambda x: x[0])[1]) for t, d, n in asked)
    key = lambda rows: [tuple(map(str, r)) for r in rows]
    assert key(got) == key(want)
    assert series.as_of_join(left.limit(0), right, ["ticker"]).count() == 0 and series.as_of_join(left, right.limit(0), ["ticker"]).where("value is not null").count() == 0


def test_wilder_rsi_of_a_long_series(spark):
    n, rng = 300_000, np.random.default_rng(1)
    close = np.round(100 + np.cumsum(rng.integers(-3, 4, n)) * 0.25 + 500, 2)
    close[1000:1400] = close[1000]  # flat for longer than a block
    rows = spark.createDataFrame(pd.DataFrame({"i": np.arange(n), "close": close})).select(F.lit(1).alias("ticker"), F.date_add(F.lit("1100-01-01").cast("date"), F.col("i").cast("int")).alias("date"), F.col("close"), "i")
    other = spark.createDataFrame([(2, date(2024, 1, i + 1), float(c)) for i, c in enumerate([5, 6, 7] + [8] * 20)], "ticker int, date date, close double")
    got = series.wilder_rsi(rows.select("ticker", "date", "close").unionByName(other))
    assert not any(k in got._jdf.queryExecution().toString() for k in ("Pandas", "Python", "Arrow"))
    out = got.where("ticker = 1").join(rows.select("date", "i"), "date").orderBy("i").toPandas()["wilder_rsi"].to_numpy(dtype=float)
    change = pd.Series(close).diff()
    mean = lambda x: x.ewm(alpha=1 / 14, adjust=False, min_periods=14).mean()
    want = (100 - 100 / (1 + mean(change.clip(lower=0)) / mean((-change).clip(lower=0)))).to_numpy()
    assert np.isnan(out[:14]).all() and np.allclose(out[14:], want[14:], rtol=0, atol=1e-6)
    assert {r.wilder_rsi for r in got.where("ticker = 2 and date > '2024-01-14'").collect()} == {100.0}


# --- forum at scale ---


def test_fifty_thousand_keywords(spark):
    words = spark.range(50_000).select(F.concat(F.lit("word"), F.col("id").cast("string")).alias("keyword"), F.concat(F.lit("T"), F.col("id").cast("string")).alias("ticker"))
    words = words.withColumn("pattern", F.concat(F.lit("(?i)(^|[^A-Za-z0-9])"), "keyword", F.lit("([^A-Za-z0-9]|$)")))
    posts = spark.createDataFrame([(1, "Word7 and", "word49999, word50000"), (2, None, "sword7"), (3, "", ""), (4, "nothing", "here")], "post_id long, title string, body string")
    assert sorted((r.post_id, r.keyword) for r in forum.keyword_matches(posts, words).collect()) == [(1, "word49999"), (1, "word7")]
    tokens = spark.range(50_000).select(F.concat(F.lit("word"), F.col("id").cast("string")).alias("token"))
    other = spark.range(20_000).select(F.concat(F.lit("other"), F.col("id").cast("string")).alias("token"))
    held = lambda df: df.where(forum.may_hold(forum.token_filter(tokens), F.col("token"))).count()
    assert held(tokens) == 50_000 and held(other) < 600


def test_posts_of_one_file_are_matched_by_many_tasks(spark):
    texts = ["the price of it", "OF", "$OF late", "xOF OFx", "what is\n  the matter", "this theory is it, the", "IS THE"]
    posts = spark.createDataFrame([(i, None if i % 2 else "", t) for i, t in enumerate(texts)], "post_id long, title string, body string").coalesce(1)
    words = spark.createDataFrame([(k, k, tx.keyword_pattern(k)) for k in ("OF", "is the")], "keyword string, ticker string, pattern string")
    assert sorted((r.post_id, r.keyword) for r in forum.keyword_matches(posts, words).collect()) == [(1, "OF"), (2, "OF"), (4, "is the"), (6, "is the")]
    assert landed.spread(posts).rdd.getNumPartitions() == 4 and landed.spread(posts.repartition(8)).rdd.getNumPartitions() == 8



def test_hub_join_gives_each_pair_once(spark):
    a = spark.range(300).select(F.when(F.col("id") < 250, 0).otherwise(F.col("id")).alias("k"), F.col("id").alias("a"))
    b = spark.range(400).select(F.when(F.col("id") < 300, 0).otherwise(F.col("id") - 100).alias("k"), F.col("id").alias("b"))
    want = sorted(tuple(r) for r in a.join(b, "k").select("k", "a", "b").collect())
    assert sorted(tuple(r) for r in forum.hub_join(a, b, ["k"], most=1000).select("k", "a", "b").collect()) == want and len(want) > 75_000


def test_sketches_are_near_the_exact_counts(spark):
    posts = spark.range(60_000).select(F.lit("s").alias("subreddit"), F.col("id").alias("post_id"), F.expr("timestamp'2024-01-01' + make_interval(0, 0, 0, int(id % 20))").alias("created_at"))
    comments = posts.select("post_id", F.concat(F.lit("u"), (F.col("post_id") % 30_011).cast("string")).alias("author")).unionByName(posts.select("post_id", F.lit("[deleted]").alias("author")))
    now = F.lit("2024-01-20").cast("timestamp")
    exact = forum.subreddit_activity(posts, comments, now).first()
    got = forum.sketched_activity(forum.activity_sketches(posts, comments), now).first()
    assert abs(got.posts_7d - exact.posts_7d) <= 0.03 * exact.posts_7d and abs(got.commenters - exact.commenters) <= 0.03 * exact.commenters
    few = forum.sketched_activity(forum.activity_sketches(posts.where("post_id < 1000"), comments.where("post_id < 1000")), now).first()
    assert (few.posts_7d, few.commenters) == (400, 1000)


def test_activity_of_large_subreddits_is_exact(spark):
    posts = spark.range(60_000).select(F.when(F.col("id") % 60 == 1, "few").otherwise("many").alias("subreddit"), F.col("id").alias("post_id"), F.expr("timestamp'2024-01-01' + make_interval(0, 0, 0, int(id % 20))").alias("created_at"))
    comments = posts.select("post_id", F.concat(F.lit("u"), (F.col("post_id") % 30_011).cast("string")).alias("author"))
    now = posts.agg(F.max("created_at")).scalar()
    want = sorted(tuple(r) for r in forum.subreddit_activity(posts, comments, F.lit("2024-01-20").cast("timestamp")).collect())
    got = sorted(tuple(r) for r in forum.measured_activity(posts, comments, now).select("subreddit", "posts_7d", "commenters").collect())
    assert got == want and [r[1] for r in want] == [0, 24_000]


def test_tickers_with_signs_are_taken_as_they_stand(spark):
    rel = lambda ticker, text: spark.range(1).select(names.match_relevance(F.lit("some name"), F.lit(text), F.lit("en"), F.lit(ticker), F.lit("Zzz Corp")).alias("r")).first().r
    assert rel("BRK.B", "$BRKXB") == 0.0 and rel("BRK.B", "buy $BRK.B today") == 0.4
    posts = spark.createDataFrame([(1, "$AX now", None), (2, "$A. now", None), (3, "$C+ now", None), (4, "$CC now", None), (5, r"\E $A", None)], "post_id long, title string, body string")
    found = spark.createDataFrame([(i, "k", "A.") for i in (1, 2, 5)] + [(i, "k", "C+") for i in (3, 4)], "post_id long, keyword string, ticker string")
    stocks = spark.createDataFrame([("A.", "Aaa Inc"), ("C+", "Ccc Inc")], "ticker string, company string")
    assert sorted(r.post_id for r in communities.noisy_gate(found, posts, stocks).collect()) == [2, 3]
    assert spark.range(1).select(F.regexp_like(F.lit(r"a\Eb"), tx.quoted(F.lit(r"\Eb"))).alias("x")).first().x
    about = lambda title: spark.range(1).select(video.mentions_subject(F.lit(title), F.lit(""), F.lit("C+"), F.lit("Telling Corp")).alias("x")).first().x
    assert about("telling times") and not about("CC rises")
    assert tx.keyword_pattern("C+").count(r"C\+") == 1


# --- claims ---


def claim_rows(spark, rows):
    """(ticker, claim_id, text, day)"""
    made = [(t, i, text, datetime(2024, 1, 1) + timedelta(days=d)) for t, i, text, d in rows]
    df = spark.createDataFrame(made, "ticker string, claim_id long, text string, first_seen_at timestamp").withColumn("tokens", tx.claim_tokens(F.col("text")))
    return df.withColumn("fingerprint", tx.fingerprint(F.lit("k"), F.col("tokens"))).withColumn("last_seen_at", F.col("first_seen_at"))


def test_the_claim_index_over_runs_gives_what_all_pairs_give(spark, tmp_path, monkeypatch):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(40)]
    say = lambda: " ".join(rng.choice(words[: rng.choice([6, 40])]) for _ in range(rng.randint(1, 12)))
    known = [("T" if i % 3 else "U", i, say(), rng.randrange(30)) for i in range(400)]
    known += [(t, i + 1000, text.upper(), d) for t, i, text, d in known[:40]]
    fresh = [("T", 5000 + i, say() if i % 2 else " ".join(rng.choice(known)[2].split() + ["new"]), 0) for i in range(150)] + [("T", 6000, "", 0)]
    new, old = claim_rows(spark, fresh), claim_rows(spark, known)
    want = sorted(map(tuple, claims.novelty(new.select("ticker", "claim_id", "fingerprint", "tokens"), old).collect()))
    monkeypatch.setattr(claim_index, "COMMON", 20)
    for hubs in (claim_index.HUB_PAIRS, 50):
        monkeypatch.setattr(claim_index, "HUB_PAIRS", hubs)
        path = str(tmp_path / f"index-{hubs}")
        for part in (known[:200], known[200:]):  # each run brings its own claims, and has the path of the others
            claim_index.ClaimIndex(spark, path, 4).append(claim_rows(spark, part))
        claim_index.ClaimIndex(spark, path, 4).append(claim_rows(spark, known[:20]))  # again
        index = claim_index.ClaimIndex(spark, path, 4)
        assert sorted(map(tuple, index.novelty(new).collect())) == want and len({w[2] for w in want}) == 2
        entries = spark.table(index.first_tokens)
        assert entries.count() == entries.distinct().count()
    plan = index.candidate_pairs(new.select("ticker", "claim_id", "tokens"))._jdf.queryExecution().toString()
    assert "regexp" not in plan.lower()  # nothing is tokenised again
    since = sorted(map(tuple, index.novelty(new, F.lit("2024-01-15").cast("timestamp")).collect()))
    recent = [r for r in known if r[3] >= 14]
    assert since == sorted(map(tuple, claims.novelty(new.select("ticker", "claim_id", "fingerprint", "tokens"), claim_rows(spark, recent)).collect()))


def test_first_tokens_of_claims_need_no_shuffle_and_known_claims_are_read_for_asked_wordings(spark, tmp_path):
    index = claim_index.ClaimIndex(spark, str(tmp_path / "index"), 4)
    index.append(claim_rows(spark, [("T", i, f"a word{i % 7} said again", i % 5) for i in range(100)]))
    plan = index._firsts(claim_rows(spark, [("T", 1, "alpha beta gamma", 0)]), "claim_id")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Aggregate" not in plan
    asked = claim_rows(spark, [("T", 1, "word3 said again", 0), ("T", 2, "never", 0)])
    assert sorted(r.claim_id for r in index.known(asked).collect()) == list(range(3, 100, 7))


def test_the_claim_index_stores_a_claim_once_and_a_row_a_wording(spark, tmp_path, monkeypatch):
    stored, saved = [], landed.saved
    monkeypatch.setattr(landed, "saved", lambda df, name: stored.append(name) or saved(df, name))
    index = claim_index.ClaimIndex(spark, str(tmp_path / "index"), 3)
    index.append(claim_rows(spark, [("T", i, f"word{i % 7} said again w{i % 7} x{i % 7} y{i % 7}", i % 5) for i in range(100)] + [("T", 100, "", 0)]))
    assert not stored and spark.table(index.claims).count() == 101
    assert spark.table(index.first_tokens).count() == 7
    assert len([f for f in files(tmp_path / "index" / "first_tokens")]) <= 3  # a file a bucket, not one a task and bucket
    # a first token shared is not enough: the bits of all tokens tell most others apart
    shared = [("T", 1000 + i, "shared " + " ".join(f"t{i}x{k}" for k in range(9)), 0) for i in range(40)]
    index.append(claim_rows(spark, shared))
    new = claim_rows(spark, [("T", 5000 + i, t.replace("x8", "z8"), 0) for i, (_, _, t, _) in enumerate(shared)])
    pairs = index.candidate_pairs(new.select("ticker", "claim_id", "tokens"))
    assert {(r.new_id - 5000) for r in pairs.collect()} == set(range(40)) and pairs.count() == 40


def test_rows_of_many_keys_pass_a_filter_before_they_are_shuffled(spark, monkeypatch):
    rows = spark.range(20_000).select(F.col("id").alias("k"), F.when(F.col("id") % 2 == 0, "T").alias("t"))
    wanted = landed.saved(spark.range(0, 20_000, 50).select(F.col("id").alias("k"), F.lit("T").alias("t")), "wanted")
    for most in (landed.BROADCAST_ROWS, 10):
        monkeypatch.setattr(landed, "BROADCAST_ROWS", most)
        assert sorted(r.k for r in claim_index.of_keys(rows, wanted, "k", "t").collect()) == list(range(0, 20_000, 50))
    assert 400 <= claim_index.filtered(rows, wanted, "k", "t").count() < 500


def test_a_wording_of_many_claims_is_dealt_out_and_has_its_list_made_once(spark, monkeypatch):
    monkeypatch.setattr(claims, "CLAIMS_A_LIST", 50)
    known = spark.range(2000).select(F.lit("T").alias("ticker"), F.when(F.col("id") < 1900, "hot").otherwise(F.concat(F.lit("f"), F.col("id"))).alias("fingerprint"), F.col("id").alias("claim_id"), F.lit("2024-01-02").cast("timestamp").alias("last_seen_at"))
    cites = known.where("claim_id != 1999").select("ticker", "fingerprint", F.col("claim_id").alias("video_id"), F.lit(0).alias("second"), F.lit("").alias("channel_id"))
    lists = claims.cited(cites).select("ticker", "fingerprint", F.size("citations").alias("n"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = claims.known_claims(known, lists, F.lit("2024-01-10").cast("timestamp")).withColumn("part", F.spark_partition_id()).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sorted((r.claim_id, r.n) for r in got) == [(i, 1900 if i < 1900 else 1 if i < 1999 else None) for i in range(2000)]
    assert len({r.part for r in got if r.fingerprint == "hot"}) > 1


def test_the_longest_lists_come_first_in_a_task(spark, monkeypatch):
    monkeypatch.setattr(claims, "CLAIMS_A_LIST", 10)
    each = F.explode(F.sequence(F.lit(1), F.when(F.col("id") % 9 == 0, F.col("id")).otherwise(1)))  # a wording in nine has as many claims as its number says
    known = spark.range(1, 200).select(F.lit("T").alias("ticker"), F.concat(F.lit("f"), F.col("id")).alias("fingerprint"), each.alias("k"), F.lit("2024-01-02").cast("timestamp").alias("last_seen_at")).withColumn("claim_id", F.xxhash64("fingerprint", "k")).drop("k")
    lists = known.groupBy("ticker", "fingerprint").agg(F.count("*").alias("n"))
    got = claims.known_claims(known, lists, F.lit("2024-01-10").cast("timestamp"))
    assert got.count() == known.count()
    for rows in got.rdd.map(lambda r: r.n).glom().collect():
        shares = [-(-n // 10) for n in rows]
        assert shares == sorted(shares, reverse=True) and len(set(shares)) > 1


def test_known_claims_write_a_long_list_once_and_leave_out_claims_without_a_ticker(spark, tmp_path):
    folder = str(tmp_path / "in")
    doc = spark.range(1, 302).select((F.col("id") * 50 + 1).alias("doc_id"), F.lit("the same said. ").alias("text"), F.lit("en").alias("lang"), F.when(F.col("id") < 301, "src1").alias("source"))
    doc.write.parquet(f"{folder}/documents.parquet")
    spark.range(0).select(F.col("id").alias("item_id"), F.lit("").alias("text")).write.parquet(f"{folder}/benchmark.parquet")
    __spark_entry__.queries()["M15_known_claims"](spark, folder).withColumn("cited", F.repeat("cited", 400)).coalesce(1).write.parquet(str(tmp_path / "out"))
    got = spark.read.parquet(str(tmp_path / "out"))
    longest, n = got.agg(F.max(F.length("cited")), F.count("*")).first()
    assert longest > 1 << 20 and n == 300
    assert sum(p.stat().st_size for p in (tmp_path / "out").glob("*.parquet")) < 2 * longest


# --- loads ---


def test_a_second_load_of_a_folder_stores_nothing(spark, tmp_path):
    path, known = str(tmp_path / "in"), loads.Manifest(spark, str(tmp_path / "manifest"))
    spark.range(10).coalesce(1).write.json(f"{path}/run-1")
    first = landed.saved(known.new_files(path), "files")
    assert first.count() == 1
    known.record(first)
    assert known.new_files(path).count() == 0
    spark.range(5).coalesce(1).write.json(f"{path}/run-2")
    again = known.new_files(path).collect()
    assert len(again) == 1 and "run-2" in again[0].path
