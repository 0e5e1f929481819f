"""Tweet archive, ledger and merge queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from chatterlake.operators import ledger, merges
from chatterlake.plans.registry import Tables, query
from chatterlake.sources import landed, loads
from chatterlake.streaming.streams import FirstWinsSink

_BY_ID = "ids AS (SELECT handle, tweet_id, bool_or(provider = 'A') AS a, bool_or(provider = 'B') AS b, min(created_at) AS created_at FROM tweets GROUP BY ALL)"
_CMP = f"{_BY_ID}, cmp AS (SELECT handle, count(*) FILTER (WHERE a) AS n_a, count(*) FILTER (WHERE b) AS n_b, count(*) FILTER (WHERE a AND b) AS n_both, count(*) FILTER (WHERE a AND NOT b) AS a_only, count(*) FILTER (WHERE b AND NOT a) AS b_only, count(*) AS n_union, min(created_at) AS earliest FROM ids GROUP BY handle)"


@query("J10_U01_compare_providers", f"WITH {_CMP} SELECT * FROM cmp")
def compare(t: Tables):
    return ledger.compare_providers(t.tweets)


@query("A22_union_lift", f"WITH {_CMP} SELECT handle, n_union - n_a AS lift, round(100 * (n_union - n_a) / nullif(n_a, 0), 6) AS lift_pct FROM cmp")
def lift(t: Tables):
    return ledger.union_lift(ledger.compare_providers(t.tweets)).withColumn("lift_pct", F.round("lift_pct", 6))


@query("A12_account_totals", "SELECT handle, count(DISTINCT tweet_id) AS total, min(created_at) AS earliest, max(created_at) AS latest FROM tweets GROUP BY handle")
def totals(t: Tables):
    return ledger.account_totals(t.tweets)


@query("A13_status_counts", "SELECT handle, " + ", ".join(f"count(*) FILTER (WHERE status = '{s}') AS {s}" for s in ledger.STATUSES) + " FROM day_log GROUP BY handle")
def statuses(t: Tables):
    return ledger.status_counts(t.day_log)


@query("A14_coverage_floor", """WITH tot AS (SELECT handle, count(DISTINCT provider) AS n FROM day_log GROUP BY handle), d AS (SELECT handle, date, count(DISTINCT provider) AS n FROM day_log WHERE status = 'complete' GROUP BY handle, date)
 SELECT handle, min(date) AS floor FROM d JOIN tot USING (handle, n) GROUP BY handle""")
def floor(t: Tables):
    return ledger.coverage_floor(t.day_log)


_REC = """rec AS (SELECT handle, date, CASE WHEN settled < 2 OR seen < 2 THEN 'skipped' WHEN (hi - lo) / greatest(hi, 1) <= 0.10::DOUBLE THEN 'ok' ELSE 'mismatch' END AS verdict,
 CASE WHEN failed = seen THEN 'failed' WHEN (hi - lo) / greatest(hi, 1) <= 0.10::DOUBLE THEN 'ok' ELSE 'mismatch' END AS day_verdict FROM (SELECT handle, date, max(tweets_fetched) AS hi, min(tweets_fetched) AS lo,
 count(*) FILTER (WHERE status IN ('complete', 'exhausted', 'empty')) AS settled, count(*) AS seen, count(*) FILTER (WHERE status = 'failed') AS failed FROM day_log GROUP BY handle, date))"""


@query("A19_A20_reconcile", f"WITH {_REC} SELECT * FROM rec")
def reconcile(t: Tables):
    return ledger.reconcile(t.day_log)


_CONF = """g AS (SELECT handle, date, max(tweets_fetched) AS hi, min(tweets_fetched) AS lo, count(*) AS seen, count(*) FILTER (WHERE status IN ('complete', 'exhausted', 'empty')) AS settled, max(tweets_fetched) FILTER (WHERE provider = 'A') AS a, max(tweets_fetched) FILTER (WHERE provider = 'B') AS b,
 bool_or(provider = 'A' AND status IN ('complete', 'exhausted', 'empty')) AS a_ok, bool_or(provider = 'B' AND status IN ('complete', 'exhausted', 'empty')) AS b_ok FROM day_log GROUP BY handle, date),
 con AS (SELECT handle, date, CASE handle % 3 WHEN 0 THEN CASE WHEN coalesce(a_ok, false) THEN 'ok' ELSE 'skipped' END WHEN 1 THEN CASE WHEN NOT (coalesce(a_ok, false) AND coalesce(b_ok, false)) THEN 'skipped' WHEN (greatest(a, b) - least(a, b)) / greatest(a, b, 1) <= 0.10::DOUBLE THEN 'ok' ELSE 'mismatch' END
  ELSE CASE WHEN seen < 2 OR settled < seen THEN 'skipped' WHEN (hi - lo) / greatest(hi, 1) <= 0.10::DOUBLE THEN 'ok' ELSE 'mismatch' END END AS verdict FROM g)"""


@query("A19_configured_providers", f"WITH {_CONF} SELECT handle, date, verdict FROM con")
def configured(t: Tables):
    """Accounts with one configured provider, with two, and without configuration."""
    wanted = F.when(F.col("handle") % 3 == 0, F.array(F.lit("A"))).when(F.col("handle") % 3 == 1, F.array(F.lit("A"), F.lit("B")))
    conf = t.day_log.select("handle").distinct().select("handle", wanted.alias("providers"))
    return ledger.reconcile(t.day_log, conf).select("handle", "date", "verdict")


@query("A18_daily_counts", "SELECT handle, CAST(created_at AS DATE) AS date, provider, count(*) AS tweets_fetched FROM tweets GROUP BY ALL")
def daily(t: Tables):
    return ledger.daily_counts(t.tweets)


_RUNS = "runs AS (SELECT handle, run, tweet_id FROM (SELECT DISTINCT handle, tweet_id FROM tweets), (VALUES (1), (2), (3)) r(run) WHERE (tweet_id * run) % 37 <> handle % 3 + 1 OR run = 1)"


def _runs(t: Tables):
    ids = t.tweets.select("handle", "tweet_id").distinct().select("handle", "tweet_id", F.explode(F.array(*map(F.lit, (1, 2, 3)))).alias("run"))
    runs = ids.where(((F.col("tweet_id") * F.col("run")) % 37 != F.col("handle") % 3 + 1) | (F.col("run") == 1))
    marks = t.tweets.select("handle").distinct().select("handle", F.explode(F.array(*map(F.lit, (1, 2, 3)))).alias("run"))
    return runs, marks.select("handle", "run", (F.col("handle") % 17 == 0).alias("aborted"), (F.col("handle") % 13 != 0).alias("reached_floor"))


_STABLE = f"""WITH {_RUNS}, c AS (SELECT handle, run, count(DISTINCT tweet_id) AS n FROM runs GROUP BY ALL), f AS (SELECT handle, max(n) AS high, min(n) AS low FROM (SELECT h.handle, k.run, coalesce(n, 0) AS n FROM (SELECT DISTINCT handle FROM tweets) h, (VALUES (1), (2), (3)) k(run) LEFT JOIN c ON c.handle = h.handle AND c.run = k.run) GROUP BY handle),
 o AS (SELECT handle, min(sh / nullif(ei, 0)) AS overlap FROM (SELECT i.handle, k.run, count(*) FILTER (WHERE r1 AND CASE k.run WHEN 2 THEN r2 ELSE r3 END) AS sh, count(*) FILTER (WHERE r1 OR CASE k.run WHEN 2 THEN r2 ELSE r3 END) AS ei
  FROM (SELECT handle, tweet_id, bool_or(run = 1) AS r1, bool_or(run = 2) AS r2, bool_or(run = 3) AS r3 FROM runs GROUP BY ALL) i, (VALUES (2), (3)) k(run) GROUP BY ALL) GROUP BY handle)
 SELECT handle, high, low, round(overlap, 6) AS overlap, CASE WHEN handle % 17 = 0 THEN 'VARIABLE (abort)' WHEN handle % 13 = 0 THEN 'VARIABLE (floor not reached)' WHEN high = 0 THEN 'VARIABLE (zero tweets)' WHEN (high - low) / high > 0.05::DOUBLE THEN 'VARIABLE (count spread)' WHEN overlap < 0.95::DOUBLE THEN 'VARIABLE (overlap)' ELSE 'STABLE' END AS verdict FROM f LEFT JOIN o USING (handle)"""


@query("A21_E12_run_stability", _STABLE)
def stability(t: Tables):
    return ledger.run_stability(*_runs(t))


@query("M11_calendar_fill", """SELECT handle, date, p.provider, 'pending' AS status FROM (SELECT handle, CAST(unnest(generate_series(min(date)::TIMESTAMP, max(date)::TIMESTAMP, INTERVAL 1 DAY)) AS DATE) AS date FROM day_log GROUP BY handle) c, (VALUES ('A'), ('B')) p(provider)
 WHERE NOT EXISTS (SELECT 1 FROM day_log d WHERE d.handle = c.handle AND d.date = c.date AND d.provider = p.provider)""")
def calendar(t: Tables):
    return ledger.calendar_gaps(t.day_log, ["A", "B"])


@query("M13_mismatch_register", f"""WITH {_REC} SELECT handle, date, max(tweets_fetched) FILTER (WHERE provider = 'A') AS n_a, max(tweets_fetched) FILTER (WHERE provider = 'B') AS n_b FROM day_log JOIN rec USING (handle, date) WHERE day_verdict = 'mismatch' AND handle % 5 <> 0 GROUP BY handle, date""")
def mismatches(t: Tables):
    known = t.day_log.where("handle % 5 = 0").select("handle", "date").distinct()
    return ledger.mismatch_register(t.day_log, known)


@query("F01_snowflake_time", """SELECT event_id AS tweet_id, TIMESTAMP '1970-01-01' + to_seconds(CAST(floor((((event_id + 400000000000) * 4194304 >> 22) + 1288834974657) / 1000) AS BIGINT)) AS decoded FROM events""")
def snowflake(t: Tables):
    big = (F.col("event_id") + 400000000000) * 4194304
    return t.read("events").select(F.col("event_id").alias("tweet_id"), ledger.decode_snowflake(big).alias("decoded"))


@query("F03_tweet_types", """SELECT type, count(*) AS n FROM (SELECT CASE WHEN k % 7 = 0 THEN 'retweet' WHEN k % 5 = 0 THEN 'quote' WHEN k % 3 = 0 THEN 'reply' ELSE 'original' END AS type FROM tweets) GROUP BY type""")
def tweet_types(t: Tables):
    k = F.col("k")
    return t.tweets.select(ledger.tweet_type(k % 7 == 0, k % 5 == 0, k % 3 == 0).alias("type")).groupBy("type").agg(F.count("*").alias("n"))


_TAGS = "tags AS (SELECT handle, tweet_id, unnest(list_distinct(regexp_extract_all(cash_text, '(\\$[A-Z]{1,5})\\b', 1))) AS ticker FROM (SELECT DISTINCT handle, tweet_id, cash_text FROM tweets))"


def _cash(t: Tables):
    return t.tweets.select("handle", "tweet_id", F.col("cash_text").alias("text")).distinct()


@query("A15_account_profiles", """SELECT handle, count(*) AS tweets, count(*) FILTER (WHERE regexp_matches(cash_text, '\\$[A-Z]{1,5}\\b')) AS with_ticker, round(count(*) FILTER (WHERE regexp_matches(cash_text, '\\$[A-Z]{1,5}\\b')) / count(*), 6) AS share FROM (SELECT DISTINCT handle, tweet_id, cash_text FROM tweets) GROUP BY handle""")
def profiles(t: Tables):
    return ledger.account_profiles(_cash(t)).withColumn("share", F.round("share", 6))


@query("F02_ticker_mentions", f"WITH {_TAGS} SELECT handle, ticker, count(*) AS mentions FROM tags GROUP BY ALL")
def ticker_mentions(t: Tables):
    return ledger.ticker_mentions(_cash(t))


@query("A16_sector_concentration", f"""WITH {_TAGS}, m AS (SELECT handle, ticker, count(*) AS mentions FROM tags GROUP BY ALL), s(ticker, sector) AS (VALUES ('$VIEW', 'reach'), ('$CLICK', 'reach'), ('$ERROR', 'ops'))
 SELECT handle, coalesce(sector, 'unmapped') AS sector, CAST(sum(mentions) AS BIGINT) AS mentions, string_agg(DISTINCT ticker, ',' ORDER BY ticker) AS tickers FROM m LEFT JOIN s USING (ticker) GROUP BY GROUPING SETS ((coalesce(sector, 'unmapped')), (handle, coalesce(sector, 'unmapped')))""")
def concentration(t: Tables):
    sectors = t.spark.createDataFrame([("$VIEW", "reach"), ("$CLICK", "reach"), ("$ERROR", "ops")], "ticker string, sector string")
    return ledger.sector_concentration(ledger.ticker_mentions(_cash(t)), sectors)


@query("T11_cashtag_sample", f"WITH {_TAGS} SELECT t.tweet_id, count(g.ticker) AS tags FROM (SELECT DISTINCT tweet_id FROM tweets) t LEFT JOIN tags g USING (tweet_id) GROUP BY t.tweet_id ORDER BY tags DESC, tweet_id LIMIT 10")
def sample(t: Tables):
    return ledger.cashtag_sample(_cash(t)).withColumn("tags", F.col("tags").cast("long"))


@query("A17_stance_counts", "SELECT k % 3 AS stance, count(*) AS n FROM tweets GROUP BY ALL")
def stance(t: Tables):
    return t.tweets.groupBy((F.col("k") % 3).alias("stance")).agg(F.count("*").alias("n"))


@query("P10_J14_resume", "SELECT DISTINCT tweet_id FROM tweets WHERE k % 11 <> 0 AND text IS NOT NULL AND tweet_id NOT IN (SELECT event_id FROM events WHERE event_id % 4 = 0)")
def resume(t: Tables):
    live = t.tweets.where("k % 11 <> 0 and text is not null").select("tweet_id").distinct()
    done = t.read("events").where("event_id % 4 = 0").select(F.col("event_id").alias("tweet_id"))
    return live.join(done, "tweet_id", "left_anti")


# --- merges: the stored table and the batch are halves of a view ---


@query("M01_last_wins", "SELECT ticker, date, round(arg_max(close, v), 6) AS close, arg_max(volume, v) AS volume FROM (SELECT ticker, date, close, volume, 0 AS v FROM bars WHERE ticker % 3 <> 0 UNION ALL SELECT ticker, date, close + 1, volume * 2, 1 FROM bars WHERE ticker % 2 = 0) GROUP BY ticker, date")
def last_wins(t: Tables):
    b = t.bars.select("ticker", "date", "close", "volume")
    new = b.where("ticker % 2 = 0").select("ticker", "date", (F.col("close") + 1).alias("close"), (F.col("volume") * 2).alias("volume"))
    return merges.last_wins(b.where("ticker % 3 <> 0"), new, ["ticker", "date"]).withColumn("close", F.round("close", 6))


@query("M02_first_wins", """SELECT tweet_id, arg_min(text, v) AS text, max(s) AS last_seen_at, min(v) = 1 AS inserted FROM (SELECT DISTINCT tweet_id, text, created_at AS s, 0 AS v FROM tweets WHERE provider = 'A' UNION ALL SELECT DISTINCT tweet_id, 'new ' || text, created_at + INTERVAL 1 DAY, 1 FROM tweets WHERE provider = 'B') GROUP BY tweet_id""")
def first_wins(t: Tables):
    a = t.tweets.where("provider = 'A'").select("tweet_id", "text", F.col("created_at").alias("last_seen_at"))
    b = t.tweets.where("provider = 'B'").select("tweet_id", F.concat(F.lit("new "), "text").alias("text"), (F.col("created_at") + F.expr("interval 1 day")).alias("last_seen_at"))
    return merges.first_wins(a, b, "tweet_id", "last_seen_at", "last_seen_at")


@query("M03_provenance", "SELECT tweet_id, provider, created_at AS first_seen, created_at + to_hours(CASE WHEN k % 2 = 0 THEN 5 ELSE 0 END) AS last_seen FROM tweets")
def provenance(t: Tables):
    old = t.tweets.select("tweet_id", "provider", F.col("created_at").alias("first_seen"), F.col("created_at").alias("last_seen"))
    new = t.tweets.where("k % 2 = 0").select("tweet_id", "provider", (F.col("created_at") + F.expr("interval 1 hour")).alias("first_seen"), (F.col("created_at") + F.expr("interval 5 hours")).alias("last_seen"))
    return merges.provenance(old, new)


@query("M04_column_wise", "SELECT c_custkey AS ticker, CASE WHEN c_custkey % 2 = 0 THEN 'n' || c_custkey WHEN c_custkey % 3 = 0 THEN 'o' || c_custkey END AS catalyst, CASE WHEN c_custkey % 3 = 0 THEN 'tag' || c_nationkey END AS tags FROM customer WHERE c_custkey % 2 = 0 OR c_custkey % 3 = 0")
def column_wise(t: Tables):
    c = t.read("customer")
    k = F.col("c_custkey").cast("string")
    old = c.where("c_custkey % 3 = 0").select(F.col("c_custkey").alias("ticker"), F.concat(F.lit("o"), k).alias("catalyst"), F.concat(F.lit("tag"), F.col("c_nationkey").cast("string")).alias("tags"))
    new = c.where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("ticker"), F.concat(F.lit("n"), k).alias("catalyst"))
    return merges.column_wise(old, new, "ticker", ["catalyst"], ["tags"])


@query("M05_refresh_posts", """SELECT post_id, CASE WHEN post_id % 4 = 0 THEN title WHEN post_id % 2 = 0 THEN 'new' ELSE title END AS title, length(body) AS n, CASE WHEN post_id % 2 = 0 THEN score + 5 ELSE score END AS score, num_comments, created_at AS first_seen,
 CASE WHEN post_id % 2 = 0 THEN created_at + INTERVAL 1 DAY ELSE created_at END AS last_seen FROM posts""")
def refresh(t: Tables):
    p = t.posts.select("post_id", "title", "body", "score", "num_comments", F.col("created_at").alias("first_seen"), F.col("created_at").alias("last_seen"))
    later = F.col("first_seen") + F.expr("interval 1 day")
    new = p.where("post_id % 2 = 0").select("post_id", F.when(F.col("post_id") % 4 == 0, "").otherwise("new").alias("title"), F.lit("").alias("body"), (F.col("score") + 5).alias("score"), "num_comments", later.alias("first_seen"), later.alias("last_seen"))
    return merges.refresh_posts(p, new).select("post_id", "title", F.length("body").cast("long").alias("n"), "score", "num_comments", "first_seen", "last_seen")


_LINKS = "links AS (SELECT post_id, score % 5 AS ticker, CASE WHEN num_comments % 2 = 0 THEN 'subreddit' ELSE 'search' END AS via, 'm' || num_comments AS matched FROM posts UNION ALL SELECT post_id, score % 5, 'search', 'w' || num_comments FROM posts WHERE post_id % 3 = 0)"


def _links(t: Tables):
    via = F.when(F.col("num_comments") % 2 == 0, "subreddit").otherwise("search")
    n = F.col("num_comments").cast("string")
    a = t.posts.select("post_id", (F.col("score") % 5).alias("ticker"), via.alias("via"), F.concat(F.lit("m"), n).alias("matched"))
    b = t.posts.where("post_id % 3 = 0").select("post_id", (F.col("score") % 5).alias("ticker"), F.lit("search").alias("via"), F.concat(F.lit("w"), n).alias("matched"))
    return a.unionByName(b)


@query("M06_link_precedence", f"WITH {_LINKS} SELECT post_id, ticker, via, matched FROM links QUALIFY row_number() OVER (PARTITION BY post_id, ticker ORDER BY via <> 'subreddit', via, matched) = 1")
def precedence(t: Tables):
    return merges.link_precedence(_links(t))


@query("M08_digest_merge", """WITH o AS (SELECT ticker, date, mention_count AS c, CASE WHEN mention_count % 2 = 0 THEN 'ok' ELSE 'error' END AS s FROM mentions WHERE subreddit = ''), n AS (SELECT ticker, date, upvote_sum AS u, mention_count + CASE WHEN ticker % 2 = 0 THEN 1 ELSE -1 END AS c, CASE WHEN mention_count % 3 = 0 THEN 'ok' ELSE 'error' END AS s FROM mentions WHERE subreddit = '' AND ticker % 5 <> 0)
 SELECT ticker, date AS digest_date, CASE WHEN w THEN nc ELSE c END AS created_at, CASE WHEN w THEN ns ELSE s END AS status FROM (SELECT o.*, n.c AS nc, n.s AS ns, n.c > o.c AND (n.s = 'ok' OR o.s <> 'ok') AND n.c IS NOT NULL AS w FROM o LEFT JOIN n USING (ticker, date))""")
def digest_merge(t: Tables):
    m = t.mentions.where("subreddit = ''")
    c = F.col("mention_count")
    old = m.select("ticker", F.col("date").alias("digest_date"), c.alias("created_at"), F.when(c % 2 == 0, "ok").otherwise("error").alias("status"))
    new = m.where("ticker % 5 <> 0").select("ticker", F.col("date").alias("digest_date"), (c + F.when(F.col("ticker") % 2 == 0, 1).otherwise(-1)).alias("created_at"), F.when(c % 3 == 0, "ok").otherwise("error").alias("status"))
    return merges.merge_digests(old, new)


_KEPT = "kept AS (SELECT p.*, date_diff('day', CAST(created_at AS DATE), d) AS age FROM posts p, (SELECT CAST(max(created_at) AS DATE) + 14 AS d FROM posts) WHERE NOT (date_diff('day', CAST(created_at AS DATE), d) > 90 OR (date_diff('day', CAST(created_at AS DATE), d) > 14 AND score < 5 AND num_comments < 3)))"


@query("M09_M10_prune_cascade", f"WITH {_LINKS}, {_KEPT} SELECT post_id, count(*) AS links FROM links WHERE post_id IN (SELECT post_id FROM kept) GROUP BY post_id")
def prune(t: Tables):
    now = t.posts.agg(F.date_add(F.to_date(F.max("created_at")), 14).alias("now"))
    kept = merges.prune_posts(t.posts.join(F.broadcast(now), F.lit(True)), F.col("now"))
    return merges.cascade(_links(t), kept, "post_id").groupBy("post_id").agg(F.count("*").alias("links"))


@query("W25_score_log", "SELECT post_id, event_id, seen_at, score, num_comments FROM (SELECT *, lag(score) OVER w AS s, lag(num_comments) OVER w AS c, row_number() OVER w AS k FROM sightings WINDOW w AS (PARTITION BY post_id ORDER BY seen_at, event_id)) WHERE k = 1 OR s IS DISTINCT FROM score OR c IS DISTINCT FROM num_comments")
def score_log(t: Tables):
    return merges.score_log(t.sightings).select("post_id", "event_id", "seen_at", "score", "num_comments")


@query("U04_merge_lists", """WITH o AS (SELECT sector AS k, ticker AS position, 'R' || (ticker % 7) AS name, CASE WHEN ticker % 2 = 0 THEN 'manual' ELSE 'auto' END AS source FROM universe), n AS (SELECT sector AS k, ticker AS position, 'r' || (ticker % 11) AS name, 'auto' AS source FROM universe WHERE ticker % 3 = 0),
 b AS (SELECT k, 0 AS o, * EXCLUDE (k) FROM n UNION ALL SELECT k, 1, * EXCLUDE (k) FROM o WHERE source = 'manual' AND k IN (SELECT k FROM n)), f AS (SELECT * FROM b QUALIFY row_number() OVER (PARTITION BY k, lower(name) ORDER BY o, position) = 1)
 SELECT k, row_number() OVER (PARTITION BY k ORDER BY o, position) AS position, name, source FROM f UNION ALL SELECT * FROM o WHERE k NOT IN (SELECT k FROM n)""")
def merge_lists(t: Tables):
    name = lambda p, m: F.concat(F.lit(p), (F.col("ticker") % m).cast("string")).alias("name")
    old = t.universe.select(F.col("sector").alias("k"), F.col("ticker").alias("position"), name("R", 7), F.when(F.col("ticker") % 2 == 0, "manual").otherwise("auto").alias("source"))
    new = t.universe.where("ticker % 3 = 0").select(F.col("sector").alias("k"), F.col("ticker").alias("position"), name("r", 11), F.lit("auto").alias("source"))
    return merges.merge_lists(old, new, "k")


@query("U03_merge_universe", "SELECT sector, ticker FROM universe UNION SELECT sector, ticker + 1 FROM universe WHERE ticker % 4 <> 0")
def merge_universe(t: Tables):
    user = t.universe.select("sector", (F.col("ticker") + 1).alias("ticker"), F.when(F.col("ticker") % 4 == 0, "failed").when(F.col("ticker") % 2 == 0, "pending").otherwise("complete").alias("status"))
    return merges.merge_universe(t.universe.select("sector", "ticker"), user)


@query("U02_tickers_of_sectors", "SELECT ticker, string_agg(sector, ',' ORDER BY sector) AS sectors FROM (SELECT DISTINCT ticker, sector FROM universe) GROUP BY ticker")
def tickers(t: Tables):
    return t.universe.groupBy("ticker").agg(F.array_join(F.array_sort(F.collect_set("sector")), ",").alias("sectors"))


@query("U05_U08_missing_keys", "SELECT sector, 'no fund' AS what FROM (SELECT DISTINCT sector FROM universe) WHERE sector NOT IN (SELECT sector FROM etf_map) UNION ALL SELECT CAST(ticker AS VARCHAR), 'no news' FROM (SELECT DISTINCT ticker FROM universe) WHERE ticker NOT IN (SELECT ticker FROM news WHERE date >= DATE '1997-06-01')")
def missing(t: Tables):
    a = t.universe.select("sector").distinct().join(t.etf_map, "sector", "left_anti").select("sector", F.lit("no fund").alias("what"))
    recent = t.news.where("date >= '1997-06-01'")
    return a.union(t.universe.select("ticker").distinct().join(recent, "ticker", "left_anti").select(F.col("ticker").cast("string"), F.lit("no news")))


@query("U06_U07_dedupe", "SELECT author, arg_min(post_id, post_id) AS first_post, arg_max(post_id, post_id) AS last_post FROM posts GROUP BY author")
def dedupe(t: Tables):
    p = t.posts.select("author", "post_id")
    a, b = merges.dedupe(p, ["author"], "post_id"), merges.dedupe(p, ["author"], "post_id", last=True)
    return a.withColumnRenamed("post_id", "first_post").join(b.withColumnRenamed("post_id", "last_post"), "author")


@query("M14_backfill", "SELECT doc_id AS post_id, coalesce(CASE WHEN doc_id % 2 = 0 THEN lang END, source) AS label FROM documents")
def backfill(t: Tables):
    d = t.read("documents").select(F.col("doc_id").alias("post_id"), F.when(F.col("doc_id") % 2 == 0, F.col("lang")).alias("label"), "source")
    return merges.backfill(d, "label", "source").select("post_id", "label")


@query("J15_new_news", "SELECT news_id, ticker, link FROM news n WHERE date >= DATE '1997-01-01' AND NOT EXISTS (SELECT 1 FROM news o WHERE o.date < DATE '1997-01-01' AND o.ticker = n.ticker AND o.link = n.link)")
def new_news(t: Tables):
    old, new = t.news.where("date < '1997-01-01'"), t.news.where("date >= '1997-01-01'")
    return new.join(old, ["ticker", "link"], "left_anti").select("news_id", "ticker", "link")


@query("A25_failure_report", "SELECT provider, status, tweets_fetched % 3 AS reason, count(*) AS n, min(date) AS first_date, arg_min(handle, date * 10000 + handle) AS first_handle FROM (SELECT * REPLACE (date_diff('day', DATE '2000-01-01', date) AS date), date AS dd FROM day_log) WHERE status <> 'complete' GROUP BY ALL".replace("min(date) AS first_date", "min(dd) AS first_date"))
def failures(t: Tables):
    """By provider, status and reason: how many, and the first one with its context."""
    bad = t.day_log.where("status <> 'complete'")
    first = F.min(F.struct("date", "handle"))
    g = bad.groupBy("provider", "status", (F.col("tweets_fetched") % 3).alias("reason")).agg(F.count("*").alias("n"), first.alias("first"))
    return g.select("provider", "status", "reason", "n", F.col("first.date").alias("first_date"), F.col("first.handle").alias("first_handle"))


# --- whole jobs ---

#: Three runs' files; the first load finds two of them, the second the last one, the third nothing new.
_LOAD = f"""runs1 AS (SELECT tweet_id, handle, created_at, provider, run FROM tweets, (VALUES (1), (2), (3)) r(run) WHERE (run = 1 AND tweet_id % 5 <> 1) OR (run = 2 AND tweet_id % 3 = 0) OR (run = 3 AND (tweet_id % 5 = 1 OR tweet_id % 4 = 0))),
 latest AS (SELECT *, run * 10 + CASE provider WHEN 'A' THEN 0 ELSE 1 END AS seen FROM (SELECT tweet_id, handle, created_at, provider, CASE WHEN run = 3 THEN 2 ELSE 1 END AS load, max(run) AS run FROM runs1 GROUP BY ALL)), fl AS (SELECT tweet_id, min(load) AS load FROM latest GROUP BY tweet_id),
 stored AS (SELECT tweet_id, handle, min(created_at) AS created_at, min(provider) AS source FROM latest JOIN fl USING (tweet_id, load) GROUP BY tweet_id, handle), sn AS (SELECT tweet_id, max(seen) AS last_seen FROM latest GROUP BY tweet_id),
 acc AS (SELECT handle, count(*) AS total, min(created_at) AS earliest, max(created_at) AS newest, count(*) FILTER (WHERE source = 'B') AS only_b, CAST(sum(last_seen) AS BIGINT) AS last_seen FROM stored JOIN sn USING (tweet_id) GROUP BY handle),
 prov AS (SELECT handle, count(*) AS provenance, CAST(sum(l - f) AS BIGINT) AS seen_for FROM (SELECT tweet_id, handle, provider, min(seen) AS f, max(seen) AS l FROM latest GROUP BY ALL) GROUP BY handle),
 dc AS (SELECT handle, count(*) AS day_rows, max(n) AS busiest FROM (SELECT handle, CAST(created_at AS DATE) AS d, provider, count(*) AS n FROM (SELECT DISTINCT tweet_id, handle, created_at, provider FROM latest) GROUP BY ALL) GROUP BY handle), {_REC},
 days AS (SELECT handle, count(*) FILTER (WHERE verdict = 'ok') AS ok_days, count(*) FILTER (WHERE verdict = 'mismatch') AS mismatch_days FROM rec GROUP BY handle),
 gaps AS (SELECT handle, count(*) AS pending FROM (SELECT handle, CAST(unnest(generate_series(min(date)::TIMESTAMP, max(date)::TIMESTAMP, INTERVAL 1 DAY)) AS DATE) AS date FROM day_log GROUP BY handle) c, (VALUES ('A'), ('B')) p(provider) WHERE NOT EXISTS (SELECT 1 FROM day_log d WHERE d.handle = c.handle AND d.date = c.date AND d.provider = p.provider) GROUP BY handle),
 ld AS (SELECT l.load, n AS inserted, rows FROM (SELECT load, count(*) AS rows FROM latest GROUP BY load) l LEFT JOIN (SELECT load, count(*) AS n FROM fl GROUP BY load) USING (load) UNION ALL SELECT 3, 0, 0)"""
_RUN_SCHEMA = "key string, tweet_id long, handle long, micros long, provider string, run_no int"


def load_runs(spark, path: str, known: loads.Manifest, archive: FirstWinsSink, number: int):
    """One load: of the files that aren't in the manifest the last record of each id, first wins into the archive.
    Returns how many tweets were stored, how many rows passed over, and the rows (tweet_id, handle, created_at, source, seen_at), if any."""
    files = landed.saved(known.new_files(path), "new-files")
    found = [r["path"] for r in files.select("path").collect()]  # a listing, as Spark keeps one of what it reads
    if not found:
        return 0, 0, None
    latest = landed.last_file_wins(spark, found, _RUN_SCHEMA, "key").withColumn("created_at", F.timestamp_micros("micros"))
    seen = F.col("run_no") * 10 + F.when(F.col("provider") == "A", 0).otherwise(1)
    batch = landed.saved(latest.select("tweet_id", "handle", "created_at", F.col("provider").alias("source"), seen.cast("long").alias("seen_at")), "load")
    inserted, ignored = archive.merged(batch, number)
    known.record(files)
    return inserted, ignored, batch


@query("E10_archive_load", f"""WITH {_LOAD} SELECT 'account' AS section, handle AS key, total, earliest, newest, only_b, last_seen, provenance, seen_for, day_rows, busiest, coalesce(ok_days, 0) AS ok_days, coalesce(mismatch_days, 0) AS mismatch_days, coalesce(pending, 0) AS pending
 FROM acc LEFT JOIN prov USING (handle) LEFT JOIN dc USING (handle) LEFT JOIN days USING (handle) LEFT JOIN gaps USING (handle) UNION ALL SELECT 'load', load, inserted, NULL, NULL, rows - inserted, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM ld""")
def archive(t: Tables):
    """The whole job, three loads: new files by the manifest, the last file of an id counts, first wins into the archive with counts of
    what was stored and passed over; where each tweet was seen; totals of accounts; counts by day; the calendar's gaps and the days' verdicts."""
    path = landed.scratch(t.spark, "runs")
    k = F.col("tweet_id")
    rows = t.tweets.select("tweet_id", "handle", F.unix_micros(F.col("created_at").cast("timestamp")).alias("micros"), "provider").withColumn("key", F.concat_ws(":", "provider", k.cast("string")))
    parts = {1: rows.where(k % 5 != 1), 2: rows.where(k % 3 == 0), 3: rows.where((k % 5 == 1) | (k % 4 == 0))}
    known = loads.Manifest(t.spark, f"{path}-manifest")
    store = FirstWinsSink(t.spark, f"{path}-archive", "tweet_id long, handle long, created_at timestamp, source string, seen_at long", "tweet_id", "created_at", "seen_at", "source")
    seen_at = lambda b: b.select("tweet_id", F.col("source").alias("provider"), F.col("seen_at").alias("first_seen"), F.col("seen_at").alias("last_seen"))
    counts, batches, provenance = [], [], None
    for number, runs in enumerate(((1, 2), (3,), ()), 1):
        for run in runs:
            parts[run].withColumn("run_no", F.lit(run)).write.json(f"{path}/run-{run}")
        inserted, ignored, batch = load_runs(t.spark, path, known, store, number)
        counts.append((number, inserted, ignored))
        if batch is not None:
            batches.append(batch)
            provenance = seen_at(batch) if provenance is None else merges.provenance(provenance, seen_at(batch))
    stored = store.rows.read()
    totals = stored.groupBy("handle").agg(F.count("*").alias("total"), F.min("created_at").alias("earliest"), F.max("created_at").alias("newest"), F.count_if(F.col("source") == "B").alias("only_b"), F.sum("seen_at").alias("last_seen"))
    seen_by = provenance.join(stored.select("tweet_id", "handle"), "tweet_id").groupBy("handle").agg(F.count("*").alias("provenance"), F.sum(F.col("last_seen") - F.col("first_seen")).alias("seen_for"))
    loaded = batches[0].unionByName(batches[1]).select("tweet_id", "handle", "created_at", F.col("source").alias("provider")).distinct()
    by_day = ledger.daily_counts(loaded).groupBy("handle").agg(F.count("*").alias("day_rows"), F.max("tweets_fetched").alias("busiest"))
    days = ledger.reconcile(t.day_log).groupBy("handle").agg(F.count_if(F.col("verdict") == "ok").alias("ok_days"), F.count_if(F.col("verdict") == "mismatch").alias("mismatch_days"))
    gaps = ledger.calendar_gaps(t.day_log, ["A", "B"]).groupBy("handle").agg(F.count("*").alias("pending"))
    accounts = totals.join(seen_by, "handle", "left").join(by_day, "handle", "left").join(days, "handle", "left").join(gaps, "handle", "left").fillna(0, ["ok_days", "mismatch_days", "pending"])
    done = t.spark.createDataFrame(counts, "key long, total long, only_b long").withColumn("section", F.lit("load"))
    return accounts.withColumnRenamed("handle", "key").withColumns({"section": F.lit("account"), **{c: F.col(c).cast("timestamp_ntz") for c in ("earliest", "newest")}}).unionByName(done, allowMissingColumns=True)


_REPORT = f"""live AS (SELECT DISTINCT handle, tweet_id, cash_text, k FROM tweets WHERE k % 11 <> 0 AND created_at >= (SELECT max(created_at) FROM tweets) - INTERVAL 20 DAY), lg AS (SELECT tweet_id, CASE tweet_id % 3 WHEN 0 THEN 'bull' WHEN 1 THEN 'bear' ELSE 'neutral' END AS stance FROM live WHERE tweet_id % 4 = 0),
 todo AS (SELECT * FROM live ANTI JOIN lg USING (tweet_id)), tg AS (SELECT handle, tweet_id, unnest(list_distinct(regexp_extract_all(cash_text, '(\\$[A-Z]{{1,5}})\\b', 1))) AS ticker FROM live), sx(ticker, sector) AS (VALUES ('$VIEW', 'reach'), ('$CLICK', 'reach'), ('$ERROR', 'ops'))"""


@query("E11_month_report", f"""WITH {_REPORT} SELECT 'account' AS section, CAST(handle AS VARCHAR) AS key, count(*) AS n, count(*) FILTER (WHERE regexp_matches(cash_text, '\\$[A-Z]{{1,5}}\\b')) AS m FROM live GROUP BY handle
 UNION ALL SELECT 'sector', coalesce(sector, 'unmapped'), count(*), count(DISTINCT ticker) FROM tg LEFT JOIN sx USING (ticker) GROUP BY ALL UNION ALL SELECT 'ticker', ticker, count(*), count(DISTINCT handle) FROM tg GROUP BY ticker
 UNION ALL SELECT 'stance', stance, count(*), NULL FROM lg GROUP BY stance UNION ALL SELECT 'resume', 'left to do', count(*), NULL FROM todo""")
def month_report(t: Tables):
    """Live tweets of the window; accounts, tickers and sectors; stances from the ledger's lines, and what it still lacks."""
    newest = t.tweets.agg(F.max("created_at").alias("now"))
    live = t.tweets.join(F.broadcast(newest), F.lit(True)).where((F.col("k") % 11 != 0) & F.col("text").isNotNull() & (F.col("created_at") >= F.col("now") - F.expr("interval 20 days")))
    live = live.select("handle", "tweet_id", F.col("cash_text").alias("text")).distinct()
    path = landed.scratch(t.spark, "stances")
    marked = live.where("tweet_id % 4 = 0").select(F.col("tweet_id").alias("id"), F.lit(2).alias("at"), F.when(F.col("tweet_id") % 3 == 0, "bull").when(F.col("tweet_id") % 3 == 1, "bear").otherwise("neutral").alias("status"))
    marked.unionByName(marked.select("id", F.lit(1).alias("at"), F.lit("unsure").alias("status"))).select(F.to_json(F.struct("*")).alias("value")).union(t.spark.createDataFrame([("{broken",)], "value string")).write.text(path)
    done = landed.last_record(t.spark, path, "id long, at long, status string", "id", "at")
    todo = live.join(done.select(F.col("id").alias("tweet_id")), "tweet_id", "left_anti")
    sectors = t.spark.createDataFrame([("$VIEW", "reach"), ("$CLICK", "reach"), ("$ERROR", "ops")], "ticker string, sector string")
    mentions = ledger.ticker_mentions(live)
    section = lambda df, name, key, n, m: df.select(F.lit(name).alias("section"), key.cast("string").alias("key"), n.cast("long").alias("n"), m.cast("long").alias("m"))
    none = F.lit(None)
    by_sector = ledger.sector_concentration(mentions, sectors).where("handle is null")
    by_ticker = mentions.groupBy("ticker").agg(F.sum("mentions").alias("n"), F.count("*").alias("m"))
    out = section(ledger.account_profiles(live), "account", F.col("handle"), F.col("tweets"), F.col("with_ticker"))
    out = out.unionByName(section(by_sector, "sector", F.col("sector"), F.col("mentions"), F.size(F.split("tickers", ","))))
    out = out.unionByName(section(by_ticker, "ticker", F.col("ticker"), F.col("n"), F.col("m")))
    out = out.unionByName(section(done.groupBy("status").agg(F.count("*").alias("n")), "stance", F.col("status"), F.col("n"), none))
    return out.unionByName(section(todo.agg(F.count("*").alias("n")), "resume", F.lit("left to do"), F.col("n"), none))


@query("E12_provider_variance", "WITH " + _STABLE.removeprefix("WITH ").replace(" SELECT handle, high", f", {_CMP.replace('ids AS', 'byid AS').replace('FROM ids', 'FROM byid')}, ver AS (SELECT handle, high", 1) + "), tot AS (SELECT handle, count(DISTINCT regexp_extract(cash_text, '\\$[A-Z]{1,5}\\b')) FILTER (WHERE regexp_matches(cash_text, '\\$[A-Z]{1,5}\\b')) AS tags FROM tweets GROUP BY handle), smp AS (SELECT handle, string_agg(CAST(tweet_id AS VARCHAR), ',' ORDER BY n DESC, tweet_id) AS sample FROM (SELECT handle, tweet_id, n, row_number() OVER (PARTITION BY handle ORDER BY n DESC, tweet_id) AS k FROM (SELECT DISTINCT handle, tweet_id, len(regexp_extract_all(cash_text, '\\$[A-Z]{1,5}')) + CASE WHEN tweet_id % 4 = 0 THEN 1 ELSE 0 END AS n FROM tweets)) WHERE k <= 10 GROUP BY handle) SELECT handle, n_a, n_b, n_both, n_union - n_a AS lift, round(100 * (n_union - n_a) / nullif(n_a, 0), 6) AS lift_pct, overlap, verdict, tags, sample FROM cmp JOIN ver USING (handle) JOIN tot USING (handle) JOIN smp USING (handle)")
def variance(t: Tables):
    """Per account: the providers side by side, what their union adds, whether repeated runs agree, distinct cashtags, and the ten
    tweets with most of them."""
    counts = ledger.compare_providers(t.tweets)
    lift = ledger.union_lift(counts).withColumn("lift_pct", F.round("lift_pct", 6))
    stable = ledger.run_stability(*_runs(t)).select("handle", "overlap", "verdict")
    tags = ledger.ticker_mentions(_cash(t)).groupBy("handle").agg(F.count("*").alias("tags"))
    # a tag more in every fourth text, so that numbers differ
    texts = _cash(t).withColumn("text", F.when(F.col("tweet_id") % 4 == 0, F.concat("text", F.lit(" $MORE"))).otherwise(F.col("text")))
    chosen = ledger.cashtag_samples(texts).groupBy("handle").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "tweet_id"))), lambda x: x.tweet_id.cast("string")), ",").alias("sample"))
    return counts.select("handle", "n_a", "n_b", "n_both").join(lift, "handle").join(stable, "handle").join(tags, "handle").join(chosen, "handle")
