"""Forum and community queries."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from chatterlake.functions import text as tx
from chatterlake.operators import communities, forum, ingest, merges
from chatterlake.operators.signals import last_rows
from chatterlake.plans.registry import Tables, query
from chatterlake.sources import landed

_WORDS = [("THE", "THE"), ("OF", "OF"), ("CI", "CI"), ("DE", "DE"), ("rights reserved", "RR"), ("mit license", "MIT"), ("is the", "IST")]
_PAT = [(k, t, tx.keyword_pattern(k)) for k, t in _WORDS]
_KW = "kw(keyword, ticker, pattern) AS (VALUES " + ", ".join(f"('{k}', '{t}', '{p}')" for k, t, p in _PAT) + ")"
_HITS = f"{_KW}, hits AS (SELECT post_id, keyword, ticker FROM posts JOIN kw ON regexp_matches(concat_ws(' ', title, body), pattern))"
#: The twin's own list of tickers that are everyday words.
_EVERYDAY = "path poet coin hut net app cake eat open run lite car all key gold cash play love fire real air well fun live nice best free step form site arm on it up so by we me go big new"
_NOISY = "length(h.ticker) <= 2 OR list_contains(string_split('" + _EVERYDAY + "', ' '), lower(h.ticker))"
_SHORT = "short(ticker, short) AS (VALUES ('RR', 'rights reserved'), ('MIT', 'mit license'), ('IST', 'is'))"
_GATED = f"""{_HITS}, {_SHORT}, judged AS (SELECT h.*, NOT ({_NOISY}) OR regexp_matches(concat_ws(chr(10), title, body), '\\$' || regexp_escape(h.ticker) || '([^A-Za-z0-9]|$)') OR coalesce(keyword = short, false) AS ok FROM hits h JOIN posts p USING (post_id) LEFT JOIN short s ON h.ticker = s.ticker),
 gated AS (SELECT post_id, keyword, ticker FROM judged JOIN (SELECT DISTINCT post_id, ticker FROM judged WHERE ok) USING (post_id, ticker))"""
_COMPANIES = [("RR", "The rights reserved Holding Co."), ("MIT", "mit license, Inc."), ("IST", "is the"), ("CI", "CI"), ("THE", None)]


def _keywords(t: Tables):
    return F.broadcast(t.spark.createDataFrame(_PAT, "keyword string, ticker string, pattern string"))  # a fixed list


def _hits(t: Tables):
    """The matches of a query's posts, saved once: most jobs read them more than once."""
    if not hasattr(t, "saved_hits"):
        t.saved_hits = landed.saved(forum.keyword_matches(t.posts, _keywords(t)), "hits")
    return t.saved_hits


@query("J11_F04_keyword_matches", f"WITH {_HITS} SELECT * FROM hits")
def keyword_matches(t: Tables):
    return _hits(t)


def _gated(t: Tables):
    return communities.noisy_gate(_hits(t), t.posts, t.spark.createDataFrame(_COMPANIES, "ticker string, company string"))


@query("P11_noisy_gate", f"WITH {_GATED} SELECT * FROM gated")
def noisy(t: Tables):
    return _gated(t)


_LINKED = f"{_HITS}, linked AS (SELECT DISTINCT h.ticker, p.* FROM hits h JOIN posts p USING (post_id))"


def _linked(t: Tables):
    return t.posts.join(_hits(t).select("post_id", "ticker").distinct(), "post_id")


@query("A10_subreddit_rollup", f"WITH {_LINKED} SELECT ticker, subreddit, count(*) AS posts, CAST(sum(score) AS BIGINT) AS score FROM linked GROUP BY ALL")
def rollup(t: Tables):
    return forum.subreddit_rollup(_linked(t))


@query("A11_post_stats", """SELECT author AS ticker, count(*) AS posts, round(coalesce(avg(score), 0), 6) AS avg_score, (SELECT string_agg(CAST(p.post_id AS VARCHAR), ',' ORDER BY p.score DESC, p.post_id) FROM (SELECT q.post_id, q.score FROM posts q WHERE q.author = posts.author ORDER BY q.score DESC, q.post_id LIMIT 10) p) AS top FROM posts GROUP BY author""")
def post_stats(t: Tables):
    p = t.posts.select(F.col("author").alias("ticker"), "post_id", "score")
    top = last_rows(p, ["ticker"], 10, F.desc("score"), F.col("post_id")).groupBy("ticker").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "post_id"))), lambda x: x.post_id.cast("string")), ",").alias("top"))
    return p.groupBy("ticker").agg(F.count("*").alias("posts"), F.round(F.coalesce(F.avg("score"), F.lit(0.0)), 6).alias("avg_score")).join(top, "ticker")


@query("T01_rank_posts", "SELECT 'top' AS by, post_id FROM (SELECT post_id FROM posts ORDER BY score DESC, num_comments DESC, post_id LIMIT 50) UNION ALL SELECT 'comments', post_id FROM (SELECT post_id FROM posts ORDER BY num_comments DESC, score DESC, post_id LIMIT 50) UNION ALL SELECT 'new', post_id FROM (SELECT post_id FROM posts ORDER BY created_at DESC, post_id LIMIT 50)")
def rank_posts(t: Tables):
    parts = [forum.rank_posts(t.posts, by, 50).select(F.lit(by).alias("by"), "post_id") for by in ("top", "comments", "new")]
    return parts[0].union(parts[1]).union(parts[2])


@query("T02_top_posts", f"WITH {_LINKED} SELECT ticker, post_id, score + 2 * num_comments AS weight, row_number() OVER (PARTITION BY ticker ORDER BY score + 2 * num_comments DESC, created_at DESC, post_id) AS rank FROM linked QUALIFY rank <= 30")
def top_posts(t: Tables):
    return forum.top_posts(_linked(t)).select("ticker", "post_id", "weight", "rank")


@query("T03_top_comments", "SELECT post_id, comment_id, row_number() OVER (PARTITION BY post_id ORDER BY score DESC, comment_id) AS rank FROM comments QUALIFY rank <= 5")
def top_comments(t: Tables):
    return forum.top_comments(t.comments.select("post_id", "comment_id", "score")).select("post_id", "comment_id", "rank")


_FETCH = "CASE WHEN post_id % 3 = 0 THEN created_at + INTERVAL 30 MINUTE END"


@query("T04_need_comments", f"WITH n AS (SELECT max(created_at) + INTERVAL 30 HOUR AS now FROM posts) SELECT post_id FROM posts, n WHERE (score >= 20 OR num_comments >= 15) AND ({_FETCH} IS NULL OR (epoch(now - created_at) / 3600 < 72 AND epoch(now - ({_FETCH})) / 3600 > 20)) ORDER BY num_comments DESC, score DESC, post_id LIMIT 100")
def need_comments(t: Tables):
    now = t.posts.agg((F.max("created_at") + F.expr("interval 30 hours")).alias("now"))
    fetched = F.when(F.col("post_id") % 3 == 0, F.col("created_at") + F.expr("interval 30 minutes"))
    return forum.need_comments(t.posts.withColumn("fetched_at", fetched).join(F.broadcast(now), F.lit(True)), F.col("now")).select("post_id")


_DIG = f"""{_LINKED}, good AS (SELECT ticker, max(created_at) AS last_good FROM linked WHERE post_id % 50 = 0 GROUP BY ticker), nowt AS (SELECT max(created_at) AS now FROM posts),
 picked AS (SELECT l.ticker, l.post_id, l.title, row_number() OVER (PARTITION BY l.ticker ORDER BY score + 2 * num_comments DESC, created_at DESC, post_id) AS rank FROM linked l LEFT JOIN good USING (ticker), nowt
  WHERE created_at >= CAST(now AS DATE) - 7 AND (last_good IS NULL OR created_at + INTERVAL 2 HOUR > last_good) QUALIFY rank <= 30),
 said AS (SELECT post_id, comment_id, body, row_number() OVER (PARTITION BY post_id ORDER BY score DESC, comment_id) AS k FROM comments QUALIFY k <= 5)"""


def _picked(t: Tables):
    linked = _linked(t).withColumn("first_seen", F.col("created_at") + F.expr("interval 2 hours"))
    digests = _linked(t).where("post_id % 50 = 0").select("ticker", "created_at", F.lit("ok").alias("status"))
    now = t.posts.agg(F.max("created_at").alias("now"))
    return forum.digest_input(linked.join(F.broadcast(now), F.lit(True)), t.comments, digests, F.col("now"))


@query("J16_digest_input", f"WITH {_DIG} SELECT ticker, post_id, rank, coalesce((SELECT string_agg(CAST(comment_id AS VARCHAR), ',' ORDER BY k) FROM said WHERE said.post_id = picked.post_id), '') AS comment_ids FROM picked")
def digest_input(t: Tables):
    ids = F.array_join(F.transform("comments", lambda c: c.comment_id.cast("string")), ",")
    return _picked(t).select("ticker", "post_id", "rank", F.coalesce(ids, F.lit("")).alias("comment_ids"))


def _collapsed(c: str) -> str:
    return f"substr(trim(regexp_replace({c}, '\\s+', ' ', 'g')), 1, 200)"


@query("F26_F27_prompt_pack", f"""WITH {_DIG}, blocks AS (SELECT ticker, rank, '[P' || rank || '] ' || {_collapsed('title')} || chr(10) || coalesce((SELECT string_agg('- ' || {_collapsed('body')}, chr(10) ORDER BY k) FROM said WHERE said.post_id = picked.post_id), '') AS block FROM picked)
 SELECT ticker, md5(string_agg(block, chr(10) ORDER BY rank)) AS prompt_md5, length(string_agg(block, chr(10) ORDER BY rank)) AS n FROM blocks GROUP BY ticker""")
def prompt_pack(t: Tables):
    return forum.prompt_pack(_picked(t)).select("ticker", F.md5(F.col("prompt").cast("binary")).alias("prompt_md5"), F.length("prompt").cast("long").alias("n"))


@query("J20_threads", "SELECT comment_id, turn AS depth FROM comments")
def threads(t: Tables):
    return forum.thread_depths(t.comments).withColumn("depth", F.col("depth").cast("long"))


@query("P12_people", "SELECT author, count(*) AS n FROM comments WHERE lower(author) NOT IN ('', '[deleted]', '[unknown]', 'automoderator') GROUP BY author")
def people(t: Tables):
    return forum.people(t.comments).groupBy("author").agg(F.count("*").alias("n"))


_FOLLOW = f"""{_LINKED}, chosen AS (SELECT ticker, author, count(*) AS n, row_number() OVER (PARTITION BY ticker ORDER BY count(*) DESC, author) AS k FROM linked GROUP BY ticker, author QUALIFY k <= 40),
 followed AS (SELECT ticker, subreddit, count(DISTINCT c.author) AS authors, row_number() OVER (PARTITION BY ticker ORDER BY count(DISTINCT c.author) DESC, subreddit) AS rank FROM chosen c JOIN posts p ON p.author = c.author GROUP BY ticker, subreddit QUALIFY rank <= 20)"""


@query("T08_followed_subreddits", f"WITH {_FOLLOW} SELECT ticker, subreddit, authors, rank FROM followed")
def followed(t: Tables):
    return forum.followed_subreddits(t.posts, _hits(t))


_SHARES = f"{_LINKED}, shares AS (SELECT subreddit, ticker, mentions, authors, last_mention, posts, mentions / posts AS share FROM (SELECT subreddit, ticker, count(*) AS mentions, count(DISTINCT author) AS authors, max(created_at) AS last_mention FROM linked GROUP BY ALL) JOIN (SELECT subreddit, count(*) AS posts FROM posts GROUP BY subreddit) USING (subreddit))"
_VERDICT = "CASE WHEN mentions < 3 OR authors < 2 THEN 'weak' WHEN share >= CASE WHEN subreddit = 'src1' THEN 0.05::DOUBLE ELSE 0.25::DOUBLE END THEN 'stock' ELSE 'general' END"


@query("A23_F13_mention_shares", f"WITH {_SHARES} SELECT subreddit, ticker, mentions, authors, last_mention, posts, round(share, 6) AS share, {_VERDICT} AS verdict FROM shares")
def shares(t: Tables):
    s = forum.mention_shares(t.posts, _hits(t))
    return s.withColumn("verdict", forum.discovery_verdict(F.col("subreddit") == "src1")).withColumn("share", F.round("share", 6))


@query("A23_days_covered", f"""WITH {_LINKED}, nw AS (SELECT max(created_at) AS now FROM posts), c AS (SELECT subreddit, count(*) AS n, min(created_at) AS first FROM posts GROUP BY subreddit)
 SELECT DISTINCT subreddit, CASE WHEN n >= 30 THEN round(epoch(now - first) / 86400, 1) ELSE 7.0::DOUBLE END AS days_covered FROM linked JOIN c USING (subreddit), nw""")
def days_covered(t: Tables):
    """A listing that is full covers the days back to its oldest post, else the whole window."""
    now = t.posts.agg(F.max("created_at").alias("now"))
    covered = forum.days_covered(t.posts.join(F.broadcast(now), F.lit(True)), F.col("now"), window=7, cap=30)
    return covered.join(_linked(t).select("subreddit").distinct(), "subreddit", "left_semi")


@query("F26_payloads", "SELECT event_id, substr('{\"id\":' || event_id || ',\"text\":\"' || repeat(event_type, CAST(event_id % (CASE WHEN event_id % 50 = 7 THEN 13000 ELSE 40 END) AS INTEGER)) || '\"}', 1, 50000) AS payload, CASE WHEN event_id % 3 > 0 THEN array_to_string(list_transform(range(event_id % 3), lambda i: 'm' || i || '-' || event_id), ',') END AS media FROM events")
def payloads(t: Tables):
    """A tweet's payload as JSON, cut at 50 KB, and its media in one string, null without any."""
    e = t.read("events")
    raw = F.to_json(F.struct(F.col("event_id").alias("id"), F.expr("repeat(event_type, int(event_id % if(event_id % 50 = 7, 13000, 40)))").alias("text")))
    media = F.when(F.col("event_id") % 3 > 0, F.transform(F.sequence(F.lit(0), (F.col("event_id") % 3 - 1).cast("int")), lambda i: F.concat(F.lit("m"), i.cast("string"), F.lit("-"), F.col("event_id").cast("string"))))
    return e.select("event_id", tx.capped(raw, 50_000).alias("payload"), tx.joined_media(media).alias("media"))


_DISCOVERY = f"{_SHARES}, {_FOLLOW.removeprefix(_LINKED + ',')}, v AS (SELECT *, {_VERDICT} AS verdict FROM shares), fd AS (SELECT f.ticker, f.subreddit, f.authors AS seed_authors, coalesce(verdict, 'weak') AS verdict FROM followed f LEFT JOIN v s ON s.ticker = f.ticker AND s.subreddit = f.subreddit), mp AS (SELECT DISTINCT ticker, subreddit FROM fd WHERE CAST(regexp_extract(subreddit, '[0-9]+') AS INTEGER) % 3 = 0)"


@query("E06_discovery", f"WITH {_DISCOVERY} SELECT fd.*, CASE WHEN verdict = 'stock' AND mp.ticker IS NULL THEN 'new' WHEN verdict <> 'stock' AND mp.ticker IS NOT NULL THEN 'unsupported' END AS state FROM fd LEFT JOIN mp USING (ticker, subreddit)")
def discovery(t: Tables):
    """The whole job: posts that mention a stock, their authors, where these post, measured verdicts, and what of it the map lacks or
    has without support."""
    hits = _hits(t)
    f = forum.followed_subreddits(t.posts, hits).select("ticker", "subreddit", F.col("authors").alias("seed_authors"))
    s = forum.mention_shares(t.posts, hits).withColumn("verdict", forum.discovery_verdict(F.col("subreddit") == "src1"))
    found = landed.saved(f.join(s.select("ticker", "subreddit", "verdict"), ["ticker", "subreddit"], "left").fillna("weak", ["verdict"]), "found")
    mapped = found.where(F.regexp_extract("subreddit", "([0-9]+)", 1).cast("int") % 3 == 0).select("ticker", "subreddit").distinct()
    return found.join(communities.new_and_unsupported(found, mapped), ["ticker", "subreddit"], "left")


@query("A24_activity_sketches", """WITH n AS (SELECT CAST(max(created_at) AS DATE) AS d FROM posts) SELECT a.subreddit, a.posts_7d, coalesce(b.commenters, 0) AS commenters FROM (SELECT subreddit, count(DISTINCT post_id) FILTER (WHERE CAST(created_at AS DATE) >= d - 7) AS posts_7d FROM posts, n GROUP BY subreddit) a
 LEFT JOIN (SELECT subreddit, count(DISTINCT c.author || c.comment_id % 50) AS commenters FROM comments c JOIN posts p USING (post_id) GROUP BY subreddit) b USING (subreddit)""")
def sketched(t: Tables):
    """As the exact counts, from sketches by day where they are exact; larger subreddits are counted."""
    said = t.comments.select("post_id", F.concat("author", (F.col("comment_id") % 50).cast("string")).alias("author"))
    return forum.measured_activity(t.posts, said, t.posts.agg(F.max("created_at")).scalar())


@query("A24_activity", """WITH n AS (SELECT CAST(max(created_at) AS DATE) AS d FROM posts) SELECT a.subreddit, a.posts_7d, coalesce(b.commenters, 0) AS commenters FROM (SELECT subreddit, count(DISTINCT post_id) FILTER (WHERE CAST(created_at AS DATE) >= d - 7) AS posts_7d FROM posts, n GROUP BY subreddit) a
 LEFT JOIN (SELECT subreddit, count(DISTINCT c.author) AS commenters FROM comments c JOIN posts p USING (post_id) GROUP BY subreddit) b USING (subreddit)""")
def activity(t: Tables):
    now = t.posts.agg(F.max("created_at").alias("now"))
    return forum.subreddit_activity(t.posts.join(F.broadcast(now), F.lit(True)), t.comments, F.col("now"))


#: Two runs over posts of four months: the second finds posts of the last month again, some with more points or an empty title.
_RUNS = {1: "2024-04-15", 2: "2024-05-01"}
_SPREAD = "SELECT doc_id AS post_id, source AS subreddit, split_part(text, chr(10), 1) AS title, text AS body, TIMESTAMP '2024-01-01' + to_days(CAST(doc_id % 120 AS INTEGER)) + to_minutes(CAST(doc_id % 1440 AS INTEGER)) AS created_at, n_chars % 97 AS score, n_chars % 23 AS num_comments FROM documents"
_AGE = "date_diff('day', CAST(created_at AS DATE), DATE '{}')"
_STAYS = f"NOT ({_AGE} > 90 OR ({_AGE} > 14 AND score < 5 AND num_comments < 3))"
_DUE = "(score >= 20 OR num_comments >= 15) AND (fetched IS NULL OR (epoch(TIMESTAMP '{0}' - created_at) / 3600 < 72 AND epoch(TIMESTAMP '{0}' - fetched) / 3600 > 20)) ORDER BY num_comments DESC, score DESC, post_id LIMIT 100"
_INGEST = f"""{_KW}, {_SHORT}, src AS ({_SPREAD}), bt AS (SELECT 1 AS run, * FROM src WHERE created_at < TIMESTAMP '{_RUNS[1]}' AND post_id % 3 <> 0
  UNION ALL SELECT 2, * REPLACE (CASE WHEN post_id % 8 = 0 THEN '' ELSE title END AS title, CASE WHEN post_id % 4 = 0 THEN score + 5 ELSE score END AS score) FROM src WHERE created_at >= TIMESTAMP '2024-04-01' AND created_at < TIMESTAMP '{_RUNS[2]}' AND post_id % 2 = 0),
 h AS (SELECT run, post_id, keyword, ticker, concat_ws(chr(10), title, body) AS body FROM bt JOIN kw ON regexp_matches(concat_ws(' ', title, body), pattern)),
 judged AS (SELECT h.*, NOT ({_NOISY}) OR regexp_matches(body, '\\$' || regexp_escape(h.ticker) || '([^A-Za-z0-9]|$)') OR coalesce(keyword = short, false) AS ok FROM h LEFT JOIN short USING (ticker)),
 found AS (SELECT run, post_id, ticker, 'search' AS via, string_agg(DISTINCT keyword, ', ' ORDER BY keyword) AS matched FROM judged GROUP BY run, post_id, ticker HAVING bool_or(ok)),
 feed AS (SELECT run, post_id, CASE post_id % 3 WHEN 0 THEN 'CI' WHEN 1 THEN 'THE' ELSE 'DE' END AS ticker, 'subreddit' AS via, subreddit AS matched FROM bt WHERE subreddit IN ('src1', 'src2')),
 nl AS (SELECT * FROM feed UNION ALL SELECT * FROM found ANTI JOIN feed USING (run, post_id, ticker)), st AS (SELECT * FROM bt SEMI JOIN nl USING (run, post_id)),
 p1 AS (SELECT * FROM st WHERE run = 1), f1 AS (SELECT post_id FROM (SELECT *, CAST(NULL AS TIMESTAMP) AS fetched FROM p1) WHERE {_DUE.format(_RUNS[1])}), k1 AS (SELECT * FROM p1 WHERE {_STAYS.format(_RUNS[1], _RUNS[1])}), fk1 AS (SELECT * FROM f1 SEMI JOIN k1 USING (post_id)),
 n2 AS (SELECT * FROM st WHERE run = 2), s2 AS (SELECT n2.post_id FROM n2 LEFT JOIN k1 USING (post_id) WHERE k1.post_id IS NULL OR k1.score <> n2.score OR k1.num_comments <> n2.num_comments),
 p2 AS (SELECT post_id, CASE WHEN coalesce(n2.title, '') <> '' THEN n2.title ELSE coalesce(k1.title, n2.title) END AS title, coalesce(k1.created_at, n2.created_at) AS created_at, coalesce(n2.score, k1.score) AS score, coalesce(n2.num_comments, k1.num_comments) AS num_comments, k1.post_id IS NOT NULL AS first_run FROM k1 FULL JOIN n2 USING (post_id)),
 f2 AS (SELECT post_id FROM (SELECT p2.*, CASE WHEN fk1.post_id IS NOT NULL THEN TIMESTAMP '{_RUNS[1]}' END AS fetched FROM p2 LEFT JOIN fk1 USING (post_id)) WHERE {_DUE.format(_RUNS[2])}), k2 AS (SELECT * FROM p2 WHERE {_STAYS.format(_RUNS[2], _RUNS[2])}),
 l1 AS (SELECT nl.* FROM nl SEMI JOIN k1 USING (post_id) WHERE run = 1), l2 AS (SELECT * FROM nl WHERE run = 2), bl AS (SELECT * FROM l1 UNION ALL SELECT * FROM l2),
 lk AS (SELECT * FROM bl QUALIFY row_number() OVER (PARTITION BY post_id, ticker ORDER BY via <> 'subreddit', CASE WHEN via = 'subreddit' THEN run ELSE -run END) = 1),
 top AS (SELECT post_id, comment_id FROM comments QUALIFY row_number() OVER (PARTITION BY post_id ORDER BY score DESC, comment_id) <= 5),
 cm AS (SELECT post_id, comment_id, max(run) AS run FROM (SELECT top.*, 1 AS run FROM top SEMI JOIN fk1 USING (post_id) UNION ALL SELECT top.*, 2 FROM top SEMI JOIN f2 USING (post_id)) GROUP BY ALL)"""


@query("E05_forum_ingest", f"""WITH {_INGEST} SELECT 'link' AS section, ticker || ' ' || via AS key, count(*) AS n, CAST(sum(score) AS BIGINT) AS total FROM lk JOIN k2 USING (post_id) GROUP BY ALL UNION ALL SELECT 'posts', CASE WHEN first_run THEN 'first run' ELSE 'second run' END, count(*), CAST(sum(length(title)) AS BIGINT) FROM k2 GROUP BY ALL
 UNION ALL SELECT 'matched', matched, count(*), NULL FROM lk SEMI JOIN k2 USING (post_id) WHERE via = 'search' GROUP BY ALL UNION ALL SELECT 'scores', '1', count(*), CAST(sum(score) AS BIGINT) FROM k1 SEMI JOIN k2 USING (post_id) UNION ALL SELECT 'scores', '2', count(*), CAST(sum(score) AS BIGINT) FROM n2 SEMI JOIN s2 USING (post_id) SEMI JOIN k2 USING (post_id)
 UNION ALL SELECT 'comments', CAST(run AS VARCHAR), count(*), NULL FROM cm SEMI JOIN k2 USING (post_id) GROUP BY ALL UNION ALL SELECT 'new', '1', (SELECT count(*) FROM p1), NULL UNION ALL SELECT 'new', '2', (SELECT count(*) FROM n2 ANTI JOIN k1 USING (post_id)), NULL UNION ALL SELECT 'updated', '1', 0, NULL UNION ALL SELECT 'updated', '2', (SELECT count(*) FROM n2 SEMI JOIN k1 USING (post_id)), NULL
 UNION ALL SELECT 'pruned', '1', (SELECT count(*) FROM p1) - (SELECT count(*) FROM k1), NULL UNION ALL SELECT 'pruned', '2', (SELECT count(*) FROM p2) - (SELECT count(*) FROM k2), NULL""")
def forum_ingest(t: Tables):
    """The whole job, two runs into a stored archive: feeds and searches, the gate on hits, posts and links merged into the days
    they touch, the log of scores, comments of notable posts, retention."""
    d, k = t.read("documents"), F.col("post_id")
    src = d.select(
        F.col("doc_id").alias("post_id"), F.col("source").alias("subreddit"), F.concat(F.lit("u"), (F.col("doc_id") % 41).cast("string")).alias("author"), F.substring_index("text", "\n", 1).alias("title"), F.col("text").alias("body"),
        F.timestamp_seconds(F.lit(1704067200) + (F.col("doc_id") % 120) * 86400 + (F.col("doc_id") % 1440) * 60).alias("created_at"), (F.col("n_chars") % 97).alias("score"), (F.col("n_chars") % 23).alias("num_comments"),
    )
    seen_again = src.withColumns({"title": F.when(k % 8 == 0, "").otherwise(F.col("title")), "score": F.when(k % 4 == 0, F.col("score") + 5).otherwise(F.col("score"))})
    batches = {1: src.where(f"created_at < timestamp'{_RUNS[1]}' and post_id % 3 <> 0"), 2: seen_again.where(f"created_at >= timestamp'2024-04-01' and created_at < timestamp'{_RUNS[2]}' and post_id % 2 = 0")}
    companies = t.spark.createDataFrame(_COMPANIES, "ticker string, company string")
    tables, reports = ingest.archive(t.spark, landed.scratch(t.spark, "archive")), []
    for run, batch in batches.items():
        hits = landed.saved(forum.keyword_matches(batch, _keywords(t)), "hits")
        real = communities.noisy_gate(hits, batch, companies)
        search = real.groupBy("post_id", "ticker").agg(F.array_join(F.array_sort(F.collect_set("keyword")), ", ").alias("matched"))
        feed = batch.where(F.col("subreddit").isin("src1", "src2")).select("post_id", F.when(k % 3 == 0, "CI").when(k % 3 == 1, "THE").otherwise("DE").alias("ticker"), F.lit("subreddit").alias("via"), F.col("subreddit").alias("matched"))
        links = landed.saved(merges.link_precedence(feed.unionByName(search.withColumn("via", F.lit("search")))), "links")
        reports.append(ingest.ingest(tables, batch, links, t.comments, datetime.fromisoformat(_RUNS[run])))
    now = {name: table.read() for name, table in tables.items()}
    none = F.lit(None).cast("long")
    part = lambda df, name, key, total=none: df.groupBy(F.lit(name).alias("section"), key.cast("string").alias("key")).agg(F.count("*").alias("n"), total.alias("total"))
    run_of = lambda c: F.when(F.to_date(c) == _RUNS[1], "1").otherwise("2")
    out = part(now["links"].join(now["posts"].select("post_id", "score"), "post_id"), "link", F.concat_ws(" ", "ticker", "via"), F.sum("score"))
    out = out.unionByName(part(now["posts"], "posts", F.when(F.to_date("first_seen") == _RUNS[1], "first run").otherwise("second run"), F.sum(F.length("title"))))
    out = out.unionByName(part(now["links"].where("via = 'search'"), "matched", F.col("matched"), F.max(none))).unionByName(part(now["scores"], "scores", run_of("seen_at"), F.sum("score")))
    out = out.unionByName(part(now["comments"], "comments", run_of("fetched_at"), F.max(none)))
    counts = [(what, str(i + 1), getattr(r, what), None) for i, r in enumerate(reports) for what in ("new", "updated", "pruned")]
    return out.unionByName(t.spark.createDataFrame(counts, "section string, key string, n long, total long"))
