"""Queries on communities of stocks. The twins' lists are written out here again, so a value changed on one side shows."""

from __future__ import annotations

from pyspark.sql import functions as F

from chatterlake.functions import names
from chatterlake.operators import communities, forum, rollups
from chatterlake.plans.forum import _SHARES, _VERDICT, _hits
from chatterlake.plans.registry import Tables, query
from chatterlake.sources import landed

# --- communities and stocks made from parts: expressions that both engines read ---

_W1, _W2 = "split_part(p_name, ' ', 1)", "split_part(p_name, ' ', 2)"
_TICK = f"CASE {_W2} WHEN 'ring' THEN 'ARM' WHEN 'bolt' THEN 'GOLD' WHEN 'gear' THEN 'ON' ELSE upper(substr({_W2}, 1, 4)) END"
_CAP = lambda w: f"upper(substr({w}, 1, 1)) || substr({w}, 2)"
_NAME = f"""CASE p_partkey % 12 WHEN 0 THEN tick WHEN 1 THEN w1 || '_' || w2 WHEN 2 THEN {_CAP('w1')} || {_CAP('w2')} || 'Stock' WHEN 3 THEN lower(tick) || 'stocks' WHEN 4 THEN 'The' || {_CAP('w2')} || 'Trading' WHEN 5 THEN w2 || 'lovers'
 WHEN 6 THEN {_CAP('w1')} || 'Investors' WHEN 7 THEN w1 || w2 || (p_partkey % 50) WHEN 8 THEN 'AST' || {_CAP('w2')} || 'Markets' WHEN 9 THEN lower(tick) || 'hq' WHEN 10 THEN lower(tick) || (p_partkey % 7) ELSE w2 END"""
_TEXT = """CASE p_partkey % 7 WHEN 0 THEN '$' || tick || ' and friends' WHEN 1 THEN p_name || ' shareholders earnings talk' WHEN 2 THEN 'all about ' || p_name WHEN 3 THEN 'Trading ' || w2 || ' stocks' WHEN 4 THEN 'share your ' || w2 WHEN 5 THEN p_name || ' ' || tick ELSE '' END
 || ' ' || p_type || CASE WHEN p_size % 3 = 0 THEN ' NASDAQ: ' || tick ELSE '' END"""
_LANG = "CASE p_size % 6 WHEN 0 THEN 'fr' WHEN 1 THEN NULL ELSE 'en-US' END"
_COMPANY = f"{_CAP('w1')} || ' ' || {_CAP('w2')} || CASE p_partkey % 3 WHEN 0 THEN ', Inc.' WHEN 1 THEN ' Technologies' ELSE ' Holdings Ltd' END"
_INFO = {"text": _TEXT, "lang": _LANG, "subscribers": "p_partkey * 37 % 5000", "posts_7d": "p_partkey % 60", "commenters": "CAST(p_size % 20 AS BIGINT)", "over18": "p_partkey % 19 = 0"}

_PARTS = f"parts AS (SELECT *, {_W1} AS w1, {_W2} AS w2, {_TICK} AS tick FROM part)"
_COMM = f"""{_PARTS}, named AS (SELECT p_partkey, {_NAME} AS name, {', '.join(f'{v} AS "{k}"' for k, v in _INFO.items())} FROM parts), comm AS (SELECT * FROM named QUALIFY row_number() OVER (PARTITION BY lower(name) ORDER BY p_partkey) = 1),
 stocks AS (SELECT tick AS ticker, min({_COMPANY}) AS company FROM parts GROUP BY 1)"""


def _parts(t: Tables):
    return t.read("part").select("*", F.expr(_W1).alias("w1"), F.expr(_W2).alias("w2"), F.expr(_TICK).alias("tick"))


def _communities(t: Tables):
    c = _parts(t).select("p_partkey", F.expr(_NAME).alias("name"), *(F.expr(v).alias(k) for k, v in _INFO.items()))
    return c.groupBy(F.lower("name").alias("low")).agg(F.min_by(F.struct("name", *_INFO), "p_partkey").alias("c")).select("c.*")


def _stocks(t: Tables):
    return _parts(t).groupBy(F.col("tick").alias("ticker")).agg(F.min(F.expr(_COMPANY)).alias("company"))


# --- the twins' lists ---


def _list(words: str) -> str:
    return "string_split('" + words + "', ' ')"


_LEGAL = _list("inc incorporated corp corporation co company ltd limited plc llc lp holdings holding nv sa se ag the")
_SUFFIXES = _list("inc incorporated corp corporation co company ltd limited plc llc lp holdings holding group sa nv ag se technologies technology tech systems usa international industries the")
_ENDINGS = _list("stock stocks investing investor investors trading trader traders dd options stockmarket market community official hq")
_ATTR_WORDS = _list("cake eat coin poet open run car all key net app gold cash play love fire real air well fun live nice best free step form site")
_MATCH_WORDS = _list("path poet coin hut net app cake eat open run lite car all key gold cash play love fire real air well fun live nice best free step form site arm on it up so by we me go big new")
_ATTR_FIN = _list("stock stocks invest investing investor investors trading trader traders shares share shareholder shareholders ticker nasdaq nyse earnings dividend dividends bullish bearish options equity equities dd calls puts portfolio valuation")
_MATCH_FIN = _list("stock stocks invest investing investor investors trading trader traders shareholder shareholders ticker nasdaq nyse amex earnings dividend dividends bullish bearish options equity equities dd calls puts portfolio valuation float premarket holders")
_STRONG = _list(
    "stock stocks stockmarket stockmarkets stonks stonk wallstreetbets wallstreet wsb investing investment investments investor investors pennystocks pennystock daytrading swingtrading valueinvesting "
    "dividends dividend shortsqueeze nasdaq nyse etf etfs spac spacs hedgefund hedgefunds brokerage shareholders smallcaps microcaps bagholders tickers premarket aftermarket"
)
_WEAK = _list(
    "market markets trading trader traders trade options calls puts shares equity equities finance financial portfolio earnings ipo bull bulls bear bears bullish bearish ticker securities capital money "
    "dd yolo valuation fundamentals technicals"
)
_TEXT_STRONG = _list("stock stocks invest investing investor investors shareholder shareholders nasdaq nyse ticker earnings dividend dividends bullish bearish equity equities trading traders puts calls valuation")


def _about(base: str, condition: str) -> str:
    return f"(length({base}) > 0 AND (nm = {base} OR ({condition} AND starts_with(nm, {base}) AND list_contains({_ENDINGS}, substr(nm, length({base}) + 1)))))"


_SPOKEN = f"list_filter(list_transform(string_split_regex(lower(company), '[\\s,]+'), lambda w: trim(w, '.,')), lambda w: length(w) >= 3 AND NOT list_contains({_SUFFIXES}, w))"
_NM = "regexp_replace(lower(name), '[^a-z0-9]', '', 'g')"
_HUMPS = lambda c: f"list_transform(regexp_extract_all(regexp_replace({c}, '([A-Z]+)([A-Z][a-z])', '\\1 \\2', 'g'), '[A-Z][a-z][a-z0-9]*|[A-Z]+|[a-z0-9]+'), lambda w: lower(w))"
_STRONG_IN = lambda c: f"len(list_filter({c}, lambda w: list_contains({_STRONG}, w) OR (length(w) > 6 AND regexp_matches(w, '(stocks|stockmarket|investing|investors|investor|wallstreetbets|pennystocks|stonks)$')))) > 0"

_ATTR = f"""{_COMM}, pr AS (SELECT name, ticker, lower(ticker) AS tk, {_NM} AS nm, string_split_regex(lower(name || ' ' || text), '[^a-z0-9]+') AS hay, lower(name || ' ' || text) AS raw,
  list_filter(string_split_regex(lower(company), '[^a-z0-9]+'), lambda w: length(w) >= 3 AND NOT list_contains({_SUFFIXES}, w)) AS ws FROM comm, stocks WHERE subscribers >= 50),
 pf AS (SELECT *, (list_has_any(hay, {_ATTR_FIN}) OR contains(raw, '$' || tk)) AS fin, array_to_string(ws, '') AS joined FROM pr),
 sc AS (SELECT name, ticker, least(1.0, CASE WHEN CASE WHEN list_contains({_ATTR_WORDS}, tk) THEN ({_about('tk', 'length(tk) >= 3')} OR list_contains(hay, tk)) AND fin ELSE {_about('tk', 'length(tk) >= 3')} OR (list_contains(hay, tk) AND fin) END THEN 0.6 ELSE 0 END
  + CASE WHEN {_about('joined', 'true')} OR (len(ws) > 0 AND list_has_all(hay, ws) AND fin) THEN 0.6 ELSE 0 END)::DOUBLE AS relevance FROM pf),
 best AS (SELECT * FROM (SELECT *, max(relevance) OVER (PARTITION BY name) AS m FROM sc WHERE relevance >= 0.6) WHERE relevance = m), attr AS (SELECT name, min(ticker) AS ticker, min(relevance) AS relevance FROM best GROUP BY name HAVING count(*) = 1)"""


@query("J12_F09_attribution", f"WITH {_ATTR} SELECT * FROM attr")
def attribution(t: Tables):
    return communities.attributed(_communities(t), _stocks(t), 50)


_CATALOG = f"""{_ATTR}, tok AS (SELECT c.*, attr.ticker, attr.relevance, {_HUMPS('c.name')} AS n, {_HUMPS('c.text')} AS x FROM comm c LEFT JOIN attr USING (name) WHERE subscribers >= 1000),
 cat AS (SELECT name, subscribers, CASE WHEN ticker IS NOT NULL THEN 'ticker' WHEN {_STRONG_IN('n')} THEN 'name-strong' WHEN list_has_any(n, {_WEAK}) AND ({_STRONG_IN('x')} OR list_has_any(x, {_ATTR_FIN})) THEN 'name-weak+context'
  WHEN len(list_intersect(list_distinct(x), {_ATTR_FIN})) >= 2 AND ({_STRONG_IN('x')} OR list_has_any(list_intersect(x, {_ATTR_FIN}), {_TEXT_STRONG})) THEN 'text' ELSE 'no' END AS rule, ticker, relevance FROM tok)"""


@query("F12_E07_T10_catalog", f"WITH {_CATALOG} SELECT *, rank() OVER (ORDER BY subscribers DESC) AS place FROM cat")
def catalog(t: Tables):
    c = communities.catalog(_communities(t), _stocks(t))
    placed = landed.saved(rollups.places(c, [F.desc("subscribers"), F.col("name")], "at"), "places")
    shared = placed.groupBy("subscribers").agg(F.min("at").cast("long").alias("place"))  # communities of one size share the first of their places
    return placed.join(shared, "subscribers").select("name", "subscribers", "rule", "ticker", "relevance", "place")


@query("E07_catalog_export", f"""WITH {_CATALOG} SELECT ticker, string_agg(name, '|' ORDER BY subscribers DESC, name) AS names, count(*) AS n, round(sum(round(relevance, 2)), 2) AS relevance FROM cat WHERE ticker IS NOT NULL GROUP BY ticker
 UNION ALL SELECT rule, NULL, count(*), NULL FROM cat WHERE rule NOT IN ('no', 'ticker') GROUP BY rule""")
def catalog_export(t: Tables):
    """The whole job: attribute, classify, write the catalog as CSV and read it back, make the map of stocks from it."""
    c = communities.catalog(_communities(t), _stocks(t)).where("rule != 'no'")
    path = landed.scratch(t.spark, "catalog")
    landed.write_catalog(c.select("name", "subscribers", (F.col("rule") != "no").alias("is_market"), F.array(F.coalesce("ticker", "rule")).alias("signals"), F.coalesce("relevance", F.lit(0.0)).alias("relevance")), path)
    back = landed.read_catalog(t.spark, path).withColumn("ticker", F.get("signals", 0))
    ours = back.where("relevance > 0")
    listed = landed.stock_map(ours).select("ticker", F.array_join("names", "|").alias("names"))
    totals = ours.groupBy("ticker").agg(F.count("*").alias("n"), F.round(F.sum("relevance"), 2).alias("relevance"))
    rest = back.where("relevance = 0").groupBy("ticker").agg(F.count("*").alias("n")).select("ticker", F.lit(None).cast("string").alias("names"), "n", F.lit(None).cast("double").alias("relevance"))
    return listed.join(totals, "ticker").unionByName(rest)


_MATCH = f"""{_COMM}, st AS (SELECT ticker, company, {_SPOKEN} AS ws FROM stocks), stems AS (SELECT ticker, company, ws, unnest(list_filter(list_distinct([lower(ticker), regexp_replace(ws[1], '[^a-z0-9]', '', 'g'), regexp_replace(array_to_string(ws, ''), '[^a-z0-9]', '', 'g')]), lambda s: length(s) BETWEEN 1 AND 21)) AS stem FROM st),
 pairs AS (SELECT DISTINCT c.*, ticker, ws FROM comm c JOIN stems ON starts_with(lower(name), stem)),
 ev AS (SELECT *, lower(ticker) AS tk, {_NM} AS nm, string_split_regex(lower(text), '[^a-z0-9$]+') AS tok, list_contains({_MATCH_WORDS}, lower(ticker)) AS everyday, regexp_replace(array_to_string(ws, ''), '[^a-z0-9]', '', 'g') AS base FROM pairs),
 ev2 AS (SELECT *, CASE WHEN everyday THEN nm = tk ELSE length(tk) >= 2 AND {_about('tk', 'true')} END AS by_ticker, length(base) >= 2 AND {_about('base', 'true')} AS by_name, regexp_matches(lower(text), '\\$' || regexp_escape(tk) || '\\b') AS dollar, list_contains(tok, tk) AND NOT everyday AS token,
  len(ws) > 0 AND list_has_all(tok, ws) AND NOT (len(ws) = 1 AND ws[1] = tk) AS told, list_has_any(tok, {_MATCH_FIN}) AS fin, substr(lower(coalesce(lang, 'en')), 1, 2) <> 'en' AS alien FROM ev),
 rel AS (SELECT *, CASE WHEN (by_ticker OR by_name) AND NOT by_ticker AND NOT dollar AND NOT token AND NOT fin THEN 0.4 WHEN by_ticker AND NOT told AND NOT fin THEN 0.4 WHEN alien AND NOT told AND NOT dollar THEN 0.4
  WHEN (by_ticker OR by_name) AND (dollar OR token OR told) THEN 1.0 WHEN (by_ticker OR by_name) AND fin THEN 0.7 WHEN (dollar OR token OR told) AND fin THEN 0.6 WHEN by_ticker OR by_name OR dollar OR token OR told THEN 0.4 ELSE 0.0 END::DOUBLE AS relevance FROM ev2)"""


@query("F10_match_relevance", f"WITH {_MATCH} SELECT ticker, name, relevance FROM rel")
def match_relevance(t: Tables):
    low = F.lower("name")
    starts = F.transform(F.sequence(F.lit(1), F.least(F.length("name"), F.lit(21))), lambda i: F.substring(low, F.lit(1), i))
    a = _communities(t).select("name", "text", "lang", F.explode(starts).alias("stem"))
    b = _stocks(t).select("ticker", "company", F.explode(names.stems(F.col("ticker"), F.col("company"))).alias("stem"))
    pairs = a.join(b, "stem").drop("stem").distinct()
    return pairs.select("ticker", "name", names.match_relevance(F.col("name"), F.col("text"), F.col("lang"), F.col("ticker"), F.col("company")).alias("relevance"))


#: Posts and people of each community: documents and conversations dealt out over the first communities, by days.
_ACTIVITY = f"""cp AS (SELECT lower(name) AS low, doc_id, DATE '2024-01-01' + CAST(doc_id % 20 AS INTEGER) AS day FROM documents JOIN named ON p_partkey = 1 + doc_id % 300),
 ac AS (SELECT low, count(DISTINCT doc_id) FILTER (WHERE day >= (SELECT max(day) FROM cp) - 7) AS posts_7d, (SELECT count(DISTINCT author || comment_id % 13) FROM comments JOIN cp a ON post_id = a.doc_id WHERE a.low = cp.low) AS commenters FROM cp GROUP BY low)"""


def _measured(t: Tables):
    c = _parts(t).select("p_partkey", F.lower(F.expr(_NAME)).alias("subreddit"))
    d = t.read("documents").select(F.col("doc_id").alias("post_id"), (F.col("doc_id") % 300 + 1).alias("p_partkey"), F.expr("date_add(date'2024-01-01', int(doc_id % 20))").alias("created_at"))
    posts = landed.saved(d.join(c, "p_partkey").select("post_id", "subreddit", "created_at"), "community-posts")
    said = t.comments.select("post_id", F.concat("author", (F.col("comment_id") % 13).cast("string")).alias("author"))
    return forum.measured_activity(posts, said, posts.agg(F.max("created_at")).scalar())


_SCORED = f"""{_MATCH}, {_ACTIVITY}, mx AS (SELECT rel.* EXCLUDE (posts_7d, commenters), coalesce(ac.posts_7d, 0) AS posts_7d, coalesce(ac.commenters, 0) AS commenters FROM rel LEFT JOIN ac ON lower(name) = low WHERE relevance >= 0.6), pl AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY subscribers DESC, name) <= 3 AS finalist FROM mx),
 act AS (SELECT *, CASE WHEN finalist THEN commenters * 3 + posts_7d ELSE 0 END + subscribers // 100 AS activity, NOT (subscribers < 10 AND (NOT finalist OR posts_7d = 0)) AND NOT over18 AS selected FROM pl),
 sco AS (SELECT *, round(relevance * activity, 2) AS score FROM act)"""


@query("E08_T09_F08_matches", f"WITH {_SCORED} SELECT ticker, name, relevance, activity, score, selected, finalist, selected AND row_number() OVER (PARTITION BY ticker ORDER BY selected DESC, score DESC, subscribers DESC, name DESC) = 1 AS winner FROM sco")
def match(t: Tables):
    """The whole job: candidates by starts of names, their relevance, the measured activity of the finalists, scores, winners."""
    found = landed.saved(communities.matches(_communities(t), _stocks(t), _measured(t)), "candidates")
    best = communities.winners(found).select("ticker", "name", F.lit(True).alias("winner"))
    return found.join(best, ["ticker", "name"], "left").select("ticker", "name", "relevance", "activity", "score", "selected", "finalist", F.coalesce("winner", F.lit(False)).alias("winner"))


@query("F11_discovery_scores", f"""WITH {_ATTR} SELECT s.name, s.ticker, s.relevance, round(s.relevance * (log10(subscribers + 1) * 10 + least(posts_7d, 50)), 2) AS score, s.relevance >= 0.6 AND (subscribers >= 50 OR (posts_7d >= 5 AND subscribers >= 5)) AS selected
 FROM sc s JOIN comm USING (name) WHERE s.relevance >= 0.6""")
def discovery_scores(t: Tables):
    c = _communities(t)
    pairs = communities.relevant_pairs(c, _stocks(t), 50)
    j = pairs.join(c.select("name", "subscribers", "posts_7d"), "name")
    selected = (F.col("relevance") >= 0.6) & ((F.col("subscribers") >= 50) | ((F.col("posts_7d") >= 5) & (F.col("subscribers") >= 5)))
    return j.select("name", "ticker", "relevance", communities.community_score(F.col("subscribers"), F.col("posts_7d"), F.col("relevance")).alias("score"), selected.alias("selected"))


@query("F11_T09_E08_match_rank", """WITH c AS (SELECT ticker, 'c' || date || '_' || subreddit AS name, mention_count * 7 AS subs, mention_count % 60 AS posts, CASE ticker % 3 WHEN 0 THEN 0.6 WHEN 1 THEN 1.0 ELSE 0.4 END::DOUBLE AS rel FROM mentions),
 s AS (SELECT *, round(rel * (log10(subs + 1) * 10 + least(posts, 50)), 2) AS score, rel >= 0.6 AND (subs >= 50 OR (posts >= 5 AND subs >= 5)) AS selected FROM c) SELECT ticker, name, score, selected, row_number() OVER (PARTITION BY ticker ORDER BY selected DESC, score DESC, name) AS rank FROM s""")
def match_rank(t: Tables):
    c = t.mentions.select("ticker", F.concat(F.lit("c"), F.col("date").cast("string"), F.lit("_"), "subreddit").alias("name"), (F.col("mention_count") * 7).alias("subs"), (F.col("mention_count") % 60).alias("posts"), F.when(F.col("ticker") % 3 == 0, 0.6).when(F.col("ticker") % 3 == 1, 1.0).otherwise(0.4).alias("rel"))
    selected = (F.col("rel") >= 0.6) & ((F.col("subs") >= 50) | ((F.col("posts") >= 5) & (F.col("subs") >= 5)))
    scored = c.select("ticker", "name", communities.community_score(F.col("subs"), F.col("posts"), F.col("rel")).alias("score"), selected.alias("selected"))
    return rollups.ranked_within(scored, ["ticker"], [F.desc("selected"), F.desc("score"), F.col("name")])


@query("F05_F06_F08_names", f"""WITH {_COMM}, w AS (SELECT p_partkey, company, list_filter(string_split_regex(regexp_replace(company, '[^\\w\\s&''-]', ' ', 'g'), '\\s+'), lambda x: x <> '') AS ws FROM (SELECT p_partkey, CASE WHEN p_size % 5 = 0 THEN 'The ' ELSE '' END || ({_COMPANY}) || CASE WHEN p_size % 4 = 0 THEN ' Co.' ELSE '' END AS company FROM parts)),
 e AS (SELECT *, coalesce(list_max(list_filter(range(1, len(ws) + 1), lambda i: NOT list_contains({_LEGAL}, lower(ws[i])))), 0) AS last_one FROM w), f AS (SELECT *, ws[1:last_one] AS kept FROM e),
 g AS (SELECT *, array_to_string(kept[CASE WHEN lower(kept[1]) = 'the' THEN 2 ELSE 1 END:], ' ') AS name FROM f)
 SELECT p_partkey, CASE WHEN length(name) >= 3 THEN name END AS short, array_to_string({_SPOKEN}, ' ') AS words FROM g""")
def short_names(t: Tables):
    company = F.concat(F.when(F.col("p_size") % 5 == 0, "The ").otherwise(""), F.expr(_COMPANY), F.when(F.col("p_size") % 4 == 0, " Co.").otherwise(""))
    p = _parts(t).select("p_partkey", company.alias("company"))
    return p.select("p_partkey", names.short_name(F.col("company")).alias("short"), F.array_join(names.spoken_words(F.col("company")), " ").alias("words"))


@query("F05_ticker_keywords", f"WITH {_COMM} SELECT ticker, ticker || '|' || regexp_replace(regexp_replace(company, '(, Inc\\.| Holdings Ltd)$', ''), '[.,]', '', 'g') AS keywords FROM stocks")
def keywords(t: Tables):
    return _stocks(t).select("ticker", F.array_join(names.ticker_keywords(F.col("ticker"), F.col("company")), "|").alias("keywords"))


_STATES = f"""{_SHARES}, v AS (SELECT ticker, subreddit, {_VERDICT} AS verdict FROM shares), m AS (SELECT DISTINCT h.ticker, subreddit FROM hits h, (SELECT DISTINCT subreddit FROM posts WHERE CAST(regexp_extract(subreddit, '[0-9]+') AS INTEGER) % 3 = 0))"""


@query("U05_new_unsupported", f"WITH {_STATES} SELECT ticker, subreddit, 'new' AS state FROM v ANTI JOIN m USING (ticker, subreddit) WHERE verdict = 'stock' UNION ALL SELECT ticker, subreddit, 'unsupported' FROM v SEMI JOIN m USING (ticker, subreddit) WHERE verdict <> 'stock'")
def new_unsupported(t: Tables):
    hits = _hits(t)
    found = forum.mention_shares(t.posts, hits).withColumn("verdict", forum.discovery_verdict(F.col("subreddit") == "src1")).select("ticker", "subreddit", "verdict")
    third = F.regexp_extract("subreddit", "([0-9]+)", 1).cast("int") % 3 == 0
    mapped = found.where(third).select("ticker", "subreddit").distinct()
    return communities.new_and_unsupported(found, mapped)

