"""Disclosures, configuration, digests and the ticker's record: readers and whole jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from chatterlake.functions import labels
from chatterlake.operators import disclosures, merges, rollups, signals
from chatterlake.plans.market import _S, _WIDE
from chatterlake.plans.registry import Tables, query, r6
from chatterlake.sources import landed, nested

# --- people and committees as nested documents ---

_COMMITTEE = "CASE r_regionkey WHEN 0 THEN 'House Armed Services Committee' WHEN 1 THEN 'Senate Select Committee on Intelligence' WHEN 2 THEN 'House Agriculture Committee' WHEN 3 THEN 'SENATE BANKING' ELSE 'House Rules' END"
_TITLE = "CASE c_custkey % 5 WHEN 0 THEN 'Chair' WHEN 1 THEN 'Ranking Member' WHEN 2 THEN 'Vice Chair' WHEN 3 THEN 'Chair' ELSE '' END"
_FIRST, _LAST = "substr(c_name, 1, 8)", "'L' || substr(c_name, 10)"
_TERM = "CASE c_custkey % 4 WHEN 0 THEN 'sen' WHEN 1 THEN 'rep' WHEN 2 THEN 'other' END"
_SEAT_OF = "CASE WHEN c_custkey % 2 = 0 THEN 'C' || n_regionkey WHEN c_custkey % 7 = 3 THEN 'C' || n_regionkey || 'X' || n_nationkey ELSE 'C' || n_regionkey || lpad(CAST(n_nationkey AS VARCHAR(9)), 2, '0') END"
_BIO = "CASE WHEN c_custkey % 13 = 0 THEN NULL ELSE 'B' || c_custkey END"

_PEOPLE = f"""leg AS (SELECT {_BIO} AS bioguide_id, {_FIRST} || ' ' || {_LAST} AS full_name, CASE WHEN c_custkey % 3 = 0 THEN 'I' ELSE substr(c_mktsegment, 1, 3) END AS party, CASE c_custkey % 4 WHEN 0 THEN 'senate' WHEN 1 THEN 'house' ELSE 'unknown' END AS chamber FROM customer WHERE c_custkey % 13 <> 0),
 com AS (SELECT 'C' || r_regionkey AS committee_id, {_COMMITTEE} AS name, NULL AS parent_id FROM region UNION ALL SELECT 'C' || n_regionkey || lpad(CAST(n_nationkey AS VARCHAR), 2, '0'), CASE WHEN n_nationkey % 4 = 0 THEN ({_COMMITTEE}) || ' Subcommittee' ELSE n_name END, 'C' || n_regionkey FROM nation JOIN region ON n_regionkey = r_regionkey),
 seat AS (SELECT {_BIO} AS bioguide_id, {_SEAT_OF} AS committee_id, {_TITLE} AS title, CAST(c_custkey % 9 AS INTEGER) AS rank FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_custkey % 13 <> 0)"""


def _people(t: Tables):
    """The documents as they land, as JSON, and the flat tables read from them."""
    path = landed.scratch(t.spark, "people")
    c = t.read("customer").join(F.broadcast(t.read("nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    term = lambda e: F.struct(F.expr(e).alias("type"))
    party = F.when(F.col("c_custkey") % 3 != 0, F.substring("c_mktsegment", 1, 3))
    terms = F.when(F.col("c_custkey") % 4 == 3, F.array().cast("array<struct<type:string>>")).otherwise(F.array(term("'rep'"), term(_TERM)))
    c.select(F.struct(F.expr(_BIO).alias("bioguide")).alias("id"), F.struct(F.expr(_FIRST).alias("first"), F.expr(_LAST).alias("last")).alias("name"), F.struct(party.alias("party"), F.lit("NY").alias("state")).alias("bio"), terms.alias("terms")).write.json(f"{path}/legislators")
    n = t.read("nation").select("n_regionkey", F.struct(F.lpad(F.col("n_nationkey").cast("string"), 2, "0").alias("thomas_id"), F.when(F.col("n_nationkey") % 4 != 0, F.col("n_name")).alias("name")).alias("s")).groupBy("n_regionkey").agg(F.collect_list("s").alias("subcommittees"))
    r = t.read("region").join(n, F.col("r_regionkey") == F.col("n_regionkey"), "left")
    r.select(F.concat(F.lit("C"), F.col("r_regionkey").cast("string")).alias("thomas_id"), F.expr(_COMMITTEE).alias("name"), "subcommittees").write.json(f"{path}/committees")
    member = F.struct(F.when(F.col("c_custkey") % 2 == 0, F.expr(_BIO)).alias("bioguide"), F.when(F.col("c_custkey") % 2 == 1, F.expr(_BIO)).alias("bioguide_id"), F.expr(_TITLE).alias("title"), (F.col("c_custkey") % 9).cast("int").alias("rank"))
    c.groupBy(F.expr(_SEAT_OF.replace("VARCHAR(9)", "STRING")).alias("committee")).agg(F.collect_list(member).alias("members")).write.json(f"{path}/seats")
    return nested.read_legislators(t.spark, f"{path}/legislators"), nested.read_committees(t.spark, f"{path}/committees"), nested.read_seats(t.spark, f"{path}/seats")


@query("S07_nested_people", f"WITH {_PEOPLE} SELECT 'legislator' AS kind, bioguide_id AS id, full_name || '/' || party || '/' || chamber AS what FROM leg UNION ALL SELECT 'committee', committee_id, name || '/' || coalesce(parent_id, '') FROM com UNION ALL SELECT 'seat', bioguide_id, committee_id || '/' || title || '/' || rank FROM seat")
def nested_people(t: Tables):
    leg, com, seat = _people(t)
    a = leg.select(F.lit("legislator").alias("kind"), F.col("bioguide_id").alias("id"), F.concat_ws("/", "full_name", "party", "chamber").alias("what"))
    b = com.select(F.lit("committee").alias("kind"), F.col("committee_id").alias("id"), F.concat_ws("/", "name", F.coalesce("parent_id", F.lit(""))).alias("what"))
    c = seat.select(F.lit("seat").alias("kind"), F.col("bioguide_id").alias("id"), F.concat_ws("/", "committee_id", "title", F.col("rank").cast("string")).alias("what"))
    return a.unionByName(b).unionByName(c)


_WATCHED = f"""{_PEOPLE}, wl AS (SELECT committee_id FROM com WHERE parent_id IS NULL AND regexp_matches(lower(name), 'armed services committee|senate select committee on intelligence|senate banking')),
 lead AS (SELECT s.*, coalesce(c.name, s.committee_id) AS name, w.committee_id IS NOT NULL AS is_full, CASE WHEN c.committee_id IS NULL THEN EXISTS (SELECT 1 FROM wl WHERE starts_with(s.committee_id, wl.committee_id) AND s.committee_id <> wl.committee_id) ELSE c.parent_id IN (SELECT committee_id FROM wl) END AS is_sub
  FROM seat s LEFT JOIN com c USING (committee_id) LEFT JOIN wl w USING (committee_id)),
 watched AS (SELECT bioguide_id, full_name, party, chamber, string_agg(committee_id || ':' || name || ':' || title, ',' ORDER BY committee_id, name, title) AS committees FROM lead JOIN leg USING (bioguide_id) WHERE (is_full AND title IN ('Chair', 'Ranking Member')) OR (is_sub AND NOT is_full AND title = 'Chair') GROUP BY ALL)"""


@query("J08_S07_committees", f"WITH {_WATCHED} SELECT * FROM watched")
def committees(t: Tables):
    leg, com, seat = _people(t)
    got = disclosures.watched_by_committee(seat, com, leg)
    return got.withColumn("committees", F.array_join(F.transform("committees", lambda c: F.concat_ws(":", c.committee_id, c["name"], c.title)), ","))


# --- disclosures from raw rows to the two tables ---

_RAW = f"""raws AS (SELECT r.filing_id, {_FIRST} AS first, {_LAST} AS last, r.ticker, r.amount, r.type, r.transaction_date, r.disclosure_date, c_custkey FROM raw_trades r JOIN orders ON o_orderkey = filing_id JOIN customer ON o_custkey = c_custkey),
 tr AS (SELECT *, CASE WHEN filing_id % 10 = 0 THEN last ELSE first || ' ' || last END AS full_name, CASE WHEN filing_id % 9 = 0 THEN transaction_date ELSE disclosure_date END AS disclosed, CASE WHEN amount LIKE 'Over%' THEN 50000001 ELSE CAST(replace(regexp_extract_all(amount, '[0-9,]+')[1], ',', '') AS DOUBLE) END AS low,
  CASE WHEN amount NOT LIKE 'Over%' THEN CAST(replace(regexp_extract_all(amount, '[0-9,]+')[2], ',', '') AS DOUBLE) END AS high FROM raws WHERE filing_id % 11 <> 0),
 ids AS (SELECT *, substr(sha256(full_name || '|' || CAST(transaction_date AS VARCHAR) || '|' || ticker || '|' || amount), 1, 24) AS trade_id FROM tr),
 once AS (SELECT * FROM ids QUALIFY row_number() OVER (PARTITION BY trade_id ORDER BY filing_id DESC) = 1)"""


def _raw(t: Tables):
    """Raw rows with first and last names, some of either missing; some dates are no dates."""
    c = t.read("customer").select("c_custkey", F.expr(_FIRST).alias("first"), F.expr(_LAST).alias("last"))
    o = t.read("orders").select(F.col("o_orderkey").alias("filing_id"), F.col("o_custkey").alias("c_custkey"))
    r = t.raw_trades.join(o, "filing_id").join(c, "c_custkey")
    k = F.col("filing_id")
    return r.select("filing_id", disclosures.person_name(F.when(k % 10 != 0, F.col("first")), F.col("last"), F.lit(None).cast("string")).alias("full_name"), "ticker", F.lit("Stock").alias("asset_type"), "amount", "type", "party", F.when(k % 11 == 0, "soon").otherwise(F.col("transaction_date").cast("string")).alias("transaction_date"), F.when(k % 9 == 0, "n/a").otherwise(F.col("disclosure_date").cast("string")).alias("disclosure_date"))


@query("S06_raw_disclosures", f"WITH {_RAW} SELECT filing_id, full_name, trade_id, disclosed AS disclosure_date, low AS amount_low, high AS amount_high FROM ids")
def raw_disclosures(t: Tables):
    return disclosures.clean_trades(_raw(t)).select("filing_id", "full_name", "trade_id", "disclosure_date", "amount_low", "amount_high")


_TRACKED = f"""{_WATCHED}, {_RAW}, star AS (SELECT {_BIO} AS bioguide_id, {_FIRST} || ' ' || {_LAST} AS full_name FROM customer WHERE c_acctbal > 9000 AND c_custkey % 13 <> 0),
 mem AS (SELECT coalesce(w.bioguide_id, s.bioguide_id) AS bioguide_id, coalesce(w.full_name, s.full_name) AS full_name, w.bioguide_id IS NOT NULL AS is_watched, s.bioguide_id IS NOT NULL AS is_star FROM watched w FULL JOIN star s ON w.bioguide_id = s.bioguide_id),
 fl AS (SELECT lower(full_name) AS k, max(bioguide_id) AS id FROM mem GROUP BY 1), ll AS (SELECT lower(regexp_extract(full_name, '[^ ]+$')) AS k, min(bioguide_id) AS id FROM mem GROUP BY 1),
 mt AS (SELECT o.*, coalesce(fl.id, ll.id) AS bioguide_id FROM once o LEFT JOIN fl ON lower(o.full_name) = fl.k LEFT JOIN ll ON lower(regexp_extract(o.full_name, '[^ ]+$')) = ll.k),
 rec AS (SELECT * FROM mt WHERE disclosed >= (SELECT max(disclosed) FROM once) - 365), vw AS (SELECT 'star' AS view, * FROM rec SEMI JOIN (SELECT bioguide_id FROM mem WHERE is_star) USING (bioguide_id) UNION ALL SELECT 'committee', * FROM rec SEMI JOIN (SELECT bioguide_id FROM mem WHERE is_watched) USING (bioguide_id))"""


def _members(t: Tables):
    leg, com, seat = _people(t)
    stars = t.read("customer").where("c_acctbal > 9000 and c_custkey % 13 != 0").select(F.expr(_BIO).alias("bioguide_id"), F.concat_ws(" ", F.expr(_FIRST), F.expr(_LAST)).alias("full_name"))
    return disclosures.merge_members(disclosures.watched_by_committee(seat, com, leg), stars)


@query("E04_J09_disclosure_tables", f"""WITH {_TRACKED} SELECT view, trade_id, bioguide_id, CASE WHEN high IS NOT NULL THEN (low + high) / 2 ELSE low END AS estimate, high IS NULL AND low IS NOT NULL AS open_ended, CAST(disclosed - transaction_date AS BIGINT) AS lag_days,
 row_number() OVER (PARTITION BY view ORDER BY disclosed DESC, trade_id) AS place FROM vw""")
def disclosure_tables(t: Tables):
    """The whole job: readers, members merged, raw rows cleaned, one row a trade, people matched, the two views in order."""
    members = landed.saved(_members(t), "members")
    trades = landed.saved(merges.dedupe(disclosures.clean_trades(_raw(t)), ["trade_id"], "filing_id", last=True), "trades")
    rows = landed.saved(disclosures.tracked_views(trades, members, {"star": "is_star", "committee": "is_watched"}, 365), "views")
    rows = disclosures.trade_table(rows).select("view", "trade_id", "bioguide_id", "estimate", "open_ended", "lag_days", "disclosure_date")
    return rollups.ranked_within(rows, ["view"], [F.desc("disclosure_date"), F.col("trade_id")], "place").drop("disclosure_date")


# --- configuration ---


@query("S09_config", """SELECT 'funds' AS kind, n_name AS key, CASE WHEN n_nationkey % 5 = 0 THEN '' ELSE coalesce((SELECT string_agg('ETF' || s_suppkey, ',' ORDER BY 'ETF' || s_suppkey) FROM supplier WHERE s_nationkey = n_nationkey), '') END AS value FROM nation
 UNION ALL SELECT 'star', 'B' || c_custkey, c_name FROM customer WHERE c_acctbal > 9000 AND c_custkey % 3 <> 0""")
def config(t: Tables):
    """Funds as names or objects, sectors without any; stars without an id are skipped."""
    path = landed.scratch(t.spark, "config")
    k = F.col("s_suppkey")
    entry = F.when(k % 2 == 0, F.to_json(F.struct(F.concat(F.lit("etf"), k.cast("string")).alias("ticker"), F.lit("x").alias("note")))).otherwise(F.concat(F.lit('"etf'), k.cast("string"), F.lit('"')))
    s = t.read("supplier").groupBy("s_nationkey").agg(F.array_join(F.array_sort(F.collect_list(entry)), ",").alias("entries"))
    n = t.read("nation").join(s, F.col("n_nationkey") == F.col("s_nationkey"), "left")
    listed = F.when(F.col("n_nationkey") % 5 == 0, "null").otherwise(F.concat(F.lit("["), F.coalesce("entries", F.lit("")), F.lit("]")))
    n.select(F.concat(F.lit('{"sector": "'), "n_name", F.lit('", "entries": '), listed, F.lit("}"))).write.text(f"{path}/funds")
    stars = t.read("customer").where("c_acctbal > 9000").select(F.when(F.col("c_custkey") % 3 != 0, F.concat(F.lit("B"), F.col("c_custkey").cast("string"))).alias("bioguide_id"), F.col("c_name").alias("name"))
    stars.write.json(f"{path}/stars")
    f = nested.read_funds(t.spark, f"{path}/funds").select(F.lit("funds").alias("kind"), F.col("sector").alias("key"), F.array_join(F.array_sort("tickers"), ",").alias("value"))
    return f.unionByName(nested.read_stars(t.spark, f"{path}/stars").select(F.lit("star").alias("kind"), F.col("bioguide_id").alias("key"), F.col("name").alias("value")))


@query("S09_dimensions", """SELECT 'theme' AS kind, n_name AS key, n_regionkey || '|' || CASE WHEN n_nationkey % 2 = 1 THEN 'true' ELSE 'false' END || '|' || coalesce((SELECT string_agg(DISTINCT 'S' || s_suppkey, ',' ORDER BY 'S' || s_suppkey) FROM supplier WHERE s_nationkey = n_nationkey), '') AS value FROM nation WHERE n_nationkey % 6 <> 5
 UNION ALL SELECT 'note', 'T' || c_custkey, coalesce(CASE WHEN c_custkey % 4 = 1 THEN c_mktsegment END, '-') || '|' || coalesce(CASE WHEN c_custkey % 5 = 1 THEN c_name END, '-') FROM customer WHERE c_custkey % 7 <> 0
 UNION ALL SELECT 'company', 'P' || p_partkey, trim(p_name) FROM part WHERE p_size % 5 <> 0
 UNION ALL SELECT 'subreddit', coalesce(CASE WHEN p_size % 9 <> 0 THEN upper('t' || p_partkey) END, 'general') || ' ' || split_part(p_name, ' ', 1), coalesce(CASE p_size % 3 WHEN 0 THEN 'manual' WHEN 1 THEN 'resolved' END, '-') || '|' || coalesce(CASE WHEN p_size % 2 = 0 THEN p_size END, -1) FROM part WHERE p_size % 8 <> 0
 UNION ALL SELECT 'subreddit', coalesce(CASE WHEN p_size % 9 <> 0 THEN upper('t' || p_partkey) END, 'general') || ' other' || p_partkey, '-|-1' FROM part WHERE p_size % 8 <> 0""")
def dimensions(t: Tables):
    """Themes, notes, company names and the map of subreddits, written as they are kept and read back: entries of the wrong shape are
    passed over, words for nothing are null, names repeat without regard to case."""
    path = landed.scratch(t.spark, "dimensions")
    k, size = F.col("p_partkey"), F.col("p_size")
    members = t.read("supplier").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.collect_list(F.concat(F.lit("s"), F.col("s_suppkey").cast("string"))).alias("tickers"))
    themes = t.read("nation").join(members, "n_nationkey", "left").select(F.when(F.col("n_nationkey") % 6 != 5, F.col("n_name")).alias("id"), F.col("n_name").alias("display_name"), F.lit("").alias("description"), F.col("n_regionkey").cast("string").alias("stage"), (F.col("n_nationkey") % 2 == 1).alias("speculative"), F.concat("tickers", "tickers").alias("tickers"))
    themes.write.json(f"{path}/themes")
    c = F.col("c_custkey")
    notes = t.read("customer").select(F.concat(F.when(c % 7 == 0, "t").otherwise("T"), c.cast("string")).alias("ticker"), F.when(c % 4 == 1, F.col("c_mktsegment")).when(c % 4 == 2, " NaN ").when(c % 4 == 3, "none").alias("catalyst"), F.when(c % 5 == 1, F.col("c_name")).when(c % 5 == 2, "").alias("red_flag"))
    notes.write.json(f"{path}/notes")
    parts = t.read("part")
    parts.select(F.concat(F.lit("p"), k.cast("string")).alias("ticker"), F.when(size % 5 == 0, "  ").otherwise(F.concat(F.lit(" "), "p_name")).alias("name")).write.json(f"{path}/companies")
    word = F.split_part("p_name", F.lit(" "), F.lit(1))
    listed = F.when(size % 8 == 0, '"not a list"').otherwise(F.to_json(F.array(word, F.upper(word), F.lit(""), F.concat(F.lit("other"), k.cast("string")))))
    told = F.to_json(F.array(F.struct(F.upper(word).alias("name"), F.when(size % 3 == 0, "manual").when(size % 3 == 1, "resolved").otherwise("guess").alias("source"), F.when(size % 2 == 0, size).alias("subscribers"))))
    ticker = F.when(size % 9 != 0, F.concat(F.lit('"t'), k.cast("string"), F.lit('"'))).otherwise("null")
    parts.select(F.concat(F.lit('{"ticker": '), ticker, F.lit(', "subreddits": '), listed, F.lit(', "details": '), told, F.lit("}"))).write.text(f"{path}/map")
    row = lambda df, kind, key, *values: df.select(F.lit(kind).alias("kind"), key.alias("key"), F.concat_ws("|", *values).alias("value"))
    dash = lambda x: F.coalesce(x, F.lit("-"))
    out = row(nested.read_themes(t.spark, f"{path}/themes"), "theme", F.col("sector"), "stage", F.col("speculative").cast("string"), F.array_join(F.array_sort("tickers"), ","))
    out = out.unionByName(row(nested.read_notes(t.spark, f"{path}/notes"), "note", F.col("ticker"), dash("catalyst"), dash("red_flag")))
    out = out.unionByName(row(nested.read_company_names(t.spark, f"{path}/companies"), "company", F.col("ticker"), "name"))
    names = nested.read_subreddit_map(t.spark, f"{path}/map")
    return out.unionByName(row(names, "subreddit", F.concat_ws(" ", F.coalesce("ticker", F.lit("general")), "name"), dash("source"), F.coalesce("subscribers", F.lit(-1)).cast("string")))


# --- digests and their insights ---

_DIGESTS = """dig AS (SELECT ticker, date AS digest_date FROM mentions WHERE subreddit = ''), ins AS (SELECT user_id AS ticker, CAST(ts AS DATE) AS digest_date, event_type || ':' || event_id AS headline, row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY event_id) AS rank FROM events),
 cut AS (SELECT max(digest_date) - 20 AS first, max(digest_date) AS last FROM dig)"""


@query("M10_J21_digests", f"""WITH {_DIGESTS}, kd AS (SELECT dig.* FROM dig, cut WHERE digest_date >= first), ki AS (SELECT ins.* FROM ins, cut WHERE digest_date >= first)
 SELECT ticker, digest_date, count(rank) AS n_insights, coalesce(string_agg(headline, ',' ORDER BY rank), '') AS headlines FROM kd LEFT JOIN ki USING (ticker, digest_date) WHERE digest_date >= (SELECT last - 7 FROM cut) GROUP BY ALL""")
def digests(t: Tables):
    """Digests and insights older than the days kept go; what is left of the last week comes with its insights in order."""
    d = t.mentions.where("subreddit = ''").select("ticker", F.col("date").alias("digest_date"))
    e = t.read("events").select(F.col("user_id").alias("ticker"), F.to_date("ts").alias("digest_date"), F.concat_ws(":", "event_type", F.col("event_id").cast("string")).alias("headline"), F.col("event_id").alias("rank"))
    now = d.agg(F.max("digest_date").alias("as_of"))
    kept = [merges.keep_since(rollups.with_as_of(x, now), "digest_date", F.date_sub("as_of", 20)) for x in (d, e)]
    recent = kept[0].where(F.col("digest_date") >= F.date_sub("as_of", 7)).drop("as_of")
    ranked = kept[1].drop("as_of").groupBy("ticker", "digest_date").agg(F.array_sort(F.collect_list(F.struct("rank", "headline"))).alias("insights"))
    j = recent.join(ranked, ["ticker", "digest_date"], "left")
    listed = F.coalesce(F.transform("insights", lambda i: i.headline), F.array().cast("array<string>"))
    return j.select("ticker", "digest_date", F.size(listed).cast("long").alias("n_insights"), F.array_join(listed, ",").alias("headlines"))


# --- a ticker's record ---

_TARGETS = "tg AS (SELECT ticker, avg(close) * 1.1::DOUBLE AS mean, min(low) AS low, max(high) AS high, CASE WHEN ticker % 6 = 0 THEN NULL ELSE arg_max(close, date) END AS close FROM bars GROUP BY ticker)"
_TARGET_COLS = """CASE WHEN close > 0 THEN round((mean - close) / close, 6) END AS upside, round(greatest(0, least(100, (mean - low) / nullif(high - low, 0) * 100)), 6) AS mean_position, CASE WHEN close IS NOT NULL THEN round(greatest(0, least(100, (close - low) / nullif(high - low, 0) * 100)), 6) END AS current_position,
 CASE WHEN close > 0 AND mean > close THEN 'green' WHEN close > 0 AND mean < close THEN 'red' ELSE 'gray' END AS upside_class"""


def _targets(t: Tables):
    close = F.when(F.col("ticker") % 6 != 0, F.col("c"))
    g = t.bars.groupBy("ticker").agg((F.avg("close") * 1.1).alias("mean"), F.min("low").alias("low"), F.max("high").alias("high"), F.max_by("close", "date").alias("c")).withColumn("close", close)
    return rollups.target_position(g)


@query("W27_analyst_targets", f"WITH {_TARGETS} SELECT ticker, {_TARGET_COLS} FROM tg")
def targets(t: Tables):
    g = _targets(t)
    return g.select("ticker", r6("upside"), r6("mean_position"), r6("current_position"), "upside_class")


@query("E13_ticker_record", f"""WITH {_WIDE}, {_TARGETS}, tgt AS (SELECT ticker, {_TARGET_COLS} FROM tg), px AS (SELECT ticker, arg_max(close, date) AS close, max(date) AS day FROM bars GROUP BY ticker), sec AS (SELECT ticker, string_agg(sector, ', ' ORDER BY sector) AS sectors FROM universe GROUP BY ticker),
 y AS (SELECT ticker, max(high) AS hi, min(low) AS lo FROM bars WHERE date > (SELECT max(date) FROM bars) - 365 GROUP BY ticker), ev AS (SELECT custkey % (SELECT count(*) FROM supplier) AS ticker, date FROM deals),
 er AS (SELECT ticker, CAST(min(date) FILTER (WHERE date >= DATE '1997-01-01') - DATE '1997-01-01' AS BIGINT) AS days_to_next FROM ev GROUP BY ticker), nn AS (SELECT px.ticker, count(news_id) AS n_news, coalesce(string_agg(CAST(news_id AS VARCHAR), ',' ORDER BY news_id DESC), '') AS day_news FROM px LEFT JOIN news n ON n.ticker = px.ticker AND n.date = px.day GROUP BY px.ticker),
 rn AS (SELECT ticker, string_agg(strftime(date, '%Y-%m-%d') || ' ' || news_id, ',' ORDER BY date DESC, news_id DESC) AS last_news FROM (SELECT * FROM news QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY date DESC, news_id DESC) <= 5) GROUP BY ticker),
 vv AS (SELECT ticker, arg_max(atr_pct, date) - arg_max(atr_pct, date) FILTER (WHERE date <= (SELECT max(date) FROM bars) - 30) AS moved FROM sig WHERE atr_pct IS NOT NULL GROUP BY ticker)
 SELECT px.ticker, coalesce(sectors, '') AS sectors, round(px.close, 6) AS close, n_news, day_news, coalesce(last_news, '') AS last_news, CASE WHEN px.ticker % 23 > 15 THEN 'yellow' ELSE 'gray' END AS short, CASE WHEN moved > 0.002::DOUBLE THEN 'up' WHEN moved < -0.002::DOUBLE THEN 'down' WHEN moved IS NOT NULL THEN 'flat' END AS arrow,
 CASE WHEN near_breakout = 1 THEN 'breakout' WHEN near_breakdown = 1 THEN 'breakdown' ELSE '' END AS flags, round(least(1, greatest(0, (px.close - lo) / nullif(hi - lo, 0))), 6) AS range_position, upside, mean_position, days_to_next,
 CASE WHEN return_1d > 0 THEN 'green' WHEN return_1d < 0 THEN 'red' ELSE 'gray' END AS return_class, CASE WHEN near_breakout = 1 THEN 'green' WHEN near_breakdown = 1 THEN 'red' ELSE 'gray' END AS setup, CASE WHEN volume_ratio > 1.5 THEN 'green' WHEN volume_ratio < 0.5 THEN 'red' ELSE 'gray' END AS volume,
 CASE WHEN rsi > 70 THEN 'Overbought' WHEN rsi >= 60 THEN 'Approaching overbought' WHEN rsi < 30 THEN 'Oversold' WHEN rsi IS NOT NULL THEN 'Neutral' END AS rsi_label, CASE WHEN days_to_next BETWEEN 0 AND 6 THEN 'yellow' ELSE 'gray' END AS earnings
 FROM px LEFT JOIN wide USING (ticker) LEFT JOIN tgt USING (ticker) LEFT JOIN sec USING (ticker) LEFT JOIN y USING (ticker) LEFT JOIN er USING (ticker) LEFT JOIN nn USING (ticker) LEFT JOIN rn USING (ticker) LEFT JOIN vv USING (ticker)""")
def ticker_record(t: Tables):
    """One wide row a ticker: board with its flags, its last day's news and the newest of all days, place in the year's range and
    in the targets, events, classes."""
    t.bars = landed.saved(t.bars, "bars")  # read by five parts
    # the signals of all days are used in one pass, so they aren't stored
    marked = rollups.with_as_of(signals.price_signals(t.bars), rollups.newest(t.bars))
    seen = F.when(F.col("atr_pct").isNotNull(), F.col("date"))
    moved = F.max_by("atr_pct", seen) - F.max_by("atr_pct", F.when(seen <= F.date_sub("as_of", 30), seen))
    latest = landed.saved(rollups.wide_matrix(marked, [*_S, "return_ytd"], moved.alias("moved")), "latest")
    wide, moved = latest.drop("moved"), latest.select("ticker", "moved")
    board = rollups.ticker_board(t.universe, wide, t.bars).select("ticker", "sectors", "flags")
    newest = signals.last_rows(t.news.select("ticker", "date", "news_id"), ["ticker"], 5, F.desc("date"), F.desc("news_id"))
    newest = newest.groupBy("ticker").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "date", "news_id"))), lambda x: F.concat_ws(" ", x.date.cast("string"), x.news_id.cast("string"))), ",").alias("last_news"))
    n = t.read("supplier").count()
    detail = rollups.ticker_detail(t.bars, wide, t.deals.select((F.col("custkey") % n).alias("ticker"), "date"), F.lit("1997-01-01").cast("date"))
    last = t.bars.groupBy("ticker").agg(F.max("date").alias("date"), F.max_by("close", "date").alias("close"))
    news = last.join(t.news.select("ticker", "date", "news_id"), ["ticker", "date"], "left").groupBy("ticker").agg(F.count("news_id").alias("n_news"), F.array_join(F.reverse(F.array_sort(F.collect_list("news_id"))), ",").alias("day_news"))
    j = last.join(detail.drop("close"), "ticker", "left").join(_targets(t).drop("close", "low", "high", "mean"), "ticker", "left").join(board, "ticker", "left").join(news, "ticker", "left").join(newest, "ticker", "left").join(moved, "ticker", "left")
    return j.select(
        "day_news", F.coalesce("last_news", F.lit("")).alias("last_news"), labels.short_class((F.col("ticker") % 23) / 100).alias("short"), labels.volatility_arrow(F.col("moved")).alias("arrow"), F.coalesce("flags", F.lit("")).alias("flags"), "ticker", F.coalesce("sectors", F.lit("")).alias("sectors"), r6("close"), "n_news", r6("range_position"), r6("upside"), r6("mean_position"), "days_to_next", labels.colour_of_sign(F.col("return_1d")).alias("return_class"),
        labels.setup_class(F.col("near_breakout") == 1, F.col("near_breakdown") == 1).alias("setup"), labels.volume_class(F.col("volume_ratio")).alias("volume"), labels.rsi_label(F.col("rsi")).alias("rsi_label"),
        labels.earnings_near(F.col("days_to_next")).alias("earnings"),
    )
