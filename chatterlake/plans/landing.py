"""Sources and sinks: files that Spark writes from the driver tables, read back through the readers."""

from __future__ import annotations

from pyspark.sql import functions as F

from chatterlake.functions import labels
from chatterlake.functions import names
from chatterlake.functions import text as tx
from chatterlake.operators import disclosures
from chatterlake.plans.registry import Tables, query, r6
from chatterlake.sources import landed


@query("S01_P13_clean_bars", "SELECT ticker, date, round(close, 6) AS close, round(CASE WHEN volume % 2 = 0 THEN close ELSE close * 0.5::DOUBLE END, 6) AS adj_close, volume FROM bars WHERE volume % 5 <> 0 AND volume % 7 <> 0")
def clean_bars(t: Tables):
    v = F.col("volume")
    raw = t.bars.select("ticker", "date", "open", "high", "low", F.when(v % 7 == 0, float("nan")).otherwise(F.col("close")).alias("close"), F.when(v % 2 == 1, F.col("close") * 0.5).alias("adj_close"), F.when(v % 5 != 0, v).alias("volume"))
    return landed.clean_bars(raw).select("ticker", "date", r6("close"), r6("adj_close"), "volume")


@query("S02_P07_news", "SELECT CAST(ticker AS VARCHAR) AS ticker, title, link, CASE WHEN news_id % 2 = 0 THEN 'wire' ELSE 'desk' END AS publisher, CAST(date AS TIMESTAMP) AS published_at FROM news WHERE news_id % 9 <> 0")
def news(t: Tables):
    n = t.news.withColumn("k", F.col("news_id"))
    title = F.when(F.col("k") % 9 != 0, F.col("title"))
    nested = n.where("k % 2 = 0").select(F.to_json(F.struct(F.col("ticker").cast("string").alias("ticker"), F.struct(title.alias("title"), F.date_format("date", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("pubDate"), F.struct(F.col("link").alias("url")).alias("canonicalUrl"), F.struct(F.lit("wire").alias("displayName")).alias("provider")).alias("content"))).alias("value"))
    flat = n.where("k % 2 = 1").select(F.to_json(F.struct(F.col("ticker").cast("string").alias("ticker"), title.alias("title"), "link", F.lit("desk").alias("publisher"), F.unix_timestamp(F.col("date").cast("timestamp")).alias("providerPublishTime"))).alias("value"))
    path = landed.scratch(t.spark, "news")
    nested.union(flat).write.text(path)
    got = landed.read_news(t.spark, path)
    return got.where(~landed.is_corrupt_news(F.col("title"), F.col("published_at")))


@query("S03_tweets", "SELECT event_id AS tweet_id, event_type AS text, CAST(date_trunc('second', ts) AS TIMESTAMP) AS created_at, event_id % 3 = 0 AS is_reply, user_id AS likes, CASE WHEN event_id % 2 = 0 THEN 'a' || event_id || ',b' ELSE '' END AS media, (SELECT count(*) FROM events WHERE event_id % 50 = 0) AS malformed FROM events WHERE event_id % 50 <> 0")
def tweets(t: Tables):
    e = F.col("event_id")
    media = F.when(e % 2 == 0, F.array(F.struct(F.concat(F.lit("a"), e.cast("string")).alias("url"), F.lit(None).cast("string").alias("media_url")), F.struct(F.lit(None).cast("string").alias("url"), F.lit("b").alias("media_url"))))
    good = F.to_json(F.struct(e.cast("string").alias("id"), F.col("event_type").alias("text"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("createdAt"), F.when(e % 3 == 0, True).alias("isReply"), F.col("user_id").alias("likeCount"), media.alias("media")))
    path = landed.scratch(t.spark, "tweets")
    t.read("events").select(F.when(e % 100 == 0, F.lit('{"id": ')).when(e % 50 == 0, F.lit('{"text": "no id"}')).otherwise(good).alias("value")).write.text(path)
    rows, malformed = landed.read_tweets(t.spark, path)
    return rows.join(F.broadcast(malformed), F.lit(True))


@query("S04_posts", "SELECT 'p' || post_id AS post_id, title, length(body) AS n, score, num_comments, created_at FROM (SELECT *, substr(body, 1, 10000) AS b FROM posts) WHERE post_id % 13 <> 0".replace("length(body)", "length(b)"))
def posts(t: Tables):
    k, p = F.col("post_id"), t.posts
    pid = F.when(k % 13 != 0, F.concat(F.lit("p"), k.cast("string")))
    row = F.struct(F.when(k % 2 == 0, pid).alias("id"), F.when(k % 2 == 1, pid).alias("name"), "title", F.when(k % 2 == 0, F.col("body")).alias("selftext"), F.when(k % 2 == 1, F.col("body")).alias("body"), F.when(k % 3 == 0, F.col("score")).alias("score"), F.when(k % 3 != 0, F.col("score")).alias("ups"), "num_comments", F.unix_timestamp("created_at").cast("double").alias("created_utc"))
    path = landed.scratch(t.spark, "posts")
    p.select(F.to_json(row).alias("value")).write.text(path)
    return landed.read_posts(t.spark, path).select("post_id", "title", F.length("body").cast("long").alias("n"), "score", "num_comments", "created_at")


@query("S04_comments", "SELECT comment_id FROM comments WHERE comment_id % 10 NOT IN (0, 5)")
def comments(t: Tables):
    body = F.when(F.col("comment_id") % 10 == 0, "[deleted]").when(F.col("comment_id") % 10 == 5, "[removed]").otherwise(F.col("body"))
    return landed.without_deleted(t.comments.withColumn("body", body)).select("comment_id")


@query("S05_communities", "SELECT 'sub_' || page_id AS name, page_id * 37 % 5000 AS subscribers, trim(regexp_replace(substr(html, 1, 100), '\\s+', ' ', 'g')) AS title, page_id % 8 = 0 AS over18 FROM pages WHERE page_id % 7 <> 0")
def communities(t: Tables):
    k = F.col("page_id")
    name = F.when(k % 7 == 0, F.lit("no")).otherwise(F.concat(F.lit("sub_"), k.cast("string")))
    row = F.struct(F.when(k % 2 == 0, name).alias("display_name"), name.alias("name"), (k * 37 % 5000).alias("subscribers"), F.substring("html", 1, 100).alias("title"), F.when(k % 8 == 0, True).alias("over_18"))
    path = landed.scratch(t.spark, "communities")
    t.read("pages").select(F.to_json(row).alias("value")).write.text(path)
    return landed.read_communities(t.spark, path).select("name", "subscribers", "title", "over18")


@query("S08_economic_series", "SELECT o_orderpriority AS series_id, CAST(o_orderdate AS DATE) AS date, round(o_totalprice, 2) AS value FROM orders WHERE o_orderkey % 4 NOT IN (0, 1)")
def economic(t: Tables):
    k = F.col("o_orderkey") % 4
    raw = t.read("orders").select(F.col("o_orderpriority").alias("series_id"), F.to_date("o_orderdate").alias("date"), F.when(k == 0, ".").when(k == 1, "").otherwise(F.col("o_totalprice").cast("string")).alias("value"))
    return landed.economic_series(raw).withColumn("value", F.round("value", 2))


@query("S10_valid_deals", "SELECT substr(sha256(CAST(date AS VARCHAR) || '|' || lower(sector) || '|' || 'deal ' || deal_key), 1, 16) AS deal_id, lower(sector) AS sector, CASE WHEN deal_key % 3 <> 0 THEN round(amount, 2) END AS amount, lower(sector) NOT IN ('france', 'china') AS unknown_sector FROM deals WHERE deal_key % 5 <> 0")
def valid_deals(t: Tables):
    k = F.col("deal_key")
    raw = t.deals.select("date", F.concat(F.lit(" "), "sector").alias("sector"), "deal_type", F.lit("abc").alias("ticker"), F.when(k % 5 != 0, F.concat(F.lit("deal "), k.cast("string"))).alias("summary"), F.when(k % 3 == 0, "n/a").otherwise(F.col("amount").cast("string")).alias("amount"))
    return landed.valid_deals(raw, ["france", "china"]).select("deal_id", "sector", F.round("amount", 2).alias("amount"), "unknown_sector")


@query("S11_last_file_wins", "SELECT event_id AS id, CASE WHEN event_id % 3 = 0 THEN 'c' WHEN event_id % 2 = 0 THEN 'b' ELSE 'a' END AS run FROM events")
def run_files(t: Tables):
    e, path = t.read("events").select(F.col("event_id").alias("id"), "event_type"), landed.scratch(t.spark, "runs")
    for run, rows in (("a", e), ("b", e.where("id % 2 = 0")), ("c", e.where("id % 3 = 0"))):
        rows.write.json(f"{path}/{run}")
    return landed.last_file_wins(t.spark, f"{path}/*", "id long, event_type string", "id").select("id", "run")


@query("S12_ledger_lines", "SELECT user_id AS id, max(event_id) AS at, arg_max(event_type, event_id) AS status FROM events WHERE event_id % 20 <> 0 GROUP BY user_id")
def ledger_lines(t: Tables):
    e = F.col("event_id")
    path = landed.scratch(t.spark, "ledger")
    t.read("events").select(F.when(e % 40 == 0, F.lit("{broken")).when(e % 20 == 0, F.lit('{"at": 1}')).otherwise(F.to_json(F.struct(F.col("user_id").alias("id"), e.alias("at"), F.col("event_type").alias("status")))).alias("value")).write.text(path)
    return landed.last_record(t.spark, path, "id long, at long, status string", "id", "at")


@query("S13_catalog_csv", "SELECT p_name || p_partkey AS name, p_partkey * 10 AS subscribers, p_size % 2 = 0 AS is_market, p_brand || '/' || p_size AS signals, round(p_size / 50.0::DOUBLE, 2) AS relevance FROM part")
def catalog_csv(t: Tables):
    c = t.read("part").select(F.concat("p_name", F.col("p_partkey").cast("string")).alias("name"), (F.col("p_partkey") * 10).alias("subscribers"), (F.col("p_size") % 2 == 0).alias("is_market"), F.array("p_brand", F.col("p_size").cast("string")).alias("signals"), (F.col("p_size") / 50.0).alias("relevance"))
    path = landed.scratch(t.spark, "catalog")
    landed.write_catalog(c, path)
    return landed.read_catalog(t.spark, path).withColumn("signals", F.array_join("signals", "/"))


@query("S14_stock_map", "SELECT ticker, string_agg(link, ',' ORDER BY date DESC, link) AS names FROM (SELECT DISTINCT ticker, date, link FROM news) GROUP BY ticker")
def stock_map(t: Tables):
    n = t.news.select("ticker", F.unix_date("date").alias("subscribers"), F.col("link").alias("name")).distinct()
    return landed.stock_map(n).select("ticker", F.array_join("names", ",").alias("names"))


@query("S16_month_store", "SELECT ticker, month, CAST(sum(volume * CASE WHEN month >= DATE '1998-01-01' THEN 2 ELSE 1 END) AS BIGINT) AS volume FROM (SELECT ticker, CAST(date_trunc('month', date) AS DATE) AS month, volume FROM bars) GROUP BY ALL")
def month_store(t: Tables):
    path = landed.scratch(t.spark, "bars")
    b = t.bars.groupBy("ticker", F.trunc("date", "month").alias("month")).agg(F.sum("volume").alias("volume"))
    landed.overwrite_parts(b, path, "month")
    landed.overwrite_parts(b.where("month >= '1998-01-01'").select("ticker", "month", (F.col("volume") * 2).alias("volume")), path, "month")
    return t.spark.read.parquet(path).select("ticker", "month", "volume")


# --- scalar functions and filters ---


@query("F07_F17_F21_F23_text", """SELECT e.event_id, event_id // 3600 % 24 * 3600 + event_id // 60 % 60 * 60 + event_id % 60 AS seconds, 'u' || user_id AS handle, CASE WHEN event_id % 4 = 0 THEN 'sub_' || user_id END AS subreddit, length(event_type) <= 6 AND event_type NOT LIKE '%\\_%' ESCAPE '\\' AS ticker_shape,
 array_to_string(list_sort(list_distinct(string_split(event_type || ' talk ' || user_id, ' '))), ' ') AS parts FROM events e""")
def scalars(t: Tables):
    e, u = F.col("event_id"), F.col("user_id").cast("string")
    iso = F.format_string("PT%dH%dM%dS", F.floor(e / 3600) % 24, F.floor(e / 60) % 60, e % 60)
    sub = F.when(e % 4 == 0, F.concat(F.lit("https://forum.example/r/sub_"), u, F.lit("/new"))).when(e % 4 == 1, F.lit("r/x")).otherwise("has space")
    camel = F.concat(F.col("event_type"), F.lit("Talk "), u)
    return t.read("events").select("event_id", tx.iso_duration(iso).cast("long").alias("seconds"), tx.clean_handle(F.concat(F.lit(" @@U"), u, F.lit(" "))).alias("handle"), tx.clean_subreddit(sub).alias("subreddit"), tx.is_ticker_shape(F.col("event_type")).alias("ticker_shape"), F.array_join(F.array_sort(F.array_distinct(names.humps(camel))), " ").alias("parts"))


@query("F22_earnings_time", "SELECT class, count(*) AS n FROM (SELECT CASE WHEN m < 570 THEN 'BMO' WHEN m >= 960 THEN 'AMC' END AS class FROM (SELECT hour(l) * 60 + minute(l) AS m FROM (SELECT ts - INTERVAL 5 HOUR AS l FROM events))) GROUP BY class")
def earnings_time(t: Tables):
    return t.read("events").select(labels.earnings_class(F.col("ts")).alias("class")).groupBy("class").agg(F.count("*").alias("n"))


_V = "value / 5 - 10"


@query("F25_status_classes", f"""WITH e AS (SELECT event_id, {_V} AS v, event_id % 4 AS k FROM events) SELECT event_id, CASE WHEN v > 0 THEN 'up' WHEN v < 0 THEN 'down' ELSE 'flat' END AS sign, CASE WHEN v / 1000 > 0.002::DOUBLE THEN 'up' WHEN v / 1000 < -0.002::DOUBLE THEN 'down' ELSE 'flat' END AS arrow,
 CASE WHEN k = 1 THEN 'green' WHEN k = 2 THEN 'red' ELSE 'gray' END AS setup, CASE WHEN v / 4 > 1.5::DOUBLE THEN 'green' WHEN v / 4 < 0.5::DOUBLE THEN 'red' ELSE 'gray' END AS volume, CASE WHEN v * 10 >= 60 THEN 'yellow' WHEN v * 10 < 30 THEN 'green' ELSE 'gray' END AS rsi,
 CASE WHEN v * 10 > 70 THEN 'Overbought' WHEN v * 10 >= 60 THEN 'Approaching overbought' WHEN v * 10 < 30 THEN 'Oversold' ELSE 'Neutral' END AS rsi_label, CASE WHEN v / 20 > 0.15::DOUBLE THEN 'yellow' ELSE 'gray' END AS short, CASE WHEN event_id % 11 - 2 BETWEEN 0 AND 6 THEN 'yellow' ELSE 'gray' END AS earnings FROM e""")
def status_classes(t: Tables):
    v, k, e = F.col("v"), F.col("event_id") % 4, F.col("event_id")
    rows = t.read("events").select("event_id", F.expr(_V).alias("v"))
    return rows.select(
        "event_id", labels.sign_class(v).alias("sign"), labels.volatility_arrow(v / 1000).alias("arrow"), labels.setup_class(k == 1, k == 2).alias("setup"), labels.volume_class(v / 4).alias("volume"),
        labels.rsi_class(v * 10).alias("rsi"), labels.rsi_label(v * 10).alias("rsi_label"), labels.short_class(v / 20).alias("short"), labels.earnings_near(e % 11 - 2).alias("earnings"),
    )


@query("F29_window_start", "SELECT user_id, CASE WHEN user_id % 3 = 0 THEN TIMESTAMP '2024-02-01' - INTERVAL 7 DAY ELSE greatest(max(ts) - INTERVAL 3 DAY, TIMESTAMP '2024-02-01' - INTERVAL 14 DAY) END AS start FROM events GROUP BY user_id")
def window_start(t: Tables):
    last = t.read("events").groupBy("user_id").agg(F.max("ts").alias("last"))
    return last.select("user_id", labels.window_start(F.when(F.col("user_id") % 3 != 0, F.col("last")), F.lit("2024-02-01").cast("timestamp")).alias("start"))


_TYPES = "['Corporate Bond', 'Stock', 'Crypto', 'Municipal Security', 'US Treasury Note', 'Mutual Fund', 'Money Market Account', 'Bank Deposit', 'Promissory Note', '', 'Stock Option', 'ETF', 'Hedge Fund']"
_FUNDS = "['SPY', 'VOO', 'VTI', 'QQQ', 'BND', 'IVV', 'SCHB', 'VT', 'ITOT', 'SPTM', 'DIA', 'IWM', 'XLK']"


@query("P05_asset_types", f"""SELECT filing_id, NOT (kind = '' OR regexp_matches(lower(kind), 'stock|option|etf|bond|mutual|treasury|fund')) AS unknown_type FROM (SELECT filing_id, {_TYPES}[filing_id % 13 + 1] AS kind, CASE WHEN filing_id % 5 = 0 THEN {_FUNDS}[filing_id // 13 % 13 + 1] ELSE ticker END AS tk FROM raw_trades)
 WHERE kind NOT IN ('Corporate Bond', 'Municipal Security', 'US Treasury Note', 'Mutual Fund', 'Money Market Account') AND (tk IN ('DIA', 'IWM', 'XLK') OR tk LIKE 'T%')""")
def asset_types(t: Tables):
    pick = lambda words, i: F.element_at(F.from_json(F.lit(words.replace("'", '"')), "array<string>"), i + 1)
    k = F.col("filing_id")
    raw = t.raw_trades.withColumn("asset_type", pick(_TYPES, (k % 13).cast("int"))).withColumn("ticker", F.when(k % 5 == 0, pick(_FUNDS, (F.floor(k / 13) % 13).cast("int"))).otherwise(F.col("ticker")))
    return disclosures.clean_trades(raw).select("filing_id", "unknown_type")


@query("P08_mentions_in_universe", "SELECT 'tk' || ticker AS ticker, date, mention_count FROM mentions WHERE subreddit = '' AND ticker IN (SELECT ticker FROM universe)")
def in_universe(t: Tables):
    """Whatever the case of a ticker's letters."""
    m = t.mentions.where("subreddit = ''").select(F.concat(F.lit("tk"), F.col("ticker").cast("string")).alias("ticker"), "date", "mention_count")
    u = t.universe.select(F.concat(F.lit("Tk"), F.col("ticker").cast("string")).alias("member"))
    return m.join(u, F.upper("ticker") == F.upper("member"), "left_semi")


@query("J21_bars_with_news", "SELECT b.ticker, b.date, count(n.news_id) AS n_news, coalesce(string_agg(CAST(n.news_id AS VARCHAR), ',' ORDER BY n.news_id DESC), '') AS news_ids FROM bars b LEFT JOIN news n ON n.ticker = b.ticker AND n.date = b.date GROUP BY b.ticker, b.date")
def bars_with_news(t: Tables):
    n = t.news.groupBy("ticker", "date").agg(F.reverse(F.array_sort(F.collect_list("news_id"))).alias("ids"))
    j = t.bars.select("ticker", "date").join(n, ["ticker", "date"], "left")
    ids = F.coalesce("ids", F.array().cast("array<bigint>"))
    return j.select("ticker", "date", F.size(ids).cast("long").alias("n_news"), F.array_join(ids, ",").alias("news_ids"))


@query("S09_A16_dimensions", "SELECT sector, count(*) AS members, count(*) FILTER (WHERE speculative) AS speculative FROM universe GROUP BY sector")
def dimensions(t: Tables):
    return t.universe.groupBy("sector").agg(F.count("*").alias("members"), F.count_if("speculative").alias("speculative"))


@query("E11_ticker_report", "WITH x AS (SELECT ticker, date, mention_count FROM mentions WHERE subreddit = '') SELECT sector, CAST(sum(mention_count) AS BIGINT) AS mentions, count(DISTINCT ticker) AS tickers FROM universe JOIN x USING (ticker) GROUP BY sector")
def ticker_report(t: Tables):
    m = t.mentions.where("subreddit = ''").groupBy("ticker").agg(F.sum("mention_count").alias("mentions"))
    return t.universe.join(m, "ticker").groupBy("sector").agg(F.sum("mentions").alias("mentions"), F.count_distinct("ticker").alias("tickers"))

