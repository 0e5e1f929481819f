"""The domain views as SQL for the oracle: each query gets the views that it names."""

from __future__ import annotations

import re

from chatterlake.functions.money import BANDS

_BAND = " ".join(f"WHEN o_totalprice <= {high} THEN '${low:,} - ${high:,}'" for low, high in BANDS)

VIEWS = {
    "bars": """SELECT ticker, date, first(price ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice) AS open, max(price) AS high, min(price) AS low,
        last(price ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice) AS close, CAST(sum(l_quantity) AS BIGINT) AS volume
        FROM (SELECT *, l_suppkey AS ticker, CAST(l_shipdate AS DATE) AS date, l_extendedprice / l_quantity AS price FROM lineitem) GROUP BY ticker, date""",
    "universe": """SELECT s_suppkey AS ticker, n_name AS sector, n_nationkey % 2 = 1 AS speculative FROM supplier JOIN nation ON s_nationkey = n_nationkey
        UNION ALL SELECT s_suppkey, r_name, n_nationkey % 2 = 1 FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
    "news": """SELECT o_orderkey % (SELECT count(*) FROM supplier) AS ticker, CAST(o_orderdate AS DATE) AS date, o_orderpriority || o_custkey AS link, o_orderkey AS news_id, o_orderpriority AS title FROM orders""",
    "mday": """SELECT user_id AS ticker, CAST(ts AS DATE) AS date, s.subreddit, count(*) AS mention_count, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS upvote_sum
        FROM events, (SELECT DISTINCT event_type AS subreddit FROM events UNION ALL SELECT '') s WHERE s.subreddit = '' OR s.subreddit = event_type GROUP BY ALL""",
    "mentions": """SELECT a.*, b.mention_count AS mentions_24h_ago FROM mday a LEFT JOIN mday b ON a.ticker = b.ticker AND a.subreddit = b.subreddit AND a.date = b.date + 1""",
    "etf_flows": """SELECT ticker AS etf, date, close AS price, close * sum(volume) OVER (PARTITION BY ticker ORDER BY date ROWS UNBOUNDED PRECEDING) AS aum FROM bars""",
    "etf_map": """SELECT sector, etf FROM (SELECT n_name AS sector, s_suppkey AS etf, row_number() OVER (PARTITION BY n_name ORDER BY s_suppkey) AS n FROM supplier JOIN nation ON s_nationkey = n_nationkey) WHERE n <= 3""",
    "deals": """SELECT o_orderkey AS deal_key, n_name AS sector, CAST(o_orderdate AS DATE) AS date, CASE WHEN o_orderstatus <> 'P' THEN o_totalprice END AS amount, o_orderpriority AS deal_type, o_custkey AS custkey
        FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey""",
    "econ": """SELECT o_orderpriority AS series_id, CAST(date_trunc('month', o_orderdate) AS DATE) AS date, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS value FROM orders GROUP BY ALL""",
    "raw_trades": f"""SELECT o_orderkey AS filing_id, c_name AS full_name, 'T' || (o_custkey % 50) AS ticker, CAST(o_orderdate AS DATE) AS transaction_date, CAST(o_orderdate AS DATE) + CAST(o_orderkey % 46 AS INTEGER) AS disclosure_date,
        CASE {_BAND} ELSE 'Over $50,000,000' END AS amount, CASE o_orderstatus WHEN 'F' THEN 'Purchase' WHEN 'O' THEN 'Sale (Full)' ELSE 'Exchange' END AS type, o_orderpriority AS asset_type, c_mktsegment AS party
        FROM orders JOIN customer ON o_custkey = c_custkey""",
    "members": """SELECT c_custkey AS bioguide_id, c_name AS full_name, c_mktsegment IN ('BUILDING', 'MACHINERY') AS is_watched, c_acctbal > 9000 AS is_star FROM customer""",
    "posts": """SELECT doc_id AS post_id, source AS subreddit, 'u' || (doc_id % 41) AS author, split_part(text, chr(10), 1) AS title, text AS body, TIMESTAMP '2024-01-01' + to_minutes(CAST(doc_id AS INTEGER)) AS created_at, n_chars % 97 AS score, n_chars % 23 AS num_comments FROM documents""",
    "sightings": """SELECT user_id AS post_id, ts AS seen_at, event_id, CAST(floor(value) AS BIGINT) AS score, CAST(regexp_extract(props, '"k": *([0-9]+)', 1) AS BIGINT) AS num_comments FROM events""",
    "comments": """SELECT conv_id AS post_id, conv_id * 1000 + turn AS comment_id, CASE WHEN turn > 0 THEN conv_id * 1000 + turn - 1 END AS parent_id, role AS author, text AS body, CAST(length(text) % 50 AS BIGINT) AS score, turn FROM conversations""",
    "tweets": """SELECT event_id AS tweet_id, user_id AS handle, ts AS created_at, event_type || ' ' || props AS text, '$' || upper(replace(event_type, '_', '')) || ' ' || props AS cash_text, event_type, CAST(regexp_extract(props, '"k": *([0-9]+)', 1) AS BIGINT) AS k, p.provider
        FROM events, (VALUES ('A', 10), ('B', 7)) p(provider, m) WHERE event_id % p.m <> 0""",
    "day_log": """SELECT *, CASE (handle * 7 + day(date) * 3 + ascii(provider)) % 11 WHEN 0 THEN 'failed' WHEN 1 THEN 'exhausted' ELSE 'complete' END AS status
        FROM (SELECT handle, CAST(created_at AS DATE) AS date, provider, count(*) AS tweets_fetched FROM tweets GROUP BY ALL)""",
}


def with_views(sql: str) -> str:
    """Put the views that a statement names, and those that they name, before it."""
    needed: list[str] = []

    def need(text: str) -> None:
        for name, body in VIEWS.items():
            if re.search(rf"\b{name}\b", text) and name not in needed:
                need(body)
                if name not in needed:
                    needed.append(name)

    need(sql)
    views = ", ".join(f"{name} AS ({VIEWS[name]})" for name in needed)
    if not views:
        return sql
    sql = sql.strip()
    for start in ("WITH RECURSIVE ", "WITH "):
        if sql.startswith(start):
            return f"{start}{views}, {sql.removeprefix(start)}"
    return f"WITH {views} {sql}"
