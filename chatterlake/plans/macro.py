"""Macro queries over the monthly order series."""

from __future__ import annotations

from pyspark.sql import functions as F

from chatterlake.operators import macro
from chatterlake.plans.registry import Tables, query, r6


def _s(t: Tables, name: str):
    return t.econ.where(F.col("series_id") == name).select("date", "value")


@query("A27_quarter_ends", "SELECT series_id, CAST(date_trunc('quarter', date) + INTERVAL 3 MONTH - INTERVAL 1 DAY AS DATE) AS quarter_end, round(arg_max(value, date), 2) AS value FROM econ GROUP BY ALL")
def quarter_ends(t: Tables):
    return macro.quarter_ends(t.econ).select("series_id", "quarter_end", F.round("value", 2).alias("value"))


_Q = "q AS (SELECT CAST(date_trunc('quarter', date) + INTERVAL 3 MONTH - INTERVAL 1 DAY AS DATE) AS date, arg_max(value, date) AS value FROM econ WHERE series_id = '1-URGENT' GROUP BY ALL)"


@query("J03_forward_fill", """WITH q AS (SELECT series_id AS pair, CAST(date_trunc('quarter', date) + INTERVAL 3 MONTH - INTERVAL 1 DAY AS DATE) AS date, arg_max(value, date) AS value FROM econ GROUP BY ALL) SELECT e.series_id AS pair, e.date, round(e.value, 2) AS fast, round(q.value, 2) AS slow FROM econ e ASOF JOIN q ON e.series_id = q.pair AND e.date >= q.date""")
def forward_fill(t: Tables):
    """Every series' own quarters laid under its months."""
    q = macro.quarter_ends(t.econ).select(F.col("series_id").alias("pair"), F.col("quarter_end").alias("date"), "value")
    return macro.fill_forward(t.econ.withColumnRenamed("series_id", "pair"), q).select("pair", "date", F.round("fast", 2).alias("fast"), F.round("slow", 2).alias("slow"))


@query("J04_series_ratio", "SELECT a.date, round(a.value / nullif(b.value, 0), 6) AS ratio FROM econ a JOIN econ b USING (date) WHERE a.series_id = '1-URGENT' AND b.series_id = '2-HIGH' AND b.value <> 0")
def series_ratio(t: Tables):
    return macro.ratio(_s(t, "1-URGENT"), _s(t, "2-HIGH")).select("date", r6("ratio"))


@query("J05_W20_basket_rebased", """WITH b AS (SELECT date, avg(value) AS v FROM econ WHERE series_id IN ('3-MEDIUM', '4-NOT SPECIFIED', '5-LOW') GROUP BY date), r AS (SELECT b.date, b.v / e.value AS ratio FROM b JOIN econ e ON e.date = b.date AND e.series_id = '1-URGENT')
 SELECT date, round(ratio / first_value(ratio) OVER (ORDER BY date), 6) AS rebased FROM r""")
def basket(t: Tables):
    members = t.econ.where(F.col("series_id").isin("3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")).select("date", "value")
    return macro.basket_ratio(members, _s(t, "1-URGENT")).select("date", r6("rebased"))


@query("W18_period_change", "SELECT series_id, date, round((value / nullif(lag(value, 12) OVER w, 0) - 1) * 100, 6) AS yoy_pct, round((value / nullif(lag(value, 4) OVER w, 0) - 1) * 100, 6) AS four_row_pct FROM econ WINDOW w AS (PARTITION BY series_id ORDER BY date)")
def period_change(t: Tables):
    a, b = macro.period_change(t.econ, 12), macro.period_change(t.econ, 4)
    return a.select("series_id", "date", r6("change_pct", "yoy_pct")).join(b.select("series_id", "date", r6("change_pct", "four_row_pct")), ["series_id", "date"])


_STRETCH = """j AS (SELECT p.series_id AS pair, p.date, p.value * (SELECT arg_max(value, date) FROM econ WHERE series_id = '5-LOW') / c.value AS r FROM econ p ASOF JOIN (SELECT * FROM econ WHERE series_id = '5-LOW') c ON p.date >= c.date),
 st AS (SELECT pair, date, CASE WHEN count(r) OVER w >= 60 THEN r / avg(r) OVER w END AS stretch FROM j WINDOW w AS (PARTITION BY pair ORDER BY date ROWS BETWEEN 119 PRECEDING AND CURRENT ROW))"""


@query("W19_real_stretch", f"WITH {_STRETCH} SELECT pair, date, round(stretch, 6) AS stretch FROM st")
def stretch(t: Tables):
    return macro.real_stretch(t.econ.withColumnRenamed("series_id", "pair"), _s(t, "5-LOW")).select("pair", "date", r6("stretch"))


_Z = """z AS (SELECT series_id, v AS value, (v - CASE WHEN n >= 12 THEN m1 ELSE m2 END) / nullif(CASE WHEN n >= 12 THEN s1 ELSE s2 END, 0) AS z_score FROM (
 SELECT series_id, any_value(v) AS v, count(value) FILTER (WHERE date >= d - 1825) AS n, avg(value) FILTER (WHERE date >= d - 1825) AS m1, stddev_samp(value) FILTER (WHERE date >= d - 1825) AS s1, avg(value) AS m2, stddev_samp(value) AS s2
 FROM econ JOIN (SELECT series_id, max(date) AS d, arg_max(value, date) AS v FROM econ GROUP BY series_id) USING (series_id) GROUP BY series_id))"""


@query("W21_latest_z", f"WITH {_Z} SELECT series_id, round(value, 2) AS value, round(z_score, 6) AS z_score FROM z")
def latest_z(t: Tables):
    return macro.latest_z(t.econ).select("series_id", F.round("value", 2).alias("value"), r6("z_score"))


@query("W22_sparkline", "SELECT series_id, string_agg(CAST(date AS VARCHAR) || '=' || CAST(CAST(value AS DECIMAL(18,2)) AS VARCHAR), ',' ORDER BY date) AS history FROM (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY date DESC) AS k FROM econ) WHERE k <= 60 GROUP BY series_id")
def sparkline(t: Tables):
    pairs = F.transform(F.array_sort(F.map_entries("history")), lambda e: F.concat(e.key, F.lit("="), e.value.cast("decimal(18,2)").cast("string")))
    return macro.sparkline(t.econ).select("series_id", F.array_join(pairs, ",").alias("history"))


_CONFIG = [("1-URGENT", "market", 1), ("2-HIGH", "market", -1), ("3-MEDIUM", "economy", -1), ("4-NOT SPECIFIED", "economy", 1), ("5-LOW", "context", 1)]


@query("A28_E03_reality_score", f"""WITH {_Z}, c(series_id, bucket, sign) AS (VALUES {", ".join(map(str, _CONFIG))}), j AS (SELECT series_id, bucket, sign * z_score AS s FROM z JOIN c USING (series_id)),
 g AS (SELECT avg(s) FILTER (WHERE bucket = 'market') AS m, avg(s) FILTER (WHERE bucket = 'economy') AS e, string_agg(series_id, ',' ORDER BY series_id) FILTER (WHERE bucket <> 'context' AND s IS NOT NULL) AS used, string_agg(series_id, ',' ORDER BY series_id) FILTER (WHERE bucket = 'context' OR s IS NULL) AS skipped FROM j),
 x AS (SELECT *, coalesce(0.5 * m + 0.5 * e, m, e, 0.0) AS sc FROM g)
 SELECT round(sc, 3) AS score, CASE WHEN sc >= 1.5 THEN 'severe_decoupling' WHEN sc >= 0.5 THEN 'stretched' WHEN sc > -0.5 THEN 'aligned' ELSE 'market_discounting_weakness' END AS band, round(m, 3) AS market_z, round(e, 3) AS economy_z, used, skipped FROM x""")
def reality(t: Tables):
    config = t.spark.createDataFrame(_CONFIG, "series_id string, bucket string, sign int")
    r = macro.reality_score(macro.latest_z(t.econ), config)
    return r.select("score", "band", "market_z", "economy_z", F.array_join("used_indicators", ",").alias("used"), F.array_join("skipped_indicators", ",").alias("skipped"))


_ALL = f"""{_STRETCH}, q AS (SELECT CAST(date_trunc('quarter', date) + INTERVAL 3 MONTH - INTERVAL 1 DAY AS DATE) AS date, arg_max(value, date) AS value FROM econ WHERE series_id = '1-URGENT' GROUP BY ALL),
 bk AS (SELECT b.date, b.v / e.value AS ratio FROM (SELECT date, avg(value) AS v FROM econ WHERE series_id IN ('3-MEDIUM', '4-NOT SPECIFIED', '5-LOW') GROUP BY date) b JOIN econ e ON e.date = b.date AND e.series_id = '1-URGENT'),
 made AS (SELECT 'level_to_quarter' AS series_id, e.date, e.value / q.value AS value FROM (SELECT * FROM econ WHERE series_id = '2-HIGH') e ASOF JOIN q ON e.date >= q.date
  UNION ALL SELECT 'stretch', date, stretch FROM st WHERE pair = '1-URGENT' AND stretch IS NOT NULL UNION ALL SELECT 'yoy', date, v FROM (SELECT date, (value / lag(value, 12) OVER (ORDER BY date) - 1) * 100 AS v FROM econ WHERE series_id = '3-MEDIUM') WHERE v IS NOT NULL
  UNION ALL SELECT 'breadth', a.date, a.value / b.value FROM econ a JOIN econ b USING (date) WHERE a.series_id = '4-NOT SPECIFIED' AND b.series_id = '5-LOW' UNION ALL SELECT 'basket', date, ratio / first_value(ratio) OVER (ORDER BY date) FROM bk),
 zz AS (SELECT series_id, (v - CASE WHEN n >= 12 THEN m1 ELSE m2 END) / nullif(CASE WHEN n >= 12 THEN s1 ELSE s2 END, 0) AS z_score FROM (SELECT series_id, any_value(v) AS v, count(value) FILTER (WHERE date >= d - 1825) AS n, avg(value) FILTER (WHERE date >= d - 1825) AS m1,
  stddev_samp(value) FILTER (WHERE date >= d - 1825) AS s1, avg(value) AS m2, stddev_samp(value) AS s2 FROM made JOIN (SELECT series_id, max(date) AS d, arg_max(value, date) AS v FROM made GROUP BY series_id) USING (series_id) GROUP BY series_id)),
 sp AS (SELECT series_id, count(*) AS points FROM (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY date DESC) AS k FROM made) WHERE k <= 60 GROUP BY series_id), cf(series_id, bucket, sign) AS (VALUES ('level_to_quarter', 'market', 1), ('stretch', 'market', 1), ('yoy', 'economy', -1), ('breadth', 'economy', 1), ('basket', 'context', 1)),
 gg AS (SELECT avg(sign * z_score) FILTER (WHERE bucket = 'market') AS m, avg(sign * z_score) FILTER (WHERE bucket = 'economy') AS e FROM zz JOIN cf USING (series_id))"""


@query("E03_indicators", f"""WITH {_ALL} SELECT series_id, round(z_score, 5) AS z_score, points, NULL AS band FROM zz JOIN sp USING (series_id)
 UNION ALL SELECT 'score', round(coalesce(0.5 * m + 0.5 * e, m, e, 0.0), 3), NULL, CASE WHEN coalesce(0.5 * m + 0.5 * e, m, e, 0.0) >= 1.5 THEN 'severe_decoupling' WHEN coalesce(0.5 * m + 0.5 * e, m, e, 0.0) >= 0.5 THEN 'stretched' WHEN coalesce(0.5 * m + 0.5 * e, m, e, 0.0) > -0.5 THEN 'aligned' ELSE 'market_discounting_weakness' END FROM gg""")
def indicators(t: Tables):
    """The whole job: indicators made from series, their z-scores and sparklines, and the score over their buckets."""
    q = macro.quarter_ends(t.econ.where("series_id = '1-URGENT'")).select(F.lit("q").alias("pair"), F.col("quarter_end").alias("date"), "value")
    named = lambda df, name, value: df.select(F.lit(name).alias("series_id"), "date", value.alias("value")).where("value is not null")
    high = _s(t, "2-HIGH").select(F.lit("q").alias("pair"), "date", "value")
    parts = [
        named(macro.fill_forward(high, q), "level_to_quarter", F.col("fast") / F.col("slow")),
        named(macro.real_stretch(_s(t, "1-URGENT").select(F.lit("p").alias("pair"), "date", "value"), _s(t, "5-LOW")), "stretch", F.col("stretch")),
        named(macro.period_change(t.econ.where("series_id = '3-MEDIUM'"), 12), "yoy", F.col("change_pct")),
        named(macro.ratio(_s(t, "4-NOT SPECIFIED"), _s(t, "5-LOW")), "breadth", F.col("ratio")),
        named(macro.basket_ratio(t.econ.where(F.col("series_id").isin("3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")), _s(t, "1-URGENT")), "basket", F.col("rebased")),
    ]
    made = parts[0]
    for part in parts[1:]:
        made = made.unionByName(part)
    z = macro.latest_z(made)
    config = t.spark.createDataFrame([("level_to_quarter", "market", 1), ("stretch", "market", 1), ("yoy", "economy", -1), ("breadth", "economy", 1), ("basket", "context", 1)], "series_id string, bucket string, sign int")
    lines = macro.sparkline(made).select("series_id", F.size("history").cast("long").alias("points"))
    each = z.join(lines, "series_id").select("series_id", F.round("z_score", 5).alias("z_score"), "points", F.lit(None).cast("string").alias("band"))
    return each.unionByName(macro.reality_score(z, config).select(F.lit("score").alias("series_id"), F.col("score").alias("z_score"), F.lit(None).cast("long").alias("points"), "band"))


@query("P06_trailing_window", "SELECT series_id, date, round(value, 2) AS value FROM econ, (SELECT max(date) AS d FROM econ) WHERE date BETWEEN d - 400 AND d")
def trailing(t: Tables):
    from chatterlake.operators.rollups import newest

    return macro.since(t.econ, newest(t.econ), 400).select("series_id", "date", F.round("value", 2).alias("value"))


@query("A26_option_summary", """WITH o AS (SELECT l_suppkey AS ticker, CASE l_linestatus WHEN 'O' THEN 'call' ELSE 'put' END AS side, CAST(l_quantity AS BIGINT) AS open_interest, CAST(l_linenumber AS BIGINT) AS volume FROM lineitem)
 SELECT ticker, CAST(sum(open_interest) FILTER (WHERE side = 'call') AS BIGINT) AS call_open_interest, CAST(sum(volume) FILTER (WHERE side = 'call') AS BIGINT) AS call_volume, CAST(sum(open_interest) FILTER (WHERE side = 'put') AS BIGINT) AS put_open_interest, CAST(sum(volume) FILTER (WHERE side = 'put') AS BIGINT) AS put_volume,
 round(sum(open_interest) FILTER (WHERE side = 'put') / nullif(sum(open_interest) FILTER (WHERE side = 'call'), 0), 6) AS put_call_ratio FROM o GROUP BY ticker""")
def options(t: Tables):
    side = F.when(F.col("l_linestatus") == "O", "call").otherwise("put")
    chain = t.read("lineitem").select(F.col("l_suppkey").alias("ticker"), side.alias("side"), F.col("l_quantity").cast("long").alias("open_interest"), F.col("l_linenumber").cast("long").alias("volume"))
    return macro.option_summary(chain).withColumn("put_call_ratio", F.round("put_call_ratio", 6))
