"""Signals, boards and sector roll-ups over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from chatterlake.operators import rollups, series, signals
from chatterlake.plans.registry import Tables, query, r6
from chatterlake.sources import landed

_W = "WINDOW w AS (PARTITION BY ticker ORDER BY date)"


def _over(a: int, b: int) -> str:
    side = lambda x: f"{-x} PRECEDING" if x < 0 else "CURRENT ROW"
    return f"OVER (PARTITION BY ticker ORDER BY date ROWS BETWEEN {side(a)} AND {side(b)})"


def _ret(n: int) -> str:
    lag = f"lag(close, {n}) OVER w"
    return f"(close - {lag}) / nullif({lag}, 0)"


def _rsi(change: str) -> str:
    up, down = f"sum(greatest({change}, 0)) {_over(-13, 0)} / 14", f"sum(greatest(-{change}, 0)) {_over(-13, 0)} / 14"
    return f"CASE WHEN count({change}) {_over(-13, 0)} = 14 THEN CASE WHEN {down} = 0 THEN 100.0 WHEN {up} = 0 THEN 0.0 ELSE 100 - 100 / (1 + ({up}) / ({down})) END END"


SIGNALS_SQL = f"""sig AS (SELECT ticker, date, close, {_ret(1)} AS return_1d, {_ret(5)} AS return_5d, {_ret(20)} AS return_20d, {_ret(21)} AS return_1m, {_ret(252)} AS return_1y,
 CASE WHEN count(volume) {_over(-30, -1)} >= 10 THEN volume / nullif(avg(volume) {_over(-30, -1)}, 0) END AS volume_ratio,
 CASE WHEN count(*) {_over(-29, 0)} = 30 THEN close / nullif(max(close) {_over(-29, 0)}, 0) - 1 END AS dist_high,
 CASE WHEN count(*) {_over(-29, 0)} = 30 THEN close / nullif(min(close) {_over(-29, 0)}, 0) - 1 END AS dist_low,
 {_rsi("change")} AS rsi, {_rsi("vchange")} AS volume_rsi,
 CASE WHEN count(swing) {_over(-13, 0)} = 14 THEN avg(swing) {_over(-13, 0)} END AS atr,
 CASE WHEN count(swing) {_over(-13, 0)} = 14 THEN avg(swing) {_over(-13, 0)} / nullif(close, 0) END AS atr_pct,
 CASE WHEN count(*) {_over(-49, 0)} = 50 THEN CAST(close > avg(close) {_over(-49, 0)} AS INTEGER)::DOUBLE END AS above_sma50
 FROM (SELECT *, close - lag(close) OVER w AS change, CAST(volume - lag(volume) OVER w AS DOUBLE) AS vchange,
   CASE WHEN lag(close) OVER w IS NOT NULL THEN greatest(high - low, abs(high - lag(close) OVER w), abs(low - lag(close) OVER w)) END AS swing FROM bars {_W}) {_W}),
 allsig AS (SELECT *, CASE WHEN dist_high IS NOT NULL THEN CAST(dist_high > -0.02 AS INTEGER)::DOUBLE END AS near_breakout, CASE WHEN dist_low IS NOT NULL THEN CAST(dist_low < 0.02 AS INTEGER)::DOUBLE END AS near_breakdown FROM sig)"""
YTD_SQL = """SELECT ticker, date, CASE WHEN min(date) OVER (PARTITION BY ticker) < date_trunc('year', date) THEN (close - f) / nullif(f, 0) END AS return_ytd
 FROM (SELECT *, first_value(close) OVER (PARTITION BY ticker, year(date) ORDER BY date) AS f FROM bars)"""
LONG_SQL = f"""{SIGNALS_SQL}, ytd AS ({YTD_SQL}),
 longsig AS (SELECT * FROM (UNPIVOT (SELECT * EXCLUDE (close) FROM allsig JOIN ytd USING (ticker, date)) ON COLUMNS(* EXCLUDE (ticker, date)) INTO NAME signal_name VALUE value) WHERE value IS NOT NULL)"""


def _r6(cols: list[str]) -> str:
    return ", ".join(f"round({c}, 6) AS {c}" for c in cols)


_S = signals.SIGNALS


@query("W01_W10_signals", f"WITH {SIGNALS_SQL} SELECT ticker, date, {_r6(_S)} FROM allsig")
def price_signals(t: Tables):
    return signals.price_signals(t.bars).select("ticker", "date", *(r6(c) for c in _S))


@query("W02_ytd_return", f"SELECT ticker, date, round(return_ytd, 6) AS return_ytd FROM ({YTD_SQL})")
def ytd(t: Tables):
    return signals.ytd_return(t.bars).select("ticker", "date", r6("return_ytd"))


@query("W11_W12_mention_velocity", """SELECT ticker, date, round(mention_count / nullif(mentions_24h_ago, 0), 6) AS velocity_24h,
 round(CASE WHEN count(*) OVER p = 7 THEN mention_count / nullif(avg(mention_count) OVER p, 0) END, 6) AS velocity_7d FROM mentions WHERE subreddit = ''
 WINDOW p AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING)""")
def velocity(t: Tables):
    return signals.mention_velocity(t.mentions).select("ticker", "date", r6("velocity_24h"), r6("velocity_7d"))


@query("W13_W14_W16_chart_lines", f"""SELECT ticker, date, round(m, 6) AS sma, round(m + 2 * s, 6) AS upper, round(m - 2 * s, 6) AS lower, round(greatest(1.0, v), 6) AS avg_volume_30d FROM (
 SELECT ticker, date, CASE WHEN count(*) {_over(-19, 0)} = 20 THEN avg(close) {_over(-19, 0)} END AS m, CASE WHEN count(*) {_over(-19, 0)} = 20 THEN stddev_samp(close) {_over(-19, 0)} END AS s, avg(volume) {_over(-30, -1)} AS v FROM bars)""")
def chart(t: Tables):
    return signals.chart_lines(t.bars).select("ticker", "date", *(r6(c) for c in ("sma", "upper", "lower", "avg_volume_30d")))


@query("W15_wilder_rsi", """WITH RECURSIVE d AS (SELECT ticker, date, close - lag(close) OVER (PARTITION BY ticker ORDER BY date) AS c, row_number() OVER (PARTITION BY ticker ORDER BY date) AS n FROM bars),
 g AS (SELECT ticker, date, n, CAST(NULL AS DOUBLE) AS u, CAST(NULL AS DOUBLE) AS l FROM d WHERE n = 1
  UNION ALL SELECT d.ticker, d.date, d.n, CASE WHEN g.u IS NULL THEN greatest(d.c, 0) ELSE g.u * (1 - 1/14.0::DOUBLE) + greatest(d.c, 0) * (1/14.0::DOUBLE) END, CASE WHEN g.l IS NULL THEN greatest(-d.c, 0) ELSE g.l * (1 - 1/14.0::DOUBLE) + greatest(-d.c, 0) * (1/14.0::DOUBLE) END
  FROM g JOIN d ON d.ticker = g.ticker AND d.n = g.n + 1)
 SELECT ticker, date, round(CASE WHEN n > 14 THEN CASE WHEN l = 0 AND u > 0 THEN 100.0 WHEN l = 0 THEN NULL ELSE 100 - 100 / (1 + u / l) END END, 5) AS wilder_rsi FROM g""")
def wilder(t: Tables):
    return series.wilder_rsi(t.bars).select("ticker", "date", F.round("wilder_rsi", 5).alias("wilder_rsi"))


@query("E01_long_signals", f"WITH {LONG_SQL} SELECT ticker, date, signal_name, round(value, 6) AS value FROM longsig")
def long_signals(t: Tables):
    return signals.long_signals(t.bars).select("ticker", "date", "signal_name", r6("value"))


@query("W23_latest_signals", f"WITH {LONG_SQL} SELECT ticker, signal_name, max(date) AS date, round(arg_max(value, date), 6) AS value FROM longsig GROUP BY ALL")
def latest_signals(t: Tables):
    return signals.latest_signals(t.bars).select("ticker", "signal_name", "date", r6("value"))


@query("W24_last_bars", "SELECT ticker, date, round(close, 6) AS close, rank FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY date DESC) AS rank FROM bars) WHERE rank <= 60")
def last_bars(t: Tables):
    return signals.last_rows(t.bars, ["ticker"], 60, F.desc("date")).select("ticker", "date", r6("close"), "rank")


_WIDE = f"""{LONG_SQL}, wide AS (SELECT l.ticker, l.date, {", ".join(f"max(CASE WHEN signal_name = '{c}' THEN value END) AS {c}" for c in [*_S, "return_ytd"])}
 FROM longsig l JOIN (SELECT ticker, max(date) AS date FROM longsig GROUP BY ticker) m USING (ticker, date) GROUP BY ALL)"""


@query("A08_wide_matrix", f"WITH {_WIDE} SELECT ticker, date, {_r6([*_S, 'return_ytd'])} FROM wide")
def wide(t: Tables):
    return rollups.wide_matrix(signals.price_signals(t.bars), [*_S, "return_ytd"]).select("ticker", "date", *(r6(c) for c in [*_S, "return_ytd"]))


@query("J01_ticker_board", f"""WITH {_WIDE}, sec AS (SELECT ticker, string_agg(sector, ', ' ORDER BY sector) AS sectors, bool_or(speculative) AS speculative FROM universe GROUP BY ticker),
 px AS (SELECT ticker, arg_max(close, date) AS close FROM bars GROUP BY ticker)
 SELECT s.ticker, s.sectors, s.speculative, round(px.close, 6) AS close, round(w.return_1m, 6) AS return_1m, round(w.rsi, 6) AS rsi, round(w.volume_ratio, 6) AS volume_ratio,
 CASE WHEN w.near_breakout = 1 THEN 'breakout' WHEN w.near_breakdown = 1 THEN 'breakdown' ELSE '' END AS flags FROM sec s LEFT JOIN wide w USING (ticker) LEFT JOIN px USING (ticker)""")
def board(t: Tables):
    b = rollups.ticker_board(t.universe, rollups.wide_matrix(signals.price_signals(t.bars), [*_S, "return_ytd"]), t.bars)
    return b.select("ticker", "sectors", "speculative", r6("close"), r6("return_1m"), r6("rsi"), r6("volume_ratio"), "flags")


@query("P09_ticker_screen", f"""WITH {_WIDE} SELECT w.ticker, round(w.volume_ratio, 6) AS volume_ratio, row_number() OVER (ORDER BY round(volume_ratio, 6) DESC NULLS LAST, w.ticker) AS rank FROM wide w
 WHERE EXISTS (SELECT 1 FROM universe u WHERE u.ticker = w.ticker AND u.sector IN ('ASIA', 'EUROPE')) AND NOT EXISTS (SELECT 1 FROM universe u WHERE u.ticker = w.ticker AND u.speculative)""")
def screen(t: Tables):
    return rollups.ticker_screen(t.universe, rollups.wide_matrix(signals.price_signals(t.bars), [*_S, "return_ytd"]), ["ASIA", "EUROPE"], speculative=False)


@query("A01_sector_means", f"""WITH {LONG_SQL}, lat AS (SELECT ticker, signal_name, arg_max(value, date) AS value FROM longsig GROUP BY ALL)
 SELECT sector, round(avg(CASE WHEN signal_name = 'return_1m' THEN value END), 6) AS return_1m, round(avg(CASE WHEN signal_name = 'rsi' THEN value END), 6) AS rsi, round(avg(CASE WHEN signal_name = 'above_sma50' THEN value END), 6) AS above_sma50
 FROM universe LEFT JOIN lat USING (ticker) GROUP BY sector""")
def sector_means(t: Tables):
    m = rollups.sector_signal_means(signals.price_signals(t.bars), t.universe, ["return_1m", "rsi", "above_sma50"])
    return m.select("sector", r6("return_1m"), r6("rsi"), r6("above_sma50"))


_AS_OF_NEWS = "(SELECT max(date) FROM news)"


@query("A02_news_heat", f"""SELECT sector, CASE WHEN c30 > 0 THEN round(c7 / (c30 / (30 / 7.0::DOUBLE)), 6) END AS news_heat FROM (
 SELECT u.sector, count(n.news_id) FILTER (WHERE n.date >= {_AS_OF_NEWS} - 7) AS c7, count(n.news_id) FILTER (WHERE n.date >= {_AS_OF_NEWS} - 30) AS c30 FROM universe u LEFT JOIN news n USING (ticker) GROUP BY u.sector)""")
def news_heat(t: Tables):
    return rollups.news_heat(t.news, t.universe).select("sector", r6("news_heat"))


_AS_OF_DEALS = "(SELECT max(date) FROM deals)"


@query("A03_sector_deals", f"""SELECT sector, round(CAST(sum(CAST(amount AS DECIMAL(18,2))) FILTER (WHERE date >= {_AS_OF_DEALS} - 30) AS DOUBLE), 2) AS deal_sum, count(*) FILTER (WHERE date >= {_AS_OF_DEALS} - 30) AS deal_count,
 CAST({_AS_OF_DEALS} - max(date) AS BIGINT) AS days_since FROM deals GROUP BY sector""")
def sector_deals(t: Tables):
    return rollups.sector_deals(t.deals).select("sector", F.round("deal_sum", 2).alias("deal_sum"), "deal_count", "days_since")


FLOW_SQL = """flow AS (SELECT etf, date, aum - p - p * (price / nullif(pp, 0) - 1) AS net_flow FROM (SELECT *, nullif(lag(aum) OVER w, 0) AS p, lag(price) OVER w AS pp FROM etf_flows WINDOW w AS (PARTITION BY etf ORDER BY date)))"""
RATIO_SQL = f"""{FLOW_SQL}, ratio AS (SELECT etf, CASE WHEN n30 >= 15 AND n5 >= 1 THEN a5 / nullif(a30, 0) END AS ratio FROM (SELECT etf,
 count(net_flow) FILTER (WHERE date > d - 30) AS n30, count(net_flow) FILTER (WHERE date > d - 5) AS n5, avg(net_flow) FILTER (WHERE date > d - 30) AS a30, avg(net_flow) FILTER (WHERE date > d - 5) AS a5
 FROM flow, (SELECT max(date) - 0 AS d FROM flow) GROUP BY etf))"""


@query("W17_implied_flow", f"WITH {FLOW_SQL} SELECT etf, date, round(net_flow, 4) AS net_flow FROM flow")
def implied_flow(t: Tables):
    return rollups.implied_flow(t.etf_flows).select("etf", "date", F.round("net_flow", 4).alias("net_flow"))


@query("A04_flow_ratio", f"WITH {RATIO_SQL} SELECT sector, round(avg(ratio), 6) AS flow_ratio FROM etf_map LEFT JOIN ratio USING (etf) GROUP BY sector")
def flow_ratio(t: Tables):
    return rollups.sector_flow_ratio(rollups.implied_flow(t.etf_flows), t.etf_map).select("sector", r6("flow_ratio"))


_ASOF = f"""{LONG_SQL}, d AS (SELECT max(date) AS now FROM bars), a AS (SELECT ticker, arg_max(value, date) AS now_value FROM longsig, d WHERE signal_name = 'atr_pct' AND date <= now GROUP BY ticker),
 b AS (SELECT ticker, arg_max(value, date) AS old_value FROM longsig, d WHERE signal_name = 'atr_pct' AND date <= now - 30 GROUP BY ticker)"""


@query("J02_asof_signal", f"WITH {_ASOF} SELECT ticker, round(old_value, 6) AS value FROM b")
def as_of_signal(t: Tables):
    long = signals.long_signals(t.bars)
    return rollups.as_of(long.where("signal_name = 'atr_pct'"), ["ticker"], rollups.newest(t.bars), 30).select("ticker", r6("value"))


@query("J02_asof_all_dates", f"""WITH {SIGNALS_SQL}, n AS (SELECT DISTINCT ticker, date FROM news), m AS (SELECT ticker, date, CASE WHEN CAST(strftime(date, '%d') AS INTEGER) % 7 = 0 THEN NULL ELSE atr_pct END AS value FROM sig)
 SELECT n.ticker, n.date, round(m.value, 6) AS value FROM n ASOF LEFT JOIN m ON n.ticker = m.ticker AND n.date >= m.date""")
def as_of_all(t: Tables):
    """The range signal at every day with news; it is missing on some days, and then stays so."""
    known = signals.price_signals(t.bars).select("ticker", "date", F.when(F.dayofmonth("date") % 7 != 0, F.col("atr_pct")).alias("value"))
    days = t.news.select("ticker", "date").distinct()
    return series.as_of_join(days, known, ["ticker"]).select("ticker", "date", r6("value"))


@query("A05_volatility_change", f"WITH {_ASOF} SELECT sector, round(avg(now_value) - avg(old_value), 6) AS volatility_change FROM universe JOIN a USING (ticker) JOIN b USING (ticker) GROUP BY sector")
def volatility_change(t: Tables):
    return rollups.sector_signals(signals.price_signals(t.bars), t.universe, [], rollups.newest(t.bars)).select("sector", r6("volatility_change"))


_HEAT = f"""{_ASOF}, {RATIO_SQL}, lat AS (SELECT ticker, signal_name, arg_max(value, date) AS value FROM longsig GROUP BY ALL),
 s1 AS (SELECT sector, count(DISTINCT ticker) AS constituents, avg(CASE WHEN signal_name = 'return_1m' THEN value END) AS return_1m, avg(CASE WHEN signal_name = 'above_sma50' THEN value END) AS above_sma50 FROM universe LEFT JOIN lat USING (ticker) GROUP BY sector),
 s2 AS (SELECT sector, CASE WHEN c30 > 0 THEN c7 / (c30 / (30 / 7.0::DOUBLE)) END AS news_heat FROM (SELECT u.sector, count(n.news_id) FILTER (WHERE n.date >= {_AS_OF_NEWS} - 7) AS c7, count(n.news_id) FILTER (WHERE n.date >= {_AS_OF_NEWS} - 30) AS c30 FROM universe u LEFT JOIN news n USING (ticker) GROUP BY u.sector)),
 s3 AS (SELECT sector, CAST(sum(CAST(amount AS DECIMAL(18,2))) FILTER (WHERE date >= {_AS_OF_DEALS} - 30) AS DOUBLE) AS deal_sum, count(*) FILTER (WHERE date >= {_AS_OF_DEALS} - 30) AS deal_count, CAST({_AS_OF_DEALS} - max(date) AS BIGINT) AS days_since FROM deals GROUP BY sector),
 s4 AS (SELECT sector, avg(ratio) AS flow_ratio FROM etf_map LEFT JOIN ratio USING (etf) GROUP BY sector),
 s5 AS (SELECT sector, avg(now_value) - avg(old_value) AS volatility_change FROM universe JOIN a USING (ticker) JOIN b USING (ticker) GROUP BY sector),
 heat AS (SELECT s1.*, news_heat, deal_sum, coalesce(deal_count, 0) AS deal_count, days_since, flow_ratio, volatility_change FROM s1 LEFT JOIN s2 USING (sector) LEFT JOIN s3 USING (sector) LEFT JOIN s4 USING (sector) LEFT JOIN s5 USING (sector))"""


def _heat(t: Tables):
    """Bars and memberships are read by several parts: made once."""
    t.bars, t.universe = landed.saved(t.bars, "bars"), landed.saved(t.universe, "universe")
    newest = rollups.newest(t.bars)
    recent = signals.price_signals(rollups.recent_bars(t.bars, newest))
    heat = rollups.sector_heat(recent, t.universe, t.news, t.deals, rollups.implied_flow(t.etf_flows), t.etf_map, newest)
    return landed.saved(heat, "heat")


@query("A06_sector_heat", f"""WITH {_HEAT} SELECT sector, constituents, round(return_1m, 6) AS return_1m, round(above_sma50, 6) AS above_sma50, round(news_heat, 6) AS news_heat, round(deal_sum, 2) AS deal_sum, deal_count, days_since, round(flow_ratio, 6) AS flow_ratio, round(volatility_change, 6) AS volatility_change FROM heat""")
def sector_heat(t: Tables):
    return _heat(t).select("sector", "constituents", r6("return_1m"), r6("above_sma50"), r6("news_heat"), F.round("deal_sum", 2).alias("deal_sum"), "deal_count", "days_since", r6("flow_ratio"), r6("volatility_change"))


def _tercile(c: str, low_good: bool) -> str:
    q = f"quantile_cont({c}, [1/3.0::DOUBLE, 2/3.0::DOUBLE]) OVER ()"
    top, mid = ("red", "yellow") if low_good else ("green", "yellow")
    bottom = "green" if low_good else "red"
    return f"CASE WHEN {c} IS NULL OR count({c}) OVER () < 3 THEN NULL WHEN {c} >= ({q})[2] THEN '{top}' WHEN {c} >= ({q})[1] THEN '{mid}' ELSE '{bottom}' END AS {c}_class"


_TERCILES = {"return_1m": False, "news_heat": False, "days_since": True}


@query("W26_E02_sector_terciles", f"WITH {_HEAT} SELECT sector, {', '.join(_tercile(c, b) for c, b in _TERCILES.items())} FROM heat")
def sector_terciles(t: Tables):
    return rollups.terciles(_heat(t), "sector", _TERCILES)


@query("A07_sector_card", f"""WITH {_WIDE} SELECT sector, count(*) AS members, round(avg(return_5d), 6) AS return_5d, round(avg(CASE WHEN near_breakout > 0 THEN 1.0 ELSE 0.0 END), 6) AS near_breakout FROM universe LEFT JOIN wide USING (ticker) GROUP BY sector""")
def sector_card(t: Tables):
    w = rollups.wide_matrix(signals.price_signals(t.bars), [*_S, "return_ytd"])
    return rollups.sector_card(t.universe, w).select("sector", "members", r6("return_5d"), r6("near_breakout"))


@query("A31_constituents", f"""WITH {_WIDE}, n7 AS (SELECT ticker, count(*) AS news_7d FROM news WHERE date >= {_AS_OF_NEWS} - 7 GROUP BY ticker)
 SELECT sector, u.ticker, round(return_1m, 6) AS return_1m, round(rsi, 6) AS rsi, coalesce(news_7d, 0) AS news_7d, row_number() OVER (PARTITION BY sector ORDER BY round(return_1m, 6) DESC NULLS LAST, u.ticker) AS rank FROM universe u LEFT JOIN wide USING (ticker) LEFT JOIN n7 USING (ticker)""")
def constituents(t: Tables):
    w = rollups.wide_matrix(signals.price_signals(t.bars), [*_S, "return_ytd"])
    return rollups.constituents(t.universe, w, t.news).select("sector", "ticker", "return_1m", r6("rsi"), "news_7d", "rank")


@query("A09_latest_mentions", "SELECT ticker, max(date) AS date, arg_max(mention_count, date) AS mention_count FROM mentions WHERE subreddit = '' GROUP BY ticker")
def latest_mentions(t: Tables):
    return signals.latest(t.mentions.where("subreddit = ''").select("ticker", "date", "mention_count"), ["ticker"])


@query("A33_priority_list", """SELECT u.ticker, coalesce(m.c, 0) AS mentions, row_number() OVER (ORDER BY m.c DESC NULLS LAST, u.ticker) AS rank FROM (SELECT DISTINCT ticker FROM universe) u
 LEFT JOIN (SELECT ticker, arg_max(mention_count, date) AS c FROM mentions WHERE subreddit = '' GROUP BY ticker) m USING (ticker) QUALIFY rank <= 40""")
def priority_list(t: Tables):
    m = signals.latest(t.mentions.where("subreddit = ''").select("ticker", "date", "mention_count"), ["ticker"])
    return rollups.priority_list(t.universe, m, 40)


@query("W27_W28_E13_ticker_detail", f"""WITH {_WIDE}, y AS (SELECT ticker, max(high) AS hi, min(low) AS lo, arg_max(close, date) AS close FROM bars WHERE date > (SELECT max(date) FROM bars) - 365 GROUP BY ticker),
 e AS (SELECT custkey % (SELECT count(*) FROM supplier) AS ticker, date FROM deals), d AS (SELECT DATE '1997-01-01' AS now),
 n AS (SELECT ticker, min(date) FILTER (WHERE date >= now) - min(now) AS days_to_next, min(now) - max(date) FILTER (WHERE date < now) AS days_since_last FROM e, d GROUP BY ticker)
 SELECT y.ticker, round(close, 6) AS close, round(least(1, greatest(0, (close - lo) / nullif(hi - lo, 0))), 6) AS range_position, round(close / nullif(hi, 0) - 1, 6) AS from_high, round(close / nullif(lo, 0) - 1, 6) AS from_low,
 CAST(days_to_next AS BIGINT) AS days_to_next, CAST(days_since_last AS BIGINT) AS days_since_last,
 CASE WHEN w.rsi >= 60 THEN 'high' WHEN w.rsi < 30 THEN 'low' ELSE 'mid' END AS rsi_class, CASE WHEN w.volume_ratio > 1.5 THEN 'high' WHEN w.volume_ratio < 0.5 THEN 'low' ELSE 'mid' END AS volume_class
 FROM y LEFT JOIN n USING (ticker) LEFT JOIN wide w USING (ticker)""")
def ticker_detail(t: Tables):
    n = t.read("supplier").count()
    events = t.deals.select((F.col("custkey") % n).alias("ticker"), "date")
    d = rollups.ticker_detail(t.bars, rollups.wide_matrix(signals.price_signals(t.bars), [*_S, "return_ytd"]), events, F.lit("1997-01-01").cast("date"))
    return d.select("ticker", r6("close"), r6("range_position"), r6("from_high"), r6("from_low"), "days_to_next", "days_since_last", "rsi_class", "volume_class")
