"""Edge values of the library's own jobs: short history, zero, null, tie, flat, repeated input."""

from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from chatterlake.functions import labels, money, names
from chatterlake.functions import text as tx
from chatterlake.operators import claims, communities, disclosures, forum, ledger, macro, merges, rollups, series, signals, video
from chatterlake.plans import records, registry, stories  # noqa: F401  (registers its queries)
from chatterlake.plans.registry import REGISTERED, SQL
from chatterlake.sources import landed, nested
from tests.oracle import connection, difference


def bars(spark, closes, ticker=1, volume=None):
    rows = [(ticker, date(2023, 1, 2) + timedelta(days=i), float(c) + 1, float(c) - 1, float(c), (volume or [100] * len(closes))[i]) for i, c in enumerate(closes)]
    return spark.createDataFrame(rows, "ticker long, date date, high double, low double, close double, volume long")


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def last(df, *cols):
    return df.orderBy(F.desc("date")).select(*cols).first()


def test_simple_rsi_needs_15_rows_and_flat_is_100(spark):
    assert last(signals.price_signals(bars(spark, range(10, 24))), "rsi")[0] is None
    assert last(signals.price_signals(bars(spark, range(10, 25))), "rsi")[0] == 100
    assert last(signals.price_signals(bars(spark, range(25, 10, -1))), "rsi")[0] == 0
    assert last(signals.price_signals(bars(spark, [5] * 15)), "rsi")[0] == 100


def test_wilder_rsi_flat_is_null(spark):
    assert last(series.wilder_rsi(bars(spark, [5] * 20)), "wilder_rsi")[0] is None
    assert last(series.wilder_rsi(bars(spark, range(1, 21))), "wilder_rsi")[0] == 100
    assert last(series.wilder_rsi(bars(spark, range(1, 15))), "wilder_rsi")[0] is None


def test_returns_guard_zero_and_short_history(spark):
    assert last(signals.price_signals(bars(spark, [0, 5])), "return_1d")[0] is None
    assert last(signals.price_signals(bars(spark, [4, 5])), "return_1d", "return_5d")[:] == (0.25, None)


def test_volume_ratio_needs_ten_prior(spark):
    assert last(signals.price_signals(bars(spark, [5] * 10)), "volume_ratio")[0] is None
    assert last(signals.price_signals(bars(spark, [5] * 11, volume=[100] * 10 + [250])), "volume_ratio")[0] == 2.5


def test_above_average_is_strict(spark):
    assert last(signals.price_signals(bars(spark, [5] * 50)), "above_sma50")[0] == 0.0
    assert last(signals.price_signals(bars(spark, [5] * 49)), "above_sma50")[0] is None


def test_signals_take_one_shuffle_of_the_bars_and_hot_tickers_two(spark, monkeypatch):
    folder = "/root/testdata/sf0.001"
    once = signals.price_signals(registry.Tables(spark, folder).bars)
    assert plan_of(once).count("Exchange") == 1 and plan_of(signals.latest_signals(registry.Tables(spark, folder).bars)).count("Exchange") == 1
    monkeypatch.setattr(registry, "HOT_ROWS", 600)
    hot = signals.price_signals(registry.Tables(spark, folder).bars)
    assert plan_of(hot).count("Exchange") > 1 and sorted(map(repr, hot.collect())) == sorted(map(repr, once.collect()))


def test_latest_signals_are_the_newest_of_the_long_rows(spark):
    b = bars(spark, [3 + i % 7 for i in range(40)], volume=[100] * 38 + [None, 50]).union(bars(spark, [4, 5], ticker=2))
    want = signals.latest(signals.long_signals(b), ["ticker", "signal_name"])
    got = signals.latest_signals(b).select(*want.columns)
    assert sorted(got.collect()) == sorted(want.collect()) and {r.signal_name for r in got.where("ticker = 2").collect()} == {"return_1d"}
    assert not plan_of(signals.latest_signals(b)).count("SortAggregate")


def test_a_ticker_record_stores_no_signals_of_all_days(spark, monkeypatch):
    stored, keep = {}, landed.saved
    monkeypatch.setattr(landed, "saved", lambda df, name: stored.setdefault(name, keep(df, name)))
    con = connection("/root/testdata/sf0.001")
    assert difference(REGISTERED["E13_ticker_record"](spark, "/root/testdata/sf0.001"), con, SQL["E13_ticker_record"]) == ""
    assert all("atr_pct" not in df.columns or df.count() == df.select("ticker").distinct().count() for df in stored.values())


def test_the_wide_matrix_is_hashed(spark):
    wide = rollups.wide_matrix(signals.price_signals(bars(spark, range(10, 25))), ["return_1d", "rsi"])
    assert "SortAggregate" not in plan_of(wide) and wide.select("rsi").first()[0] == 100


def test_ytd_needs_an_earlier_year(spark):
    b = bars(spark, [10, 11, 12])
    assert last(signals.ytd_return(b), "return_ytd")[0] is None
    early = spark.createDataFrame([(1, date(2022, 12, 30), 1.0, 1.0, 8.0, 1)], b.schema)
    assert last(signals.ytd_return(b.union(early)), "return_ytd")[0] == pytest.approx(0.2)


def test_last_rows_over_salted_parts(spark):
    df = spark.range(1000).select((F.col("id") % 2).alias("k"), "id")
    got = signals.last_rows(df, ["k"], 3, F.desc("id")).orderBy("k", "rank").collect()
    assert [(r.k, r.id, r["rank"]) for r in got] == [(0, 998, 1), (0, 996, 2), (0, 994, 3), (1, 999, 1), (1, 997, 2), (1, 995, 3)]


def test_as_of_keeps_a_null(spark):
    rows = spark.createDataFrame([("a", date(2024, 1, 1), 1.0), ("a", date(2024, 1, 5), None)], "ticker string, date date, value double")
    now = spark.createDataFrame([(date(2024, 1, 6),)], "as_of date")
    assert rollups.as_of(rows, ["ticker"], now).first()["value"] is None
    assert rollups.as_of(rows, ["ticker"], now, 3).first()["value"] == 1.0


def test_terciles_need_three_values(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", 2.0), ("c", 3.0)], "sector string, x double")
    got = {r.sector: r.x_class for r in rollups.terciles(df, "sector", {"x": False}).collect()}
    assert got == {"a": "red", "b": "yellow", "c": "green"}
    assert {r.x_class for r in rollups.terciles(df.limit(2), "sector", {"x": True}).collect()} == {None}


def test_reality_score_of_one_bucket_and_of_none(spark):
    config = spark.createDataFrame([("A", "market", 1), ("B", "economy", -1), ("V", "context", 1)], "series_id string, bucket string, sign int")
    z = lambda *rows: spark.createDataFrame(list(rows), "series_id string, z_score double")
    r = macro.reality_score(z(("A", 1.5), ("B", None)), config).first()
    assert (r.score, r.band, r.economy_z, r.skipped_indicators) == (1.5, "severe_decoupling", None, ["B"])
    r = macro.reality_score(z(("V", 9.0)), config).first()
    assert (r.score, r.band) == (0.0, "aligned")
    assert macro.reality_score(z(("A", -1.0), ("B", 0.0)), config).first().band == "market_discounting_weakness"


def test_latest_z_of_a_flat_series_is_null(spark):
    s = spark.createDataFrame([("A", date(2020, m, 1), 3.0) for m in range(1, 13)], "series_id string, date date, value double")
    assert macro.latest_z(s).first()["z_score"] is None


def test_merges_are_idempotent(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string")
    once = merges.last_wins(old, new, ["k"])
    assert sorted(map(tuple, once.collect())) == [(1, "a"), (2, "c"), (3, "d")] == sorted(map(tuple, merges.last_wins(once, new, ["k"]).collect()))
    links = spark.createDataFrame([(1, "T", "search", "x"), (1, "T", "subreddit", "y")], "post_id int, ticker string, via string, matched string")
    assert merges.link_precedence(links.union(links)).collect()[0]["via"] == "subreddit"


def test_non_ok_digest_never_replaces_ok(spark):
    make = lambda c, s: spark.createDataFrame([("T", date(2024, 1, 1), c, s)], "ticker string, digest_date date, created_at int, status string")
    assert merges.merge_digests(make(1, "ok"), make(2, "error")).first().status == "ok"
    assert merges.merge_digests(make(1, "error"), make(2, "error")).first().created_at == 2
    assert merges.merge_digests(make(2, "error"), make(2, "ok")).first().status == "error"


def test_reconcile_at_ten_percent_and_with_one_provider(spark):
    rows = [("h", date(2024, 1, 1), "A", 100, "complete"), ("h", date(2024, 1, 1), "B", 90, "complete"), ("h", date(2024, 1, 2), "A", 100, "complete"), ("h", date(2024, 1, 2), "B", 89, "complete")]
    rows += [("h", date(2024, 1, 3), "A", 5, "complete"), ("h", date(2024, 1, 4), "A", None, "complete"), ("h", date(2024, 1, 4), "B", 0, "exhausted")]
    got = {r.date.day: r.verdict for r in ledger.reconcile(spark.createDataFrame(rows, "handle string, date date, provider string, tweets_fetched long, status string")).collect()}
    assert got == {1: "ok", 2: "mismatch", 3: "skipped", 4: "ok"}


def test_amount_ranges(spark):
    rows = [("$1,001 - $15,000",), ("Over $50,000,000",), ("$500",), ("n/a",), (None,)]
    low, high = money.amount_range(F.col("t"))
    got = [tuple(r) for r in spark.createDataFrame(rows, "t string").select(low, high).collect()]
    assert got == [(1001.0, 15000.0), (50_000_001.0, None), (500.0, None), (None, None), (None, None)]


def test_names_are_never_matched_in_part(spark):
    rows = [("playstation", "games", "PL", "Planet Labs"), ("RKLB", "Rocket Lab stock", "RKLB", "Rocket Lab Inc"), ("cake", "baking", "CAKE", None), ("pl", "", "PL", None)]
    df = spark.createDataFrame(rows, "name string, title string, ticker string, company string")
    got = [r[0] for r in df.select(names.attribution_relevance(F.col("name"), F.col("title"), F.col("ticker"), F.col("company"))).collect()]
    assert got == [0.0, 1.0, 0.0, 0.6]


def test_a_tie_is_not_attributed(spark):
    comm = spark.createDataFrame([("rocketstock", "x", 9), ("abc", "y", 9)], "name string, text string, subscribers long")
    stocks = spark.createDataFrame([("ABC", "Other Name"), ("RKA", "Rocket"), ("RKB", "Rocket")], "ticker string, company string")
    assert [(r.name, r.ticker) for r in communities.attributed(comm, stocks).collect()] == [("abc", "ABC")]


def test_claims_ends_of_similarity(spark):
    rows = [(1, "T", "k", "alpha beta gamma delta"), (2, "T", "k", "nothing alike here today now")]
    known = [(10, "T", "k", "delta gamma beta alpha", datetime(2024, 1, 1)), (11, "T", "k", "alpha beta gamma delta epsilon", datetime(2024, 1, 2))]
    mark = lambda df: df.withColumn("tokens", tx.claim_tokens(F.col("text"))).withColumn("fingerprint", tx.fingerprint(F.col("kind"), F.col("tokens")))
    new = mark(spark.createDataFrame(rows, "claim_id long, ticker string, kind string, text string"))
    old = mark(spark.createDataFrame(known, "claim_id long, ticker string, kind string, text string, first_seen_at timestamp"))
    got = {r.claim_id: (r.status, r.known_id) for r in claims.novelty(new, old).collect()}
    assert got == {1: ("known", 10), 2: ("candidate", None)}
    assert claims.novelty(new, old.where("claim_id = 11")).where("claim_id = 1").first().known_id == 11


def test_bait_titles(spark):
    rows = [("RKLB STOCK IS ABOUT TO EXPLODE",), ("RKLB stock update today",), ("Up 🚀🚀",), ("NEW CEO",)]
    got = [r[0] for r in spark.createDataFrame(rows, "title string").select(video.is_bait(F.col("title"), F.lit("RKLB"))).collect()]
    assert got == [True, False, True, False]


def test_accented_letters_end_a_word_in_titles_as_in_the_twin(spark, tmp_path):
    titles = ["ÑCI!", "CIÓN x", "el that", "thaté", "ciudadñ", "acasa", "casa_x", "CI_", "La CI", "mit ÜCI7"]
    docs = spark.createDataFrame([(i, f"{t}\nbody", "en", "src1", 200 + i) for i, t in enumerate(titles)], "doc_id long, text string, lang string, source string, n_chars long")
    odd = spark.createDataFrame([(90, None, "en", "src1", 500), (91, "el that", "en", None, 500)], docs.schema)  # without a text, without a source
    docs.unionByName(odd).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(0, 1)], "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    con = connection(str(tmp_path))
    for name in ("P01_P02_P03_P04_verdicts", "E14_video_selection"):
        assert difference(REGISTERED[name](spark, str(tmp_path)), con, SQL[name]) == ""


def test_labels_and_deleted(spark):
    rows = [(datetime(2024, 1, 2, 14, 29),), (datetime(2024, 1, 2, 14, 30),), (datetime(2024, 1, 2, 21, 0),)]
    assert [r[0] for r in spark.createDataFrame(rows, "t timestamp").select(labels.earnings_class(F.col("t"))).collect()] == ["BMO", None, "AMC"]
    c = spark.createDataFrame([("[deleted]", "x"), ("fine", "AutoModerator"), ("ok", "me")], "body string, author string")
    assert landed.without_deleted(c).count() == 2 and forum.people(c).count() == 2
    assert spark.range(1).select(disclosures.party_letter(F.lit("democrat")), disclosures.party_letter(F.lit("green"))).first()[:] == ("D", "I")


def test_thread_depths_of_long_threads(spark):
    rows = [(i, i - 1 if i else None) for i in range(100)] + [(200, 13), (300, 999), (301, 300), (400, 401), (401, 400), (500, 500)]
    got = {r.comment_id: r.depth for r in forum.thread_depths(spark.createDataFrame(rows, "comment_id long, parent_id long")).collect()}
    assert got == {i: i for i in range(100)} | {200: 14, 300: None, 301: None, 400: None, 401: None, 500: None}
    assert forum.thread_depths(spark.createDataFrame([], "comment_id long, parent_id long")).count() == 0


def test_match_relevance_guards(spark):
    """A name can't vouch for itself; other languages must name the company; everyday words match whole names only."""
    rows = [
        ("PATH", "trains of the region", None, "PATH", "UiPath Inc", 0.4), ("Poet", "poet", "en", "POET", "POET Technologies", 0.4), ("CCJ", "uranium company Cameco", "en", "CCJ", "Cameco Corp", 1.0),
        ("sndk", "чат", "ru", "SNDK", "SanDisk", 0.4), ("RKLB", "Rocket Lab (RKLB)", "en", "RKLB", "Rocket Lab", 1.0), ("QuantumComputing", "quantum computing", "en", "QUBT", "Quantum Computing Inc", 0.4),
        ("ASTSpaceMobile", "NASDAQ: ASTS", "en", "ASTS", "AST SpaceMobile", 1.0), ("Microneedling", "skin", "en", "MU", "Micron", 0.0), ("PLTR", "$PLTR", "en", "PL", "Planet Labs", 0.0),
        ("rocketlab", "launches and earnings", "en", "RKLB", "Rocket Lab", 0.7), ("space", "rocket lab stock talk", "en", "RKLB", "Rocket Lab", 0.6),
    ]
    df = spark.createDataFrame(rows, "name string, text string, lang string, ticker string, company string, want double")
    got = df.select("name", "want", names.match_relevance(*map(F.col, ("name", "text", "lang", "ticker", "company"))).alias("got")).collect()
    assert {r.name: r.got for r in got} == {r.name: r.want for r in got}


def test_short_names_and_market_rules(spark):
    rows = [("Applied Optoelectronics, Inc.",), ("The Trade Desk",), ("The Co.",), ("AB",), (None,), ("Holdings of the East Ltd",)]
    got = [r[0] for r in spark.createDataFrame(rows, "c string").select(names.short_name(F.col("c"))).collect()]
    assert got == ["Applied Optoelectronics", "Trade Desk", None, None, None, "Holdings of the East"]
    rows = [("Stockholm", "city"), ("CanadianStocks", ""), ("livestock", "cows"), ("StockMarket", ""), ("TradingPosts", "invest in stocks"), ("TradingPosts", "barter"), ("nothing", "share your portfolio of art"), ("nothing", "nasdaq earnings")]
    got = [r[0] for r in spark.createDataFrame(rows, "n string, t string").select(names.market_rule(F.col("n"), F.col("t"), F.lit(False))).collect()]
    assert got == ["no", "name-strong", "no", "name-strong", "name-weak+context", "no", "no", "text"]
    assert spark.range(1).select(F.array_join(names.humps(F.lit("ASTSpaceMobile A1b ABc x")), " ")).first()[0] == "ast space mobile a 1b a bc x"


def test_places_over_ranges_and_within_keys(spark):
    df = spark.createDataFrame([(k, i, float(i * 7 % 50)) for k in ("a", "b") for i in range(200)] + [("c", 1, 1.0)], "k string, i long, v double").repartition(7)
    order = [F.desc("v"), F.col("i")]
    got = {(r.k, r.i): r["rank"] for r in rollups.ranked_within(df, ["k"], order).collect()}
    for k, n in (("a", 200), ("b", 200), ("c", 1)):
        rows = sorted(((-(i * 7 % 50), i) for i in range(n)) if n > 1 else [(-1, 1)])
        assert [got[k, i] for _, i in rows] == list(range(1, n + 1))
    assert sorted(r["rank"] for r in rollups.places(df, [*order, F.col("k")]).collect()) == list(range(1, 402))
    assert rollups.places(df.limit(0), order).count() == 0


def test_configured_providers(spark):
    rows = [("one", date(2024, 1, 1), "A", 5, "complete"), ("two", date(2024, 1, 1), "A", 5, "complete"), ("two", date(2024, 1, 2), "A", 100, "complete"), ("two", date(2024, 1, 2), "B", 50, "exhausted"), ("none", date(2024, 1, 1), "A", 5, "complete")]
    log = spark.createDataFrame(rows, "handle string, date date, provider string, tweets_fetched long, status string")
    conf = spark.createDataFrame([("one", ["A"]), ("two", ["A", "B"])], "handle string, providers array<string>")
    got = {(r.handle, r.date.day): r.verdict for r in ledger.reconcile(log, conf).collect()}
    assert got == {("one", 1): "ok", ("two", 1): "skipped", ("two", 2): "mismatch", ("none", 1): "skipped"}


def test_nested_documents(spark, tmp_path):
    (tmp_path / "leg.json").write_text('{"id":{"bioguide":"B1"},"name":{"first":"Ann","last":"Lee"},"terms":[{"type":"rep"},{"type":"sen"}]}\n{"id":{}}\n{"id":{"bioguide":"B2"},"name":{"last":"Roe"},"bio":{"party":"D"}}\n')
    got = {r.bioguide_id: (r.full_name, r.party, r.chamber) for r in nested.read_legislators(spark, str(tmp_path / "leg.json")).collect()}
    assert got == {"B1": ("Ann Lee", "I", "senate"), "B2": ("Roe", "D", "unknown")}
    (tmp_path / "com.json").write_text('{"thomas_id":"HSAS","name":"House Armed Services Committee","subcommittees":[{"thomas_id":"03"},{"name":"no id"}]}\n{"id":"SX","name":"Other"}\n{"name":"no id"}\n')
    com = nested.read_committees(spark, str(tmp_path / "com.json"))
    assert {(r.committee_id, r.name, r.parent_id) for r in com.collect()} == {("HSAS", "House Armed Services Committee", None), ("HSAS03", "House Armed Services Committee Subcommittee", "HSAS"), ("SX", "Other", None)}
    seats = spark.createDataFrame([("B1", "HSAS", "Ranking Member", 1), ("B2", "HSAS99", "Chair", 1), ("B2", "SX", "Chair", 1), ("B9", "HSAS", "Chair", 1), ("B1", "HSAS03", "Ranking Member", 2)], "bioguide_id string, committee_id string, title string, rank int")
    leg = nested.read_legislators(spark, str(tmp_path / "leg.json"))
    got = {r.bioguide_id: [c.committee_id for c in r.committees] for r in disclosures.watched_by_committee(seats, com, leg).collect()}
    assert got == {"B1": ["HSAS"], "B2": ["HSAS99"]}
    (tmp_path / "funds.json").write_text('{"sector":"a","entries":["xlk",{"ticker":"soxx"},{"note":"none"}]}\n{"sector":"b","entries":null}\n{"sector":"c","entries":[]}\n')
    assert {r.sector: r.tickers for r in nested.read_funds(spark, str(tmp_path / "funds.json")).collect()} == {"a": ["XLK", "SOXX"], "b": [], "c": []}
    (tmp_path / "stars.json").write_text('{"bioguide_id":"B1"}\n{"name":"no id"}\n')
    assert [tuple(r) for r in nested.read_stars(spark, str(tmp_path / "stars.json")).collect()] == [("B1", "", "")]


def test_noisy_tickers_need_a_dollar_or_the_company(spark):
    posts = spark.createDataFrame([(1, "on the road", "nothing"), (2, "buy $ON now", ""), (3, "ON Semi is up", "on"), (4, "RKLB flies", "")], "post_id long, title string, body string")
    found = spark.createDataFrame([(1, "ON", "ON"), (2, "ON", "ON"), (3, "ON", "ON"), (3, "ON Semi", "ON"), (4, "RKLB", "RKLB")], "post_id long, keyword string, ticker string")
    stocks = spark.createDataFrame([("ON", "ON Semi Corp"), ("RKLB", None)], "ticker string, company string")
    assert {r.post_id for r in communities.noisy_gate(found, posts, stocks).collect()} == {2, 3, 4}


def test_new_claims_meet_all_similar_known_ones(spark):
    """The one-sided index against all pairs."""
    import random

    rng = random.Random(5)
    make = lambda n: sorted(set(rng.choices("abcdefgh", k=n)))
    known = [(i, "T", make(rng.randint(1, 12))) for i in range(300)]
    new = [(1000 + i, "T", make(rng.randint(1, 12))) for i in range(80)]
    want = {(a, b) for a, _, x in new for b, _, y in known if len(set(x) & set(y)) / len(set(x) | set(y)) >= claims.SIMILAR}
    frame = lambda rows: spark.createDataFrame(rows, "claim_id long, ticker string, tokens array<string>")
    assert {(r.new_id, r.known_id) for r in claims.similar_claims(frame(new), frame(known)).collect()} == want and len(want) > 20


def test_recent_bars_leave_what_late_signals_take(spark):
    long = bars(spark, range(1, 1201), ticker=1)
    few = bars(spark, [5, 6, 7], ticker=2)
    b = long.unionByName(few)
    newest = rollups.newest(b)
    cut = rollups.recent_bars(b, newest)
    assert cut.where("ticker = 2").count() == 3 and 94 <= cut.where("ticker = 1").count() < 500
    late = F.date_sub("as_of", 30)
    keep = lambda df: sorted(map(str, rollups.with_as_of(signals.price_signals(df), newest).where(F.col("date") >= late).select("ticker", "date", "return_1m", "above_sma50", "atr_pct").collect()))
    assert keep(cut) == keep(b)
