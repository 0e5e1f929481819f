"""Whitening, manifest and substring dedup against brute force, edge rows, and the contracts of their queries."""

import hashlib
import random
import re
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from chatterlake.llm import decontaminate, html, language, licenses, lines, manifest, queries, simhash, substrings, whitening

SMALL = "/root/testdata/sf0.001"


# --- whitening ---


def test_leading_pairs_of_hard_matrices():
    rng = np.random.default_rng(0)
    for n in (1, 2, 3, 7, 40, 90):
        a = rng.standard_normal((n + 5, n))
        some = rng.standard_normal((n, max(1, n // 2)))
        q = np.linalg.qr(rng.standard_normal((n, n)))[0]
        clustered = q @ np.diag(np.repeat([5.0, 3.0, 3.0 - 1e-13, 1.0], [1, n // 3, n // 3, n])[:n]) @ q.T
        for m in (a.T @ a, np.eye(n) * 3, np.diag(np.arange(n) * 1.0), some @ some.T, (clustered + clustered.T) / 2, np.zeros((n, n)), a.T @ a * 1e12):
            k = min(32, n)
            values, axes = whitening.leading_pairs(m, k)
            scale = max(1e-300, np.abs(m).max())
            assert np.abs(values - np.linalg.eigvalsh(m)[::-1][:k]).max() <= 1e-13 * n * scale
            assert np.abs(m @ axes - axes * values).max() <= 1e-13 * n * scale and np.abs(axes.T @ axes - np.eye(k)).max() < 1e-13 * n


def test_products_are_exact():
    rng = np.random.default_rng(1)
    for most in (9, 10**5, 2**27, 2**40):
        y = rng.integers(-most, most, (700, 5))
        sums = whitening.ExactProducts(5)
        for part in np.array_split(y, 3):
            sums.add(part)
        z = y.astype(object)
        assert (sums.sums() == z.T @ z).all()


def embeddings(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")


def test_whitening_against_numpy(spark):
    rng = np.random.default_rng(2)
    x = (rng.standard_normal((300, 40)) @ rng.standard_normal((40, 40)) * 0.3).astype(np.float32)
    odd = [(1000, None, 1), (1001, [None] + [0.0] * 39, 1), (1002, [float("nan")] + [0.0] * 39, 1), (1003, [float("inf")] + [0.0] * 39, 1), (1004, [], 1), (1005, [1.0, 2.0], 1), (1006, [3e38] * 40, 1)]
    rows = [(i if i else None, v.tolist(), 0) for i, v in enumerate(x)] + odd
    got = {r.vec_id: r for r in whitening.whitened_vectors(embeddings(spark, rows)).collect()}
    assert len(got) == 300 and None in got
    whole = np.floor(x.astype(np.float64) * 64).astype(int) + 1_000_000
    sums = whole.sum(axis=0)
    centred = whole - sums / 300
    values, axes = np.linalg.eigh(centred.T @ centred / 300)
    values, axes = values[::-1][:32], axes[:, ::-1][:, :32]
    w = centred @ axes / np.sqrt(values)
    mine = np.array([got[i if i else None].whitened for i in range(300)])
    assert np.abs(mine - w * np.sign((mine * w).sum(axis=0))).max() < 1e-8
    for i in (0, 7, 299):
        r = got[i if i else None]
        assert r.n == 300 and int(r.deviation) == int(((300 * whole[i].astype(object) - sums.astype(object)) ** 2).sum())
        assert np.allclose(r.explained, values / np.trace(centred.T @ centred / 300), rtol=1e-10) and r.identity_error < 1e-9


def test_whitening_edges(spark):
    out = lambda rows: whitening.whitened_vectors(embeddings(spark, rows)).collect()
    assert out([]) == [] and out([(1, None, 0)]) == [] and out([(1, [1.0, 2.0], 0)]) == [] and out([(1, [1.0], 0)] * 3) == []
    few = out([(1, [1.0, 5.0, 2.0], 0), (2, [2.0, 5.0, 4.0], 0), (2, [2.0, 5.0, 4.0], 0)])  # one direction, repeated rows
    assert sorted(r.vec_id for r in few) == [1, 2, 2] and all(len(r.whitened) == 1 and abs(r.explained[0] - 1) < 1e-12 for r in few)
    huge = out([(i, [float(2**45) * (i % 3), float(i)], 0) for i in range(9)])
    assert len(huge) == 9 and all(r.identity_error < 1e-4 for r in huge)


# --- manifest ---


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def told(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def levels_of(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([sha(*out[-1][i : i + 8]) for i in range(0, len(out[-1]), 8)])
    return out


def path_of(levels, place):
    out = []
    for level in levels[:-1]:
        run = level[place // 8 * 8 : place // 8 * 8 + 8]
        out.append(("".join(run[: place % 8]), "".join(run[place % 8 + 1 :])))
        place //= 8
    return out


def manifest_by_hand(rows):
    by = {}
    for r in rows:
        by.setdefault(r["lang"], []).append((r["doc_id"], sha(*(told(r[c]) for c in ("doc_id", "source", "lang", "n_chars", "text"))), r))
    for v in by.values():
        v.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    trees = {k: levels_of([x[1] for x in v]) for k, v in by.items()}
    order = sorted(by, key=lambda k: (k is not None, (k or "").encode()))
    top = levels_of([trees[k][-1][0] for k in order]) if order else [[None]]
    out = []
    for k, v in by.items():
        for place, (i, leaf, r) in enumerate(v):
            path = path_of(trees[k], place) + path_of(top, order.index(k))
            text = r["text"]
            if i is not None and text is not None and zlib.crc32(str(i).encode()) % 3 == 0:
                text = text.translate({c: c + 32 for c in range(65, 91)})
            node = sha(*map(told, (i, r["source"], r["lang"], r["n_chars"], text)))
            for before, after in path:
                node = sha(before, node, after)
            out.append((i, leaf, trees[k][-1][0], top[-1][0], sha(*(b + a for b, a in path)), node, node == top[-1][0]))
    return sorted(out, key=str)


DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.mark.parametrize("n, langs, levels", [(0, 3, 1), (1, 1, 1), (2, 2, 1), (9, 1, 1), (130, 3, 1), (700, 100, 1), (1300, 2, 1), (1300, 2, 2), (600, 1, 3)])
def test_manifest_against_brute_force(spark, tmp_path, monkeypatch, n, langs, levels):
    rng = random.Random(n)
    names = [None, "", "en", "é", "zz", *map(str, range(200))][:langs]
    rows = [(rng.randrange(n) if i % 50 else None, rng.choice([None, "", "Text A", "É\U0001f600", "x" * 3000]), rng.choice(names), rng.choice(["a", None]), rng.choice([None, 5])) for i in range(n)]
    rows += rows[:5]
    spark.createDataFrame(rows, DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    monkeypatch.setattr(manifest.document_manifest, "__defaults__", (*manifest.document_manifest.__defaults__[:3], levels, None))
    got = sorted(map(tuple, queries.op12_manifest(spark, str(tmp_path)).collect()), key=str)
    assert got == manifest_by_hand([dict(zip(("doc_id", "text", "lang", "source", "n_chars"), r, strict=True)) for r in rows])
    assert n < 100 or {r[-1] for r in got} == {True, False}


def test_partners_give_each_block_every_node_of_its_run_once(spark):
    for blocks in (1, 2, 7, 8, 9, 10, 64, 65, 130, 519):
        width = 1
        while width < blocks:
            rows = spark.range(blocks).select(F.col("id").alias("b"), F.explode(manifest.partners(F.lit(width).cast("long"), F.col("id"), F.lit(blocks).cast("long"))).alias("x")).select("b", "x.*").collect()
            got = {}
            for r in rows:
                assert r.b // (width * 8) == r.to // (width * 8)
                got.setdefault(r.to, []).append(r.digit)
            for b in range(blocks):
                first = b // (width * 8) * width * 8
                assert sorted(got[b]) == list(range(-(-(min(blocks - first, width * 8)) // width)))
            width *= 8


# --- substrings ---


def repeats_by_hand(rows, window):
    docs = [(i, t, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in rows]
    first = {}
    for i, t, words in docs:
        for p in range(len(words) - window + 1 if i is not None else 0):
            k, place = tuple(words[p : p + window]), (i, p)
            first[k] = min(place, first.get(k, place))
    out = []
    for i, t, words in docs:
        gone = [False] * len(words)
        for p in range(len(words) - window + 1 if i is not None else 0):
            if first[tuple(words[p : p + window])] < (i, p):
                gone[p : p + window] = [True] * window
        out.append((i, len(words), sum(gone), " ".join(w for w, g in zip(words, gone, strict=True) if not g)))
    return sorted(out, key=str)


@pytest.mark.parametrize("window, chunk_words", [(20, 250_000), (20, 60), (7, 40), (1, 30), (2, 30)])
def test_substring_dedup_against_brute_force(spark, window, chunk_words):
    rng = random.Random(window)
    passages = [[rng.choice("abcdefgh") + str(rng.randrange(4)) for _ in range(rng.randint(5, 60))] for _ in range(6)]
    rows = []
    for i in range(50):
        words = []
        for _ in range(rng.randint(0, 4)):
            p, a = rng.choice(passages), rng.randint(0, 5)
            words += p[a : a + rng.randint(5, 60)] + [f"u{rng.randrange(10**6)}x\u0085\x1c é" for _ in range(rng.randint(0, 9))]
        text = "".join(w + rng.choice([" ", "\n", "\t", "\x0b", "\x0c", " \r\n "]) for w in words)
        rows.append((rng.choice([i, i, i, -i]) if i % 11 else None, text if i % 7 else rng.choice([None, "", " \n"])))
    rows += rows[:4] + [rows[9]] * 5
    got = substrings.without_repeats(spark.createDataFrame(rows, "doc_id long, text string"), window=window, chunk_words=chunk_words).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.text) for r in got), key=str) == repeats_by_hand(rows, window)
    assert all(sum(s.end - s.start for s in r.spans) == r.n_removed for r in got)


def test_substring_edges(spark):
    docs = lambda rows: spark.createDataFrame(rows, "doc_id long, text string, text_key string, chunk string")
    assert substrings.without_repeats(docs([])).count() == 0
    words = " ".join(f"w{i}" for i in range(30))
    got = substrings.without_repeats(docs([(5, words, "k", "c"), (5, f"x {words}", "k", "c"), (6, words, "k", "c"), (None, words, "k", "c"), (2**53 + 1, words, None, None)])).collect()
    assert sorted((str(r.doc_id), r.n_removed) for r in got) == sorted([("5", 0), ("5", 30), ("6", 30), ("None", 0), (str(2**53 + 1), 30)])  # of two texts of one id one is the first
    with pytest.raises(TypeError, match="whole numbers"):
        substrings.without_repeats(spark.createDataFrame([("a", "b")], "doc_id string, text string"))
    loop = "again and " * 5000
    r = substrings.without_repeats(docs([(1, loop, "", "")])).first()
    assert (r.doc_id, r.n_words, r.n_removed, r.text) == repeats_by_hand([(1, loop)], 20)[0]


def test_rare_hashes_meet_as_pairs():
    a1, a2 = np.array([5, 5, 7, 9], dtype="<u8"), np.array([1, 2, 3, 4], dtype="<u4")
    h1, h2 = np.array([5, 5, 5, 7, 8], dtype="<u8"), np.array([2, 3, 1, 3, 4], dtype="<u4")
    assert substrings.among(h1, h2, a1, a2).tolist() == [True, False, True, True, False]
    assert substrings.among(h1, h2, a1[:0], a2[:0]).tolist() == [False] * 5


# --- contracts ---


CONTRACT = {
    "op11_whitening": {"vec_id": "bigint", "component": "int", "n": "bigint", "deviation": "bigint", "whitened": "double", "explained": "double", "identity_error": "double"},
    "op12_manifest": {"doc_id": "bigint", "leaf": "string", "subroot": "string", "root": "string", "proof_sha256": "string", "folded_root": "string", "verified": "boolean"},
    "op13_substring_dedup": {"doc_id": "bigint", "n_words": "bigint", "n_removed": "bigint", "kept_sha256": "string"},
}


@pytest.mark.parametrize("name", list(CONTRACT))
def test_queries_keep_their_contract_on_whole_tables(spark, name):
    out = queries.QUERIES[name](spark, SMALL)
    assert {c: k for c, k in out.dtypes if c in CONTRACT[name]} == CONTRACT[name]
    rows = out.collect()
    if name == "op11_whitening":
        assert len(rows) == 500 * 32 and {r.component for r in rows} == set(range(1, 33)) and rows[0].identity_error <= 1e-4
    else:
        docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
        assert sorted(r.doc_id for r in rows) == sorted(docs)
    if name == "op13_substring_dedup":
        want = {i: (n, gone, hashlib.sha256(kept.encode()).hexdigest()) for i, n, gone, kept in repeats_by_hand(list(docs.items()), 20)}
        assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in rows} == want and sum(r.n_removed for r in rows) > 1000


# --- earlier operators: long and odd input ---


def test_line_dedup_is_linear_in_the_lines_of_a_text(spark):
    n = 100_000
    text = "\n".join(f"a line of words {i % (n - 50)} here" for i in range(n))
    docs = spark.createDataFrame([(1, text), (2, "a line of words 7 here\nanother one")], "doc_id long, text string")
    lines.dedup_lines(docs.limit(0)).count()
    began = time.time()
    got = {r.doc_id: (r.n_lines, r.n_dropped, len(r.text)) for r in lines.dedup_lines(docs).collect()}
    assert time.time() - began < 60
    assert got[1] == (n, 50, len("\n".join(text.split("\n")[: n - 50]))) and got[2] == (2, 1, len("another one"))


def test_flags(spark):
    df = spark.createDataFrame([(0, [3, 0, 4]), (1, [0]), (2, []), (3, [2])], "i int, p array<int>")
    got = {r.i: [k for k, x in enumerate(r.f) if x] for r in df.select("i", lines.flags(F.col("p")).alias("f")).collect()}
    assert got == {0: [0, 3, 4], 1: [0], 2: [], 3: [2]}


PARAGRAPH = "<p>" + "Long words in a paragraph of an article that says something. " * 4 + "</p>"
NAV = "<nav><ul><li><a href=x>menu</a></li></ul></nav>"


def test_names_inside_an_article_need_more_evidence():
    keep = "".join(f"<div class='{c}'><p>kept {c}, a sentence that goes on for a while, as sentences in articles do</p></div>" for c in ("discussion", "comment-on-method", "login-systems", "notice"))
    drop = "<div class='related'><a href=1>one of the links</a> <a href=2>another link</a></div><div class='reply-comment'>Write here<form><input></form></div><div class='comments'><p>gone, though it is a long sentence of some reader</p></div><div class='ad-slot'><p>Buy this now.</p></div>"
    text = html.main_text(f"<body>{NAV}<article>{PARAGRAPH * 3}{keep}{drop}{PARAGRAPH}</article><footer>f</footer>")
    assert text.count("Long words") == 16 and text.count("kept") == 4 and not any(x in text for x in ("link", "Write", "gone", "Buy", "menu"))
    ends = html.main_text(f"<article>{PARAGRAPH}<div class='share'>Tell others</div></article>")
    assert "Tell" not in ends


def test_the_article_that_holds_most_is_the_region():
    text = html.main_text(f"<main><article>{PARAGRAPH * 3}</article><div id='user-reviews'><p>gone review</p></div><div class='disclaimer'><p>gone too</p></div><div><p>and this</p></div></main>")
    assert text.count("Long") == 12 and "gone" not in text and "and this" not in text


def test_title_and_last_paragraph_beside_the_region_stay():
    text = html.main_text(f"<body>{NAV}<div><h1>Title</h1></div><div class='body'>{PARAGRAPH * 6}</div><div><p>the last paragraph of it</p></div><div><a href=1>all links</a></div><footer>f</footer></body>").split("\n")
    assert text[0] == "Title" and "the last paragraph of it" in text and "f" not in text


@pytest.mark.parametrize("page", ["<a " * 80_000, "<a href='" * 80_000, "<!--" * 80_000, "<!-- >" * 40_000, "</" * 80_000, "<![ " * 80_000, "<div>" * 40_000, "&#" * 80_000])
def test_unfinished_pages_take_linear_time(page):
    began = time.process_time()
    html.main_text(page + PARAGRAPH)
    html.main_text(PARAGRAPH + page)
    assert time.process_time() - began < 5


def test_pages_on_an_empty_table_and_clashing_columns(spark, tmp_path):
    spark.createDataFrame([], "page_id long, url string, html string, text string, n_chars long").write.parquet(str(tmp_path / "pages.parquet"))
    spark.createDataFrame([], f"{DOCS}, labels string, found string").write.parquet(str(tmp_path / "documents.parquet"))
    assert queries.op7_main_text(spark, str(tmp_path)).count() == 0 and queries.op8_license_scan(spark, str(tmp_path)).count() == 0
    path = str(tmp_path / "more")
    spark.createDataFrame([(1, "u", "<p>a", "x", 9)], "page_id long, url string, html string, text string, n_chars long").write.parquet(f"{path}/pages.parquet")
    spark.createDataFrame([(1, "licensed under MIT", "en", "s", 3, "x", "y")], f"{DOCS}, labels string, found string").write.parquet(f"{path}/documents.parquet")
    assert queries.op7_main_text(spark, path).first()[:] == (1, "u", "a", 1)
    assert queries.op8_license_scan(spark, path).first().labels == "mit"


def variants(pattern):
    """Strings of a pattern: every alternative of every part once, the other parts at their first."""
    from re import _parser

    def of(items):
        parts = [one(str(op), value) for op, value in items]
        first = [p[0] for p in parts]
        return ["".join(first)] + ["".join([*first[:i], x, *first[i + 1 :]]) for i, p in enumerate(parts) for x in p[1:]]

    def one(op, value):
        if op == "LITERAL":
            return [chr(value)]
        if op == "IN":
            return [chr(v if str(o) == "LITERAL" else v[0]) for o, v in value]
        if op == "ANY":
            return ["x"]
        if op == "BRANCH":
            return [v for b in value[1] for v in of(b)]
        if op == "SUBPATTERN":
            return of(value[3])
        low, _, inner = value  # a repeat
        return [""] * (low == 0) + [v * max(low, 1) for v in of(inner)]

    return of(_parser.parse(pattern))


def test_every_alternative_of_every_rule_is_found():
    seen = 0
    for rule in licenses.signature_rules():
        for text in variants(rule.pattern.pattern.removeprefix("(?<![^ ])").removesuffix("(?![^ ])")):
            words = licenses.text_words(text)
            present = licenses.rules_by_keyword().keys() & set(words)
            assert any(found.order == rule.order for _, _, found in licenses.matches(" ".join(words), present)), (rule, text)
            seen += 1
    assert seen > 5000
    for name, label in licenses.IDENTIFIERS:
        found = licenses.scan(f"x\n# SPDX-License-Identifier: {name}\n")
        assert set(found["labels"].split(",")) - set(found["base_labels"].split(",")) <= {label} and label in found["labels"].split(",")
        assert label in licenses.scan(f"licensed under {name}.")["labels"].split(",")
    assert licenses.scan("zero clause bsd license")["labels"] == "0bsd" and licenses.scan("an ISC of MIT and Zlib")["labels"] == ""


def test_runs_of_an_index_find_what_all_items_would():
    rng = np.random.default_rng(8)
    shingles = [np.unique(rng.integers(0, 400, rng.integers(1, 40)).astype("<u8")) for _ in range(200)]
    index = decontaminate.ItemIndex(list(range(200)), shingles, 0.8)
    for _ in range(60):
        doc = np.unique(rng.integers(0, 400, rng.integers(1, 600)).astype("<u8"))
        want = [(i, int(np.isin(s, doc).sum())) for i, s in enumerate(shingles) if np.isin(s, doc).sum() >= index.needed(i)]
        assert sorted(index.search(doc)) == want


def test_members_of_a_bucket_meet_once_over_blocks(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK_MEMBERS", 7)
    sizes = {1: 1, 2: 7, 3: 8, 4: 50}
    rows = spark.createDataFrame([(k, n, k * 1000 + i) for k, n in sizes.items() for i in range(n)], "key long, n long, node long")
    a, b = simhash.compared_in_blocks(rows)
    met = a.join(b, (a.key == b.key) & (a.i == b.i) & (a.j == b.j) & ((a.i < a.j) | (F.col("node_a") < F.col("node_b"))))
    got = sorted((min(r), max(r)) for r in met.select("node_a", "node_b").collect())
    assert got == sorted((k * 1000 + i, k * 1000 + j) for k, n in sizes.items() for i in range(n) for j in range(i + 1, n))
    assert met.groupBy(a.key, a.i, a.j).count().agg(F.max("count")).first()[0] < 400


def test_ties_of_languages_and_items(spark):
    rng = random.Random(2)
    said = [" ".join("".join(rng.choice("aeionrst") for _ in range(rng.randint(2, 8))) for _ in range(60)) for _ in range(12)]
    docs = spark.createDataFrame([(i, t, lang) for lang in ("aa", "bb") for i, t in enumerate(said)], "doc_id long, text string, lang string")
    found = language.identified(docs, language.learn_languages(docs)).collect()
    assert len(found) == 24 and all(r.rejected for r in found) and len({r.lang_pred for r in found}) == 1  # two dictionaries of the same texts
    texts = spark.createDataFrame([(1, said[0]), (1, said[0]), (2, said[1])], "doc_id long, text string")
    items = spark.createDataFrame([(1, said[0]), (2, said[0]), (2, said[0])], "item_id long, text string")
    got = sorted((r.doc_id, r.item_id) for r in decontaminate.contained_items(texts, items).collect())
    assert got == sorted([(1, 1), (1, 2), (1, 2)] * 2)
