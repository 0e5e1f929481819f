"""The ten operators against brute force and on edge cases: nulls, empty and long texts, ties, repeated rows, empty
tables, extra columns with clashing names."""

import inspect
import itertools
import math
import random
import re
from collections import Counter
from zlib import crc32

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from chatterlake.llm import decontaminate, html, language, licenses, lines, lm, mixing, quality, simhash, tokens
from chatterlake.llm.shared import connected_components, held_out

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs_of(spark, texts, langs=None, sources=None):
    rows = [(i, t, (langs or {}).get(i, "en"), (sources or {}).get(i, "s0"), len(t or "")) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


def odd_docs(spark):
    """Null id, null text, repeated rows, empty and blank texts, extra columns with clashing names."""
    rows = [(None, "a null id here", None, None), (1, None, "en", "s"), (2, "", None, "s"), (3, " \n\t ", "en", None)]
    rows += [(4, "the same row twice over again", "en", "s")] * 2 + [(5, "x " * 5000, "en", "s")]
    clash = "doc_id long, text string, lang string, source string"
    df = spark.createDataFrame(rows, clash)
    return df.withColumns({c: F.lit(1) for c in ("id", "words", "n", "key", "label", "tokens", "node", "score", "place", "copies", "n_lines", "cell")})


def sample_words(rng, n, vocabulary=300):
    return [f"w{int(vocabulary * rng.random() ** 2)}" for _ in range(n)]


# --- language ---


def test_language_learns_and_rejects(spark):
    rng = random.Random(1)
    stems = {"aa": ["stra", "bel", "mion", "tur"], "bb": ["kow", "zek", "prz", "wyl"]}
    make = lambda k, n: " ".join("".join(rng.choices(stems[k], k=3)) for _ in range(n))
    texts = [make("aa" if i % 2 else "bb", 60) for i in range(60)] + ["12 345", None, "", "?!"]
    df = docs_of(spark, texts, {i: "aa" if i % 2 else "bb" for i in range(60)})
    model = language.learn_languages(df.where("doc_id < 40"))
    got = {r.doc_id: r for r in language.identified(df, model).collect()}
    assert len(got) == 64
    assert all(got[i].lang_pred == ("aa" if i % 2 else "bb") and 0 < got[i].score <= 1 for i in range(60))
    assert all(got[i].lang_pred == "und" and got[i].rejected and got[i].score == 0 for i in range(60, 64))
    assert language.keep_identified(df, model).count() == 60


def test_language_fills_its_dictionary_beside_long_texts_and_copies(spark):
    rng = random.Random(15)
    make = lambda k, n: " ".join("".join(rng.choices(k, k=6)) for _ in range(n))
    short = [make("abcdef", 140) for _ in range(200)]
    texts = [make("abcdef", 300_000), *short, *[make("uvwxyz", 140)] * 3000, *(make("uvwxyz", 140) for _ in range(200))]
    df = docs_of(spark, texts, {i: "aa" if i <= 200 else "bb" for i in range(len(texts))})
    model = language.learn_languages(df, budget_bytes=50_000)
    assert model.languages == ("aa", "bb")
    assert all(len(c) == 50_000 for c in model.contents)
    assert sum(t.encode()[:900] in model.contents[0] for t in short) <= 40  # the long text has its share


def test_language_edges(spark):
    odd = odd_docs(spark)
    empty = language.learn_languages(odd.limit(0))
    assert {r.lang_pred for r in language.identified(odd, empty).collect()} == {"und"}
    assert language.identified(odd.limit(0), empty).count() == 0
    assert language.keep_identified(odd, language.learn_languages(odd)).columns == odd.columns


# --- mixing ---


def test_mixing_repeats_and_entropy(spark):
    rng = random.Random(2)
    sizes = {"a": 400, "b": 60, "c": 20}
    texts = [(s, " ".join(["w"] * rng.randint(1, 9))) for s, n in sizes.items() for _ in range(n)]
    df = docs_of(spark, [t for _, t in texts], None, {i: s for i, (s, _) in enumerate(texts)})
    rows = mixing.mixture(df, mixing.Target(most_repeats=2.0)).collect()
    held, out = Counter(), Counter()
    for r in rows:
        held[r.source] += r.tokens
        out[r.source] += r.tokens * r.copies
    assert min(r.copies for r in rows) == 1 and max(r.copies for r in rows) == 2
    rate = {s: out[s] / held[s] for s in sizes}
    assert rate["a"] == 1 and 1.9 < rate["c"] <= 2 + 1e-6
    # the exponent by plain bisection: weights p**a, repeats 2 between the largest and the smallest source
    a = 1 - math.log(2) / math.log(held["a"] / held["c"])
    for s in sizes:
        want = held["a"] * (held[s] / held["a"]) ** a
        assert want - 10 <= out[s] <= want + 1e-3 * want
    target = mixing.Target(entropy_share=0.9, most_repeats=None, budget_tokens=500)
    rows = mixing.mixture(df, target).collect()
    weights = {r.source: r.weight for r in rows}
    assert abs(-sum(w * math.log(w) for w in weights.values()) / math.log(3) - 0.9) < 1e-6
    assert 470 <= sum(r.tokens * r.copies for r in rows) <= 500 + 1e-6


def test_mixing_last_pass_is_a_prefix_of_the_permutation(spark):
    df = docs_of(spark, ["one two"] * 50 + ["x"] * 3, None, {i: "b" if i >= 50 else "a" for i in range(53)})
    rows = mixing.mixture(df, mixing.Target(most_repeats=None, entropy_share=0.5, budget_tokens=61)).collect()
    for source in "ab":
        order = sorted((r.cell, r.copies) for r in rows if r.source == source)
        copies = [c for _, c in order]
        assert copies == sorted(copies, reverse=True)


def test_mixing_edges(spark):
    odd = odd_docs(spark)
    out = mixing.mixed(odd)
    assert out.count() == odd.count() + 0 or out.count() > odd.count()
    assert {r.doc_id for r in out.collect()} == {r.doc_id for r in odd.collect()}
    assert mixing.mixed(odd.limit(0)).count() == 0
    positions = [r.position for r in mixing.mixed(docs_of(spark, ["a b"] * 30, None, {0: "z"})).collect()]
    assert all(0 <= p <= 1 for p in positions)


# --- tokens ---


def test_token_counts_and_cache(spark, tmp_path):
    from tokenizers import Tokenizer

    P = pytest.importorskip("public_tokenizers")
    path, cache = P.path("byte_bpe_50k.json"), str(tmp_path / "cache")
    texts = ["Hello there", "Hello there", None, "", "<|endoftext|> x", "naïve éè " * 300]
    df = docs_of(spark, texts)
    plain = Tokenizer.from_file(path)
    want = {i: len(plain.encode(t or "", add_special_tokens=False).ids) for i, t in enumerate(texts)}
    for _ in range(2):
        got = {r.doc_id: r for r in tokens.token_counts(df, path, cache).collect()}
        assert {i: r.n_tokens for i, r in got.items()} == want
        assert all(r.n_bytes == len((texts[i] or "").encode()) and r.over_limit == (r.n_tokens > 512) for i, r in got.items())
        assert tokens.read_cache(spark, cache).count() == 4  # distinct texts, encoded once
    odd = odd_docs(spark)
    assert tokens.token_counts(odd, path, cache).count() == odd.count()
    assert tokens.token_counts(odd.limit(0), path, cache).count() == 0


# --- decontamination ---


def test_containment_against_brute_force(spark):
    rng = random.Random(3)
    items = [" ".join(sample_words(rng, n, 2000)) for n in (5, 8, 12, 20, 20, 40, 80, 3)]
    texts = []
    for i in range(120):
        body = sample_words(rng, rng.choice([0, 3, 30, 600]), 2000)
        piece = items[i % 8].split()
        for _ in range(rng.choice([0, 0, 1, 3])):
            piece[rng.randrange(len(piece))] = "changed"
        at = rng.randint(0, len(body))
        texts.append(" ".join(body[:at] + (piece if i % 3 else []) + body[at:]).upper() + ".")
    items_df = spark.createDataFrame([*enumerate(items), (90, None), (91, "")], "item_id long, text string")
    grams = lambda t: {tuple(w[i : i + 5]) for w in [re.findall(r"[^\W_]+", t.lower())] for i in range(len(w) - 4)}
    want = {(d, k) for d, t in enumerate(texts) for k, x in enumerate(items) if grams(x) and len(grams(x) & grams(t)) >= 0.8 * len(grams(x))}
    got = {(r.doc_id, r.item_id) for r in decontaminate.contained_items(docs_of(spark, texts), items_df).collect()}
    assert got == want and len(want) > 20
    clean = {r.doc_id for r in decontaminate.without_contaminated(docs_of(spark, texts), items_df).collect()}
    assert clean == set(range(120)) - {d for d, _ in want}
    odd = odd_docs(spark)
    assert decontaminate.without_contaminated(odd, items_df).columns == odd.columns
    assert decontaminate.contained_items(odd, items_df.limit(0)).count() == 0
    assert decontaminate.contained_items(odd.limit(0), items_df).count() == 0


# --- lines ---


def word_edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def test_line_dedup_against_brute_force(spark):
    rng = random.Random(4)
    base = [sample_words(rng, n) for n in (3, 6, 9, 10, 11, 12, 20, 33) for _ in range(3)]
    texts = []
    for _ in range(60):
        out = []
        for _ in range(rng.randint(1, 5)):
            w = list(rng.choice(base))
            for _ in range(rng.choice([0, 1, 1, 2])):
                k, at = rng.randrange(3), rng.randrange(len(w))
                w[at : at + (k > 0)] = [] if k == 2 else [rng.choice(["new", "other", w[0]])]
            out.append(" ".join(w).title() if rng.random() < 0.2 else "  ".join(w))
        texts.append("\n".join(out) + rng.choice(["", "\n"]))
    got = {r.doc_id: r for r in lines.dedup_lines(docs_of(spark, texts)).collect()}
    seen = []
    for i, text in enumerate(texts):
        kept, parts = [], text.split("\n")
        for line in parts:
            w = line.lower().split()
            dup = len(w) >= 1 and any(w == s or (min(len(w), len(s)) >= 10 and word_edits(w, s) <= 1) for s in seen)
            seen.append(w) if len(w) >= 1 else None
            kept += [] if dup else [line]
        assert got[i].text == "\n".join(kept), i
        assert (got[i].n_lines, got[i].n_dropped) == (len(parts), len(parts) - len(kept))
    assert sum(r.n_dropped for r in got.values()) > 30


def test_line_dedup_edges(spark):
    odd = odd_docs(spark)
    out = lines.dedup_lines(odd)
    assert out.count() == odd.count()
    assert Counter(r.text for r in out.collect() if r.doc_id in (None, 1)) == {"a null id here": 1, None: 1}
    assert lines.dedup_lines(odd.limit(0)).count() == 0


# --- quality ---


def measures_by_hand(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    spots = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    covered = {k for i in range(len(words) - 7) if spots[tuple(words[i : i + 8])] > 1 for k in range(i, i + 8)}
    kept = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(kept) - len(set(kept)), len(covered)


def test_quality_measures(spark):
    rng = random.Random(5)
    texts = [None, "", " \n ", "a\x0bb\x1cc d", "x " * 30, "é# ü\n\né# ü\n \n"]
    for _ in range(60):
        words = sample_words(rng, rng.randint(0, 60), 8)
        texts.append(rng.choice([" ", "\n"]).join(words + words[: rng.randint(0, 40)]))
    rows = quality.text_measures(docs_of(spark, texts)).collect()
    got = {r.id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in rows}
    assert got == {i: measures_by_hand(t) for i, t in enumerate(texts)}


def test_binomial_tail_is_exact(spark):
    cases = [(k, n, p) for n in (1, 5, 40, 700) for k in (0, 1, 3, 9, 20) for p in (0.01, 0.2) if k <= n]
    for p in (0.01, 0.2):
        rows = spark.createDataFrame([(k, n) for k, n, q in cases if q == p], "k long, n long")
        for r in rows.select("k", "n", quality.binomial_tail(F.col("k"), F.col("n"), p).alias("tail")).collect():
            want = sum(math.comb(r.n, i) * p**i * (1 - p) ** (r.n - i) for i in range(r.k + 1))
            assert r.tail == (1.0 if r.k >= r.n * p else pytest.approx(want, rel=1e-9))


def test_quality_cutoffs_hold_their_risk(spark):
    rng = random.Random(6)
    texts, labels = [], []
    for i in range(4000):
        bad = i % 4 == 0
        texts.append(" ".join(f"{w}###" if bad and rng.random() < 0.9 else w for w in sample_words(rng, 30, 5000)))
        labels.append((i, 0 if bad else 1))
    labels += [(0, None), (None, 1), (4, 0), (4, 1)]
    got = {r.doc_id: r for r in quality.quality_verdicts(docs_of(spark, texts), spark.createDataFrame(labels, "doc_id long, quality int")).collect()}
    assert sum(not got[i].kept for i in range(0, 4000, 4)) == 1000
    assert sum(not got[i].kept for i in range(4000) if i % 4) <= 0.05 * 3000
    none = quality.quality_verdicts(odd_docs(spark), spark.createDataFrame([], "doc_id long, quality int"))
    assert none.count() == odd_docs(spark).count() and all(r.kept == (not r.base_failed) for r in none.collect())


# --- html ---

PAGE = """<!DOCTYPE html><html><head><title>t</title><style>p{}</style><script>var a = "<p>no</p>";</script></head><body>
<header class="site">Site</header><nav><ul><li><a href="/">Home</a></li></ul></nav><div class="ad">Buy</div><div id="cookie-notice">We use</div>
<article><h1>Big &amp; small</h1><p><b>First  line
goes on.<br><p>Second &eacute;&nbsp;one, long enough to count as text of its own.</p><ul><li>item<li>other</ul><form>Name <input></form></article>
<aside>side</aside><section class="comments"><p>nice post</p></section><footer>&copy; me</footer></body></html>"""


def test_main_text(spark):
    want = "Big & small\nFirst line goes on.\nSecond é one, long enough to count as text of its own.\nitem\nother"
    assert html.main_text(PAGE) == want
    assert html.main_text(PAGE.replace("article>", "div>")) == want
    assert html.main_text(None) == html.main_text("") == html.main_text("<nav>x</nav>") == ""
    assert html.main_text("plain <b>words") == "plain words"
    df = spark.createDataFrame([(1, PAGE), (2, None), (1, PAGE), (3, "<p>a" * 3000)], "page_id long, html string")
    got = df.select("page_id", html.extracted(F.col("html")).alias("text")).collect()
    assert len(got) == 4 and [r.text for r in got if r.page_id == 1] == [want] * 2
    assert next(r.text for r in got if r.page_id == 3) == "\n".join(["a"] * 3000)


def test_main_text_of_parts():
    """A lead, a short section or a list in a container of its own belongs to the article as its largest part does."""
    long = "".join(f"<p>{'words that fill a paragraph of some length ' * 6}{i}</p>" for i in range(12))
    for kind in ("article", "main"):
        page = f'<body><nav>menu</nav><{kind}><div class="lead"><h1>Head</h1><p>The lead.</p></div><section>{long}</section><section><ul><li>one<li>two</ul></section></{kind}><div>far away</div></body>'
        got = html.main_text(page).split("\n")
        assert got[:2] == ["Head", "The lead."] and got[-2:] == ["one", "two"] and len(got) == 16
    # without such an element: all content lines, not most of them
    page = f"<body>{'<p>x</p>' * 9}<div><div>{long * 2}</div><div><p>{'the last part has its own words ' * 12}</p></div></div></body>"
    got = html.main_text(page).split("\n")
    assert got[0].startswith("words") and got[-1].startswith("the last part") and len(got) == 25


# --- licenses ---


def test_license_scan(spark):
    assert len(licenses.signature_rules()) > 300
    got = licenses.scan("Released under the MIT License. Apache License, Version 2.0; CC BY-NC 4.0 and CC-BY-NC; GPLv3")
    assert (got["n_base"], got["base_labels"], got["first_word"], got["last_word"]) == (4, "apache-2,cc-by-nc,mit", 1, 16)
    assert got["labels"] == "apache-2,cc-by-nc,gpl-3,mit" and got["score"] == 0.95
    spans = [(s["first"], s["end"]) for s in got["spans"]]
    assert not any(a != b and a[0] <= b[0] and b[1] <= a[1] for a in spans for b in spans)
    assert licenses.scan("This is licensed under the GNU General Public License version 2 or later.")["labels"] == "gpl-2"
    assert licenses.scan("commit the limit of apache helicopters")["labels"] == ""
    rows = spark.createDataFrame([(1, None), (2, ""), (3, "under the\nmit-license"), (3, "under the\nmit-license")], "doc_id long, text string")
    out = rows.select("doc_id", licenses.license_scan(F.col("text")).alias("f")).select("doc_id", "f.*").collect()
    assert Counter((r.doc_id, r.n_words, r.n_base, r.first_word, r.labels) for r in out) == {(1, 0, 0, None, ""): 1, (2, 0, 0, None, ""): 1, (3, 4, 1, 0, "mit"): 2}


# --- language model ---


def test_lm_base_scores_and_gain(spark):
    rng = random.Random(8)
    heads = {0: [f"a{i}" for i in range(40)], 1: [f"b{i}" for i in range(40)]}
    texts = [" ".join(rng.choices(heads[i % 2], k=rng.randint(1, 120))) for i in range(400)] + [None, "", "Never seen " * 3]
    df = docs_of(spark, texts)
    held = held_out("doc_id", 5)
    got = {r.doc_id: r for r in lm.text_scores(df, held, stretch=1.0, rounds=3).collect()}
    words = lambda t: (t or "").encode().lower().split() + [b"\n"]
    is_held = lambda i: crc32(str(i).encode()) % 5 == 1
    counts = Counter(w for i, t in enumerate(texts) if not is_held(i) for w in words(t))
    total = sum(counts.values())
    for i, t in enumerate(texts):
        base = sum(math.log10((counts[w] + 0.5) / (total + 0.5 * (len(counts) + 1))) for w in words(t))
        assert got[i].base_score == pytest.approx(base, abs=1e-9)
        assert (got[i].held_out, got[i].n_tokens, got[i].train_tokens) == (is_held(i), len(words(t)), total)
        assert got[i].n_known == sum(counts[w] > 0 for w in words(t))
    tested = [r for i, r in got.items() if is_held(i) and i < 400]
    assert sum(r.score for r in tested) > sum(r.base_score for r in tested)


def test_lm_probabilities_add_up_and_gradients_match(spark):
    counts = spark.createDataFrame([(f"w{i}", 50 - i % 40) for i in range(60)] + [("\n", 9)], "word string, n long")
    v = lm.make_vocabulary(counts, head=50, frequent=20)
    assert v.shape_tokens.sum() + v.counts[:20].sum() == v.tokens
    net = lm.Network.start(v)
    net = net.like(net.flat() + np.random.default_rng(0).standard_normal(net.flat().size) * 0.2)
    states = np.random.default_rng(1).standard_normal((3, lm.STATE)).astype(np.float32)
    for s in states:
        every = np.arange(len(v.class_of))
        logs, _ = net.log_probs(v, np.repeat(s[None], len(every), 0), every)
        assert np.exp(logs).sum() == pytest.approx(1, abs=1e-4)
    text = np.array([3, 5, 30, 2, 0], np.int32)
    whole = lm.score_texts(net, v, [text, text[:2], text])
    h, prev, total = np.zeros((1, lm.STATE), np.float32), v.end, 0.0
    for t in text:
        h = net.step(net.inputs[[prev]], h)[0]
        total += net.log_probs(v, h, np.array([t]))[0][0]
        prev = t
    assert whole[0] == pytest.approx(total, rel=1e-4) and whole[2] == pytest.approx(total, rel=1e-4)
    trainer = lm.Trainer(net, v)
    before = lm.score_texts(net, v, [text]).sum()
    for _ in range(30):
        trainer.learn([text])
    assert lm.score_texts(net, v, [text]).sum() > before + 1


def test_lm_edges(spark):
    odd = odd_docs(spark)
    out = lm.text_scores(odd, F.lit(False)).collect()
    assert len(out) == 7 and all(r.n_tokens >= 1 and r.score <= 0 for r in out)
    assert lm.text_scores(odd.limit(0), F.lit(False)).count() == 0
    assert {r.n_known for r in lm.text_scores(odd, F.lit(True)).collect()} == {0}


def test_lm_production_setting_shows_every_token_once(spark):
    rng = random.Random(13)
    texts = [" ".join(sample_words(rng, n)) for n in (1, 31, 32, 33, 600, 5000)] + ["again"] * 3 + [None, ""]
    df = docs_of(spark, texts)
    v = lm.make_vocabulary(lm.word_counts(df, "text"))
    assert v.tokens == sum(len((t or "").split()) + 1 for t in texts)
    usual = inspect.signature(lm.text_scores).parameters
    for rounds in (usual["rounds"].default, 5):
        assert lm.train(df, v, "text", rounds, usual["stretch"].default)[1] == v.tokens


def test_lm_texts_wait_for_full_lanes_and_are_learned_to_their_ends(spark):
    counts = spark.createDataFrame([("a", 9), ("b", 5), ("\n", 3)], "word string, n long")
    v = lm.make_vocabulary(counts)
    trainer, symbols = lm.Trainer(lm.Network.start(v), v), np.zeros(100, np.int32)
    trainer.learn([symbols] * (lm.LANES - 1), last=False)
    assert trainer.tokens == 0
    trainer.learn([symbols, symbols[:7]], last=False)
    trainer.learn([])
    assert trainer.tokens == 100 * lm.LANES + 7 and not trainer.waiting


def test_lm_words_symbols_and_groups_are_found_without_a_step_a_word(spark):
    texts = [None, "", " \t\n", "  A\x0bb\x1cc \x0cÉa\n", "w1 w2  W3 zz", "x", "éé w1 ", "東京 w2\rab\u00a0cd"]
    plain = [(t or "").encode().lower().split() for t in texts]
    counts = spark.createDataFrame([(f"w{i}", 9 - i) for i in range(6)] + [("\n", 9), ("x", 1)], "word string, n long")
    v = lm.make_vocabulary(counts, frequent=3)
    whole = pa.array([*texts, "left out"], pa.string())
    for arrow in (whole[: len(texts)], pa.concat_arrays([pa.array(["before"]), whole])[1:-1]):
        words, sizes = lm.words_of(arrow)
        assert sizes.tolist() == [len(p) for p in plain] and [w.encode() for w in words.to_pylist()] == sum(plain, [])
        places = {w.encode(): i for i, w in enumerate(v.index.to_pylist())}
        wanted = [[v.symbols[places[w]] if w in places else v.first_shape + lm.word_shape(w) for w in p] + [v.end] for p in plain]
        assert [s.tolist() for s in lm.symbol_texts(v, arrow)] == wanted
    groups = [g.to_pylist() for g in lm.by_size([whole[:3], whole[3:3], whole[3:]], 12)]
    assert groups == [[None, "", " \t\n", texts[3]], [texts[4]], ["x", texts[6], texts[7]], ["left out"]]


# --- simhash ---


def groups_by_hand(n, linked):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in linked:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return [find(x) for x in range(n)]


def fingerprint_by_hand(text):
    from xxhash import xxh64_intdigest

    words = (text or "").encode().lower().split()
    grams = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [b" ".join(words)] if words else []
    hashes = [xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@pytest.mark.parametrize("full_bucket", [1, 64])
def test_simhash_classes_against_brute_force(spark, full_bucket, monkeypatch):
    rng = random.Random(9)
    texts = [None, "", "a", "A", "two words"]
    for _ in range(25):
        words = sample_words(rng, rng.randint(3, 200), 5000)
        for _ in range(rng.randint(1, 6)):
            copy = list(words)
            for _ in range(rng.randint(0, 1)):
                copy[rng.randrange(len(copy))] = "other"
            texts.append(" ".join(copy))
    prints = [fingerprint_by_hand(t) for t in texts]
    linked = [(a, b) for a, b in itertools.combinations(range(len(texts)), 2) if (prints[a] ^ prints[b]).bit_count() <= 2]
    exact = simhash.close_links
    monkeypatch.setattr(simhash, "close_links", lambda p, k: exact(p, k, full_bucket))
    got = {r.doc_id: r for r in simhash.near_duplicate_classes(docs_of(spark, texts)).collect()}
    assert [got[i].fingerprint % (1 << 64) for i in range(len(texts))] == prints
    assert [got[i].component_id for i in range(len(texts))] == groups_by_hand(len(texts), linked)


def test_close_links_at_all_distances(spark):
    rng = random.Random(10)
    start = [rng.getrandbits(64) for _ in range(6)] + [0, (1 << 64) - 1]
    values = sorted({s ^ sum(1 << b for b in rng.sample(range(64), k)) for s in start for k in (0, 1, 1, 2, 2, 3, 4)})
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    df = spark.createDataFrame([(v,) for v in signed], "fingerprint long")
    for bits, full in itertools.product((0, 1, 2), (1, 64)):
        linked = [(a, b) for a, b in itertools.combinations(range(len(values)), 2) if (values[a] ^ values[b]).bit_count() <= bits]
        at = {v: i for i, v in enumerate(signed)}
        got = [(at[r.a], at[r.b]) for r in simhash.close_links(df, bits, full).collect()]
        assert groups_by_hand(len(values), got) == groups_by_hand(len(values), linked), (bits, full)


def test_components(spark):
    rng = random.Random(11)
    links = [(i, i + 1) for i in range(100, 160)] + [(rng.randrange(60), rng.randrange(60)) for _ in range(40)] + [(7, 7), (500, 499), (500, 499)]
    want = groups_by_hand(600, links)
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: want[x] for a, b in links if a != b for x in (a, b)}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_near_copies(spark):
    rng = random.Random(12)
    texts, groups = [], []
    for g in range(12):
        hub = sample_words(rng, 300, 50_000)
        for k in range(40 if g == 0 else 4):
            copy = list(hub)
            for _ in range(0 if k == 0 else 4):
                copy[rng.randrange(300)] = f"n{rng.randrange(10**6)}"
            texts.append(" ".join(copy))
            groups.append(g)
    order = list(range(len(texts)))
    rng.shuffle(order)
    texts, groups = [texts[i] for i in order], [groups[i] for i in order]
    grams = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (t.split() for t in texts)]
    linked = [(a, b) for a, b in itertools.combinations(range(len(texts)), 2) if groups[a] == groups[b] and len(grams[a] & grams[b]) >= 0.8 * len(grams[a] | grams[b])]
    want = {i for i, root in enumerate(groups_by_hand(len(texts), linked)) if i == root}
    kept = {r.doc_id for r in simhash.without_near_copies(docs_of(spark, texts)).collect()}
    assert kept == want and len(want) < 30
    odd = odd_docs(spark)
    out = simhash.without_near_copies(odd)
    assert out.columns == odd.columns and Counter(r.doc_id for r in out.collect()) == {None: 1, 1: 1, 4: 1, 5: 1}
    assert simhash.without_near_copies(odd.limit(0)).count() == 0


def test_near_copies_cut_or_extended(spark):
    """A passage cut off or put in changes many words at once; similarity of shingles is all that counts."""
    rng = random.Random(14)
    texts = []
    for n in (60, 90, 130, 250, 600) * 6:
        words = sample_words(rng, n, 3000)
        at = rng.randrange(n)
        texts += [" ".join(w) for w in (words, words[: math.ceil(0.84 * n)], words[:at] + [f"x{rng.random()}" for _ in range(n // 8)] + words[at:])]
    grams = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (t.split() for t in texts)]
    similar = lambda a, b: len(grams[a] & grams[b]) >= 0.8 * len(grams[a] | grams[b])
    linked = [(a, b) for g in range(0, len(texts), 3) for a, b in itertools.combinations(range(g, g + 3), 2) if similar(a, b)]
    want = {i for i, root in enumerate(groups_by_hand(len(texts), linked)) if i == root}
    assert {r.doc_id for r in simhash.without_near_copies(docs_of(spark, texts)).collect()} == want and len(want) < 50
