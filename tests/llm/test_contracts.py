"""Registered queries as such: columns, ids beside a null, caches, and brute force where SQL can't say what is wanted."""

import html as html_module
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from chatterlake.llm import decontaminate, html, language, licenses, lm, quality, queries, simhash, tokens
from chatterlake.llm.shared import held_out

SMALL = "/root/testdata/sf0.001"
BIG = 2**53 + 1
CONTRACT = {
    "op1_language_id": {"doc_id": "bigint", "held_out": "boolean", "lang_pred": "string", "score": "double"},
    "op3_token_counts": {"doc_id": "bigint", "n_bytes": "bigint", "n_tokens": "bigint", "over_limit": "boolean"},
    "op6_quality_rules": {"doc_id": "bigint", "n_words": "bigint", "word_chars": "bigint", "n_symbols": "bigint", "n_dup_lines": "bigint", "n_repeat_words": "bigint", "base_failed": "boolean", "kept": "boolean"},
    "op7_main_text": {"page_id": "bigint", "url": "string", "text": "string", "n_chars": "bigint"},
    "op8_license_scan": {"doc_id": "bigint", "n_words": "bigint", "n_base": "bigint", "first_word": "bigint", "last_word": "bigint", "base_labels": "string", "labels": "string", "score": "double"},
    "op9_lm_scoring": {"doc_id": "bigint", "held_out": "boolean", "n_tokens": "bigint", "n_known": "bigint", "train_tokens": "bigint", "base_score": "double", "score": "double"},
    "op10_simhash": {"doc_id": "bigint", "fingerprint": "string", "component_id": "bigint"},
}


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Tables with a null id beside a large one, null, empty and long texts, repeated rows, a source with most rows."""
    path = str(tmp_path_factory.mktemp("tables"))
    rng = random.Random(4)
    say = lambda n: " ".join(rng.choice("the quick brown fox jumps over lazy dogs while rivers of words flow past quiet towns".split()) for _ in range(n))
    item = "seven wise monkeys counted eleven shining stones beside the old river bank"
    rows = [(None, say(30), "en", "s"), (BIG, say(40) + " " + item, "en", "s"), (BIG + 1, None, None, None), (3, "", "en", "s"), (4, say(12), "en", "s"), (4, say(12), "en", "s"), (5, "½ ² ³ Ⅷ", "en", "s"), (6, say(20_000), "en", "t")]
    rows += [(100 + i, say(rng.randint(1, 90)), rng.choice(["en", "fr"]), "s") for i in range(60)] + [(7, "same words here\n" * 3, "en", "s")] * 3
    docs = spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, item), (2, None), (None, say(15))], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    spark.createDataFrame([(100 + i, int(i % 4 > 0), 0) for i in range(60)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(BIG, [0.5, 1.0], 0), (None, [0.25, 3.0], 0), (1, [None, 1.0], 0), (2, None, 0), (3, [1.5, 2.0], 0)], "vec_id long, embedding array<float>, label int").write.parquet(f"{path}/embeddings.parquet")
    spark.createDataFrame([(1, "u", "<p>a</p><![foo[bar]]><p>b"), (None, None, None), (BIG, "u", "")], "page_id long, url string, html string").write.parquet(f"{path}/pages.parquet")
    return path, rows


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_registered_queries_keep_their_contract_and_ids(spark, folder, name):
    path, rows = folder
    out = queries.QUERIES[name](spark, path)
    types = dict(out.dtypes)
    assert all(types.get(c) == kind for c, kind in CONTRACT.get(name, {}).items()), types
    got = out.collect()
    if name in CONTRACT and name != "op7_main_text":
        assert Counter(r.doc_id for r in got) == Counter(r[0] for r in rows)
    if name == "op7_main_text":
        assert {r.page_id: r.text for r in got} == {1: "a\nb", None: "", BIG: ""}
    if name == "op4_decontaminate":
        assert [(r.doc_id, r.item_id) for r in got if r.item_id == 1] == [(BIG, 1)]
    if name == "op10_simhash":
        assert all(r.component_id is None or r.component_id in {x[0] for x in rows} for r in got)


def test_containment_by_join_is_the_broadcast_search(spark, folder, monkeypatch):
    path, _ = folder
    docs, items = (spark.read.parquet(f"{path}/{n}.parquet") for n in ("documents", "benchmark"))
    more = items.unionByName(docs.where("doc_id >= 100").limit(20).select((F.col("doc_id") * 10).alias("item_id"), "text"))
    one = lambda: Counter((r.doc_id, r.item_id, r.n_shared, r.n_shingles) for r in decontaminate.contained_items(docs, more).collect())
    rest = lambda: Counter((r.doc_id, r.text) for r in decontaminate.without_contaminated(docs, more).select("doc_id", "text").collect())
    want, kept = one(), rest()
    monkeypatch.setattr(decontaminate, "BROADCAST_SHINGLES", 0)
    assert one() == want and sum(want.values()) >= 20 and rest() == kept


def test_a_warm_cache_encodes_nothing(spark, tmp_path):
    import public_tokenizers

    docs = spark.createDataFrame([(1, "a text"), (1, "a text"), (2, "a text"), (2, "a text"), (2, "a text"), (3, None), (4, "other")], "doc_id long, text string")
    cache, file = str(tmp_path / "cache"), public_tokenizers.path("byte_bpe_50k.json")
    first = sorted(map(tuple, tokens.token_counts(docs, file, cache).collect()), key=str)
    rows = spark.read.parquet(cache).count()
    assert rows == 3 and len(first) == 7  # a text each, whatever repeats it
    assert sorted(map(tuple, tokens.token_counts(docs, file, cache).collect()), key=str) == first
    assert spark.read.parquet(cache).count() == rows


def test_language_against_brute_force(spark):
    """Each dictionary in turn on each whole text, with the library alone."""
    import zstandard

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    model = language.learn_languages(docs.where(~held_out("doc_id", 3)), budget_bytes=20_000)
    got = {r.doc_id: r for r in language.identified(docs, model).collect()}
    sizes = {}
    for lang, content in zip(model.languages, model.contents, strict=True):
        d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        pack = zstandard.ZstdCompressor(level=language.LEVEL, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False)
        head = content[: language.CARRIER_BYTES] + b" "
        sizes[lang] = lambda data, pack=pack, head=head: sum(len(pack.compress(head + data[i : i + language.BLOCK_BYTES])) - len(pack.compress(head)) for i in range(0, len(data), language.BLOCK_BYTES))
    right = checked = 0
    for r in docs.collect():
        data = language.plain(r.text or "")
        if not data:
            assert got[r.doc_id].lang_pred == "und"
            continue
        totals = [(max(1, sizes[k](data)), k) for k in model.languages]
        assert got[r.doc_id].lang_pred == min(totals)[1]
        if r.lang:
            checked += 1
            right += got[r.doc_id].lang_pred == r.lang
    assert checked > 100 and right / checked > 0.95
    for text in ("½ ² ³", "Ⅷ", "123 456", "—"):
        assert language.plain(text) == b""


def test_main_text_against_the_pages_own_articles(spark):
    """The generated pages have one article; its blocks, cut by hand, are what is wanted."""
    blocks = re.compile(r"</?(?:p|h[1-6]|li|ul|ol|div|section|blockquote|table|tr|td|th|pre|article|header|figure|figcaption|hr)\b[^>]*>", re.I)
    seen = 0
    for r in spark.read.parquet(f"{SMALL}/pages.parquet").collect():
        found = re.findall(r"<article\b[^>]*>(.*?)</article>", r.html or "", re.S)
        if len(found) != 1 or re.search(r"<(script|style|aside|nav|form|footer|!--)|class=", found[0]):
            continue
        lines = (" ".join(html_module.unescape(re.sub(r"<[^>]+>", "", re.sub(r"<br\s*/?>", " ", x))).split()) for x in blocks.split(found[0]))
        assert html.main_text(r.html) == "\n".join(x for x in lines if x)
        seen += 1
    assert seen > 20


def test_main_text_reads_any_markup():
    rng = random.Random(11)
    bits = ["<", ">", "<p>", "</p>", "<div class='x'>", "</div>", "<![foo[bar]]>", "<![CDATA[", "]]>", "<!", "<!--", "-->", "&amp;", "&#0;", "&bogus", "<script>", "</script>", "text ", "<br/>", "<li>", "<td>", "<article>", "</article>", "<a href='", '"', "<?php", "<!DOCTYPE x [", "]"]
    for _ in range(2000):
        html.main_text("".join(rng.choice(bits) for _ in range(rng.randint(1, 30))))
    assert html.main_text('<article><h1>T</h1><p>lead words</p><div class="related-work"><p>a long body that goes on for a while</p></div><div class="related-posts">x</div><div class="cookie-notice">c</div></article>') == "T\nlead words\na long body that goes on for a while"


def test_license_sweep_against_all_pairs():
    rng = random.Random(12)
    names = ["under the mit license", "apache license version 2 0", "cc by nc", "cc by", "licensed under the apache license version 2", "gnu general public license", "gplv3", "all rights reserved", "bsd 3 clause license", "words", "spdx license identifier mit license", "this source code form is subject to the terms of the mozilla public license v 2 0"]
    for _ in range(150):
        text = " ".join(rng.choice(names) for _ in range(rng.randint(1, 14)))
        words = licenses.text_words(text)
        joined = " ".join(words)
        rules = licenses.rules_by_keyword()
        all_found = [(m.start(), m.end(), rule) for k in rules if k in joined for rule in rules[k] for m in rule.pattern.finditer(joined)]
        outranks = lambda a, b: a[0] <= b[0] and b[1] <= a[1] and ((a[2].priority, a[0] - a[1], a[2].order) < (b[2].priority, b[0] - b[1], b[2].order))
        want = sorted({(s, e, r.label) for s, e, r in all_found if not any(outranks(x, (s, e, r)) for x in all_found)})
        got = licenses.scan(text)
        assert sorted((x["first"], x["end"], x["label"]) for x in got["spans"]) == sorted((joined.count(" ", 0, s), joined.count(" ", 0, e) + 1, label) for s, e, label in want)
        places = [i for phrase, _ in licenses.BASE_PHRASES for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
        assert (got["n_base"], got["first_word"], got["last_word"]) == (len(places), min(places, default=None), max(places, default=None))


def test_quality_trials_are_distinct_texts_in_each_stratum(spark):
    rng = random.Random(9)
    rows, labels = [], []
    for s, lang in enumerate(("en", "fr", None)):
        for i in range(700):
            bad = i % 4 == 0
            text = " ".join(f"w{rng.randrange(10**6)}" for _ in range(40)) + (" ###" * 30 if bad and s < 2 else "")
            rows.append((s * 1000 + i, text, lang))
            labels.append((s * 1000 + i, int(not bad)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    marks = spark.createDataFrame(labels, "doc_id long, quality int")
    cut = lambda d: {r.stratum if not r.no_stratum else None: r.max_symbol_rate for r in quality.certified_cutoffs(quality.with_rates(quality.text_measures(d)), marks, risk=0.3).collect()}
    once = cut(docs)
    assert once.get("en") is not None and once.get("fr") is not None and once.get(None) is None
    few = docs.where("doc_id % 20 = 0")
    copies = few.withColumn("n", F.explode(F.sequence(F.lit(1), F.lit(30)))).drop("n")
    assert cut(copies) == cut(few)  # repeated rows are no more evidence
    same = marks.select("doc_id").join(docs.drop("text"), "doc_id").withColumn("text", F.lit("one text for all ### of them"))
    assert cut(same) == {}


def test_near_duplicates_over_all_pairs(spark):
    """Recall over all pairs of texts of sf0.01 with a similarity of 0.8 or more in 5-word shingles."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = docs.select("doc_id", "text").collect()
    sets = {r.doc_id: frozenset(simhash.shingles_of(simhash.words_of(r.text), 5)) for r in rows}
    groups = simhash.duplicate_groups(docs).collect()
    of = {r.node.id: r.first for r in groups}
    holders: dict[bytes, list[int]] = {}
    for i, s in sets.items():
        for x in s:
            holders.setdefault(x, []).append(i)
    shared = Counter((a, b) for ids in holders.values() if len(ids) < 400 for k, a in enumerate(ids) for b in ids[k + 1 :])
    close = [(a, b) for (a, b), n in shared.items() if n >= 0.8 * (len(sets[a]) + len(sets[b]) - n)]
    assert len(close) > 40 and all(of[a] == of[b] for a, b in close)


def test_lm_takes_large_ids_and_gains_over_counts(spark, folder):
    path, rows = folder
    got = lm.text_scores(spark.read.parquet(f"{path}/documents.parquet"), held_out("doc_id", 5)).collect()
    assert Counter(r.doc_id for r in got) == Counter(r[0] for r in rows)
    assert all(np.isfinite(r.score) and r.score < 0 for r in got)
