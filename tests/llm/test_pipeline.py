"""The pipeline on planted documents, stage by stage."""

import random

import corpus_pipeline
from chatterlake.llm import mixing
from chatterlake.llm.queries import QUERIES

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def planted(spark, folder):
    rng = random.Random(3)
    stems = {"aa": ["stra", "bel", "mion", "tur", "lap"], "bb": ["kow", "zek", "prz", "wyl", "dub"]}
    word = lambda k: "".join(rng.choices(stems[k], k=rng.randint(1, 4)))
    prose = lambda k, n: "\n".join(" ".join(word(k) for _ in range(25)) for _ in range(n))
    texts = [(i, prose("aa" if i % 2 else "bb", 8), "aa" if i % 2 else "bb") for i in range(80)]
    item = " ".join(word("aa") + str(i) for i in range(30))
    texts.append((80, texts[10][1], "bb"))
    near = texts[11][1].split()
    for at in (30, 31, 32):
        near[at] = "other"
    texts.append((81, " ".join(near), "aa"))
    texts.append((82, prose("aa", 4) + "\n" + item + "\n" + prose("aa", 4), "aa"))
    texts.append((83, "12 34 -- 56", "aa"))
    rows = [(i, t, k, "big" if i % 3 else "small", len(t)) for i, t, k in texts]
    spark.createDataFrame(rows, DOCS).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")


def test_stages_take_effect(spark, tmp_path):
    planted(spark, tmp_path)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    ids, at = {}, docs
    for name, stage in corpus_pipeline.STAGES:
        at = stage(spark, at, str(tmp_path))
        at.write.parquet(f"{tmp_path}/out/{name}")
        at = spark.read.parquet(f"{tmp_path}/out/{name}")
        ids[name] = {r.doc_id for r in at.select("doc_id").collect()}
        if name != "source_mixing":
            assert at.columns == list(corpus_pipeline.COLUMNS)
    clean = set(range(80))
    assert ids["language_id"] == clean | {80, 81, 82}
    assert ids["line_dedup"] == clean | {81, 82}  # 80 repeats all lines of 10
    assert ids["near_dedup"] == clean | {82}
    assert ids["decontamination"] == ids["source_mixing"] == clean
    got = corpus_pipeline.run(spark, str(tmp_path))
    assert {r.doc_id for r in got.collect()} == clean and got.where("copy > 1").count() == 0
    assert got.where("n_chars != length(text)").count() == 0


def test_short_lines_count_too(spark, tmp_path):
    rows = [(0, "Read more\nfirst own line\n\n-"), (1, "read  more\nsecond\n\n-"), (2, "second")]
    docs = spark.createDataFrame([(i, t, "aa", "s", len(t)) for i, t in rows], DOCS)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in QUERIES["op5_line_dedup"](spark, str(tmp_path)).collect()}
    assert {i: r.text for i, r in got.items()} == {0: rows[0][1], 1: "second\n", 2: ""}  # blank lines have no words
    assert [got[i].n_dropped for i in range(3)] == [0, 2, 1]
    kept = {r.doc_id: r.text for r in dict(corpus_pipeline.STAGES)["line_dedup"](spark, docs, str(tmp_path)).collect()}
    assert kept == {0: rows[0][1], 1: "second\n"}


def test_mixing_query_gives_each_copy_its_place(spark, tmp_path):
    planted(spark, tmp_path)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    want = sorted((r.doc_id, r.copy, r.position) for r in mixing.mixed(docs, mixing.Target(most_repeats=2.0)).collect())
    got = QUERIES["op2_mixing"](spark, str(tmp_path)).collect()
    assert sorted((r.doc_id, r.copy, r.position) for r in got) == want and len(want) > docs.count()


def test_stages_on_odd_rows(spark, tmp_path):
    """Null ids, texts, languages and sources, empty and blank texts, repeated rows, clashing columns; and an empty table."""
    spark.createDataFrame([(1, "one two three four five six"), (None, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    long = " ".join(f"word{chr(97 + i % 26)}x" for i in range(3000))
    rows = [(None, "a null id is here with some words", None, None), (1, None, "aa", "s"), (2, "", None, "s"), (3, " \n\t", "aa", None), (5, long, "aa", "s")]
    rows += [(4, "the very same row stands here twice over", "aa", "s")] * 2 + [(6, "say one two three four five six", "aa", "s"), (7, "12 34", "aa", "s")]
    odd = spark.createDataFrame([(*r, 5) for r in rows], DOCS)
    odd = odd.selectExpr("*", *(f"1 as {c}" for c in ("id", "key", "node", "line_no", "copy", "cell", "text_key", "n_lines", "__id", "score")))
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, odd, str(tmp_path))
        assert out.columns[:5] == list(corpus_pipeline.COLUMNS), name
        ids = [r.doc_id for r in out.select("doc_id").collect()]
        assert set(ids) <= {r[0] for r in rows} and 5 in ids and 4 in ids, name
        if name == "near_dedup":
            assert ids.count(4) == 1 and None in ids
        if name == "decontamination":
            assert 6 not in ids and len(ids) == len(rows) - 1
        if name == "language_id":
            assert not {1, 2, 3, 7} & set(ids)
        assert stage(spark, odd.limit(0), str(tmp_path)).count() == 0, name


def test_all_queries_are_named():
    assert sorted(int(q[2:].split("_")[0]) for q in QUERIES) == list(range(1, 14))
