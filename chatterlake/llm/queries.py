"""The registered queries of this subpackage: each applies an operator to its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable
from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chatterlake.llm import decontaminate, html, language, licenses, lines, lm, manifest, mixing, quality, simhash, substrings, tokens, whitening
from chatterlake.llm.shared import held_out, scratch_path

#: Rows of a batch that goes to Python: with very long texts too, a batch stays small.
BATCH_ROWS = "500"
#: Names the table of token counts that runs share; unset, a run starts with an empty one of its own.
TOKEN_CACHE = "spark.chatterlake.token-cache"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = held_out("doc_id", 3)
    model = language.learn_languages(docs.where(~held))
    return language.identified(docs, model).withColumn("held_out", held)


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mixing.mixture(table(spark, sf_dir, "documents"), mixing.Target(most_repeats=2.0))
    return plan.select(F.col("id").alias("doc_id"), "source", F.col("tokens").alias("n_tokens"), F.round("weight", 9).alias("weight"), "copies", F.explode(mixing.copy_positions(F.col("copies"), F.col("cell"), F.col("rate"), 0)).alias("each")).select("doc_id", "source", "n_tokens", "weight", "copies", "each.copy", "each.position")


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents")
    cache = spark.conf.get(TOKEN_CACHE, None) or scratch_path(spark, "token-cache")
    return tokens.token_counts(docs, public_tokenizers.path("byte_bpe_50k.json"), cache)


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    return decontaminate.contained_items(docs, items).withColumn("containment", F.round("containment", 6))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.dedup_lines(table(spark, sf_dir, "documents"), least_words=1).select("doc_id", "text", "n_lines", "n_dropped")


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    verdicts = quality.quality_verdicts(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return verdicts.withColumn("failed_rules", F.array_join("failed_rules", ","))


def op7_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", html.extracted(F.col("html")).alias("text"))
    return pages.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = table(spark, sf_dir, "documents").select("doc_id", licenses.license_scan(F.col("text")).alias("found"))
    return found.select("doc_id", "found.*").drop("spans")


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.text_scores(table(spark, sf_dir, "documents"), held_out("doc_id", 5))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    classes = simhash.near_duplicate_classes(table(spark, sf_dir, "documents"))
    return classes.withColumn("fingerprint", F.lpad(F.lower(F.hex("fingerprint")), 16, "0"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = whitening.whitened_vectors(table(spark, sf_dir, "embeddings"))
    each = rows.select("vec_id", F.posexplode(F.arrays_zip("whitened", "explained")).alias("at", "found"), "n", F.col("deviation").cast("long").alias("deviation"), "identity_error")
    return each.select("vec_id", (F.col("at") + 1).alias("component"), "n", "deviation", "found.whitened", "found.explained", "identity_error")


def op12_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    third = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    lowered = F.translate("text", ascii_uppercase, ascii_lowercase)
    docs = table(spark, sf_dir, "documents")
    found = manifest.document_manifest(docs, altered={"text": F.when(third, lowered).otherwise(F.col("text"))})
    rows = found.select("doc_id", "leaf", "subroot", "root", F.sha2(manifest.proof_text(F.col("path")), 256).alias("proof_sha256"), manifest.folded(F.col("altered_leaf"), F.col("path")).alias("folded_root"))
    return rows.withColumn("verified", F.col("folded_root") == F.col("root"))


def op13_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substrings.without_repeats(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_language_id, op2_mixing, op3_token_counts, op4_decontaminate, op5_line_dedup, op6_quality_rules, op7_main_text, op8_license_scan, op9_lm_scoring, op10_simhash, op11_whitening, op12_manifest, op13_substring_dedup)
}

_FIELD = "coalesce(CAST(octet_length(encode(CAST({0} AS VARCHAR))) AS VARCHAR) || ':' || CAST({0} AS VARCHAR), '-')"
_LEAF = "sha256(" + " || ".join(map(_FIELD.format, ("doc_id", "source", "lang", "n_chars"))) + " || " + _FIELD + ")"
#: A level of all trees of a recursion: the nodes of trees that have more than one become one a run.
_LEVEL = "SELECT level + 1, name, run, sha256(string_agg(node, '' ORDER BY place)) FROM (SELECT *, place // 8 AS run, count(*) OVER (PARTITION BY name) AS n FROM {0}) WHERE n > 1 GROUP BY level, name, run"
#: The nodes beside each place's ancestor at each level below the top of its tree.
_STEPS = "SELECT l.name, l.place, t.level, coalesce(string_agg(t.node, '' ORDER BY t.place) FILTER (WHERE t.place < l.place // CAST(8 ** t.level AS BIGINT)), '') || '|' || coalesce(string_agg(t.node, '' ORDER BY t.place) FILTER (WHERE t.place > l.place // CAST(8 ** t.level AS BIGINT)), '') AS step FROM {0} l JOIN {1} t ON t.name IS NOT DISTINCT FROM l.name AND t.place // 8 = l.place // CAST(8 ** (t.level + 1) AS BIGINT) JOIN (SELECT name, max(level) AS height FROM {1} GROUP BY name) h ON h.name IS NOT DISTINCT FROM l.name AND t.level < h.height GROUP BY ALL"

ORACLE_SQL: dict[str, str] = {
    "op12_manifest": f"""WITH RECURSIVE crc AS (SELECT list(v ORDER BY i) AS tab FROM (SELECT i, list_reduce(list_concat([i], [0, 0, 0, 0, 0, 0, 0, 0]), lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM range(256) r(i))),
 marked AS (SELECT *, xor(list_reduce(list_concat([4294967295], list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))), lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])), 4294967295) % 3 = 0 AS third FROM documents, crc),
 leaves AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place FROM (SELECT doc_id, lang AS name, {_LEAF.format("text")} AS leaf, {_LEAF.format(f"CASE WHEN third THEN translate(text, '{ascii_uppercase}', '{ascii_lowercase}') ELSE text END")} AS altered FROM marked)),
 tree(level, name, place, node) AS (SELECT 0, name, place, leaf FROM leaves UNION ALL {_LEVEL.format("tree")}),
 tops AS (SELECT 0 AS name, name AS lang, node AS leaf, row_number() OVER (ORDER BY name NULLS FIRST) - 1 AS place FROM (SELECT name, arg_max(node, level) AS node FROM tree GROUP BY name)),
 above(level, name, place, node) AS (SELECT 0, name, place, leaf FROM tops UNION ALL {_LEVEL.format("above")}),
 own AS (SELECT name, place, list(step ORDER BY level) AS steps FROM ({_STEPS.format("leaves", "tree")}) GROUP BY name, place), upper AS (SELECT place, list(step ORDER BY level) AS steps FROM ({_STEPS.format("tops", "above")}) GROUP BY place),
 paths AS (SELECT l.doc_id, l.leaf, l.altered, t.leaf AS subroot, (SELECT arg_max(node, level) FROM above) AS root, list_concat(coalesce(o.steps, []), coalesce(u.steps, [])) AS steps FROM leaves l JOIN tops t ON t.lang IS NOT DISTINCT FROM l.name LEFT JOIN own o ON o.name IS NOT DISTINCT FROM l.name AND o.place = l.place LEFT JOIN upper u ON u.place = t.place),
 folds AS (SELECT *, list_reduce(list_concat([altered], steps), lambda node, s: sha256(split_part(s, '|', 1) || node || split_part(s, '|', 2))) AS folded_root FROM paths)
 SELECT doc_id, leaf, subroot, root, sha256(array_to_string(list_transform(steps, lambda s: replace(s, '|', '')), '')) AS proof_sha256, folded_root, folded_root = root AS verified FROM folds""",
    "op13_substring_dedup": """WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws FROM documents),
 win AS (SELECT doc_id, p, array_to_string(ws[p : p + 19], ' ') AS k FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 18)) AS p FROM w WHERE doc_id IS NOT NULL)),
 first AS (SELECT k, min({'d': doc_id, 'p': p}) AS f FROM win GROUP BY k), gone AS (SELECT DISTINCT doc_id, unnest(range(p, p + 20)) AS i FROM win JOIN first USING (k) WHERE {'d': doc_id, 'p': p} > f),
 lost AS (SELECT doc_id, list(i) AS places FROM gone GROUP BY doc_id), kept AS (SELECT w.doc_id, ws, coalesce(len(places), 0) AS n_removed, list_transform(list_filter(list_zip(ws, range(1, len(ws) + 1)), lambda x: places IS NULL OR NOT list_contains(places, x[2])), lambda x: x[1]) AS words FROM w LEFT JOIN lost USING (doc_id))
 SELECT doc_id, len(ws) AS n_words, n_removed, sha256(array_to_string(words, ' ')) AS kept_sha256 FROM kept""",
}
