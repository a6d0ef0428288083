"""Thin queries over the driver's tables, one per operator, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import (
    cotrain_quality,
    lbl_lm,
    mcd_rules,
    pivotal_mix,
    site_template,
    sorted_projection,
    suffix_merge_dedup,
    suffix_sentencepiece,
    tensor_minhash,
    token_range_coder,
)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_range_coded_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_range_coder.read_ids(token_range_coder.write_ids(_table(spark, sf_dir, "documents")))


def op2_cotrained_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cotrain_quality.score(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op3_mcd_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mcd_rules.judge(_table(spark, sf_dir, "documents"))


def op4_tensored_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tensor_minhash.near_duplicates(_table(spark, sf_dir, "documents"), width=3, percent=85)
    return rows.select("doc_id", "n_shingles", "component_id", "kept")


def op5_pivotal_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pivotal_mix.mix_report(_table(spark, sf_dir, "documents"))


def op6_log_bilinear_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lbl_lm.score(_table(spark, sf_dir, "documents"))


def op7_site_template_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return site_template.main_text(_table(spark, sf_dir, "pages"))


def op8_sorted_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sorted_projection.near_duplicates(_table(spark, sf_dir, "embeddings"))


def op9_suffix_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_sentencepiece.encode(_table(spark, sf_dir, "documents"), with_ids=False)


def op10_suffix_merge_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return suffix_merge_dedup.cut_repeats(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_range_coded_ids": op1_range_coded_ids,
    "op2_cotrained_quality": op2_cotrained_quality,
    "op3_mcd_quality_rules": op3_mcd_quality_rules,
    "op4_tensored_minhash": op4_tensored_minhash,
    "op5_pivotal_source_mix": op5_pivotal_source_mix,
    "op6_log_bilinear_lm": op6_log_bilinear_lm,
    "op7_site_template_text": op7_site_template_text,
    "op8_sorted_projection": op8_sorted_projection,
    "op9_suffix_sentencepiece": op9_suffix_sentencepiece,
    "op10_suffix_merge_dedup": op10_suffix_merge_dedup,
}

#: Words of the pattern's, lower-cased, and everything that the links of ``edges`` lead to from each of ``nodes``.
_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')"
_REACH = "reach(id, other) AS (SELECT id, id FROM nodes UNION SELECT r.id, e.b FROM reach r JOIN edges e ON e.a = r.other)"

ORACLE_SQL: dict[str, str] = {
    "op4_tensored_minhash": f"""WITH RECURSIVE words AS MATERIALIZED (SELECT doc_id, {_WORDS} AS w FROM documents),
        sets AS MATERIALIZED (SELECT doc_id, CASE WHEN len(w) >= 3 THEN list_distinct(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' '))) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s, len(w) >= 3 AS whole FROM words),
        shingles AS MATERIALIZED (SELECT doc_id, len(s) AS n, whole, unnest(s) AS x FROM sets),
        edges AS MATERIALIZED (SELECT p.doc_id AS a, q.doc_id AS b FROM shingles p JOIN shingles q ON p.x = q.x AND p.whole = q.whole AND p.doc_id <> q.doc_id GROUP BY p.doc_id, q.doc_id HAVING 100 * count(*) >= 85 * (any_value(p.n) + any_value(q.n) - count(*))),
        nodes AS (SELECT doc_id AS id FROM documents), {_REACH}
        SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept FROM sets JOIN (SELECT id AS doc_id, min(other) AS component_id FROM reach GROUP BY 1) USING (doc_id)""",
    "op8_sorted_projection": f"""WITH RECURSIVE good AS MATERIALIZED (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
        edges AS MATERIALIZED (SELECT p.vec_id AS a, q.vec_id AS b FROM good p JOIN good q ON p.label = q.label AND p.vec_id <> q.vec_id AND len(p.v) = len(q.v) WHERE list_cosine_similarity(p.v, q.v) >= 0.93),
        nodes AS (SELECT vec_id AS id FROM embeddings), {_REACH}
        SELECT vec_id, (SELECT count(*) FROM edges WHERE a = vec_id) AS n_links, component_id, vec_id = component_id AS kept FROM (SELECT id AS vec_id, min(other) AS component_id FROM reach GROUP BY 1)""",
    "op10_suffix_merge_dedup": """WITH bytes AS MATERIALIZED (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
        starts AS MATERIALIZED (SELECT doc_id, i, hash(x) AS k, md5_number_lower(x) AS k2 FROM (SELECT doc_id, i, substr(h, CAST(2 * i + 1 AS BIGINT), 400) AS x FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2 - 199)) AS i FROM bytes))),
        twice AS MATERIALIZED (SELECT doc_id, i FROM starts JOIN (SELECT k, k2 FROM starts GROUP BY 1, 2 HAVING count(*) > 1) USING (k, k2)),
        runs AS (SELECT doc_id, min(i) AS lo, max(i) + 200 AS hi FROM (SELECT doc_id, i, sum(CASE WHEN i <= last + 200 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM (SELECT doc_id, i, coalesce(lag(i) OVER (PARTITION BY doc_id ORDER BY i), -1000) AS last FROM twice)) GROUP BY doc_id, run),
        gone AS (SELECT doc_id, sum(hi - lo) AS n_removed, count(*) AS n_spans FROM runs GROUP BY 1),
        pieces AS (SELECT doc_id, hi AS lo, lead(lo) OVER (PARTITION BY doc_id ORDER BY lo) AS hi FROM (SELECT doc_id, lo, hi FROM runs UNION ALL SELECT doc_id, -1, 0 FROM bytes)),
        kept AS (SELECT doc_id, string_agg(substr(h, CAST(2 * lo + 1 AS BIGINT), CAST(2 * (coalesce(hi, length(h) // 2) - lo) AS BIGINT)), '' ORDER BY lo) AS h FROM pieces JOIN bytes USING (doc_id) GROUP BY 1)
        SELECT doc_id, CAST(length(b.h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans, sha256(unhex(k.h)) AS kept_sha256 FROM bytes b JOIN kept k USING (doc_id) LEFT JOIN gone USING (doc_id)""",
}
