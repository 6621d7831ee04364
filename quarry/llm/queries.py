"""Registered queries of the subpackage: name -> (spark, sf_dir) -> DataFrame, and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quarry.llm import (
    adsampling,
    alignment,
    bpe,
    exact_topk,
    hard_negatives,
    html_text,
    licenses,
    mixing,
    quality,
    simhash,
    token_counts,
    token_files,
    toxicity,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_files": token_files.query,
    "op2_weak_label_quality": quality.query,
    "op3_html_main_text": html_text.query,
    "op4_license_scan": licenses.query,
    "op5_adaptive_dimension_scan": adsampling.query,
    "op6_simhash_near_dedup": simhash.query,
    "op7_byte_bpe": bpe.query,
    "op8_source_mixing": mixing.query,
    "op9_exact_topk": exact_topk.query,
    "op10_toxicity": toxicity.query,
    "op11_token_counts": token_counts.query,
    "op12_cross_tokenizer_alignment": alignment.query,
    "op13_hard_negatives": hard_negatives.query,
}

#: Rows of embeddings that take part, as whole numbers: (vec_id, label, v).
_VECTORS = """SELECT vec_id, label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"""

ORACLE_SQL: dict[str, str] = {
    "op9_exact_topk": f"""WITH rows AS ({_VECTORS} AND len(embedding) > 0),
scored AS (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v)::BIGINT AS score
  FROM rows q JOIN rows c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v)),
ranked AS (SELECT query_id, vec_id, score,
    row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS place FROM scored)
SELECT query_id, place::INTEGER AS "rank", vec_id, score FROM ranked WHERE place <= 5""",
    "op13_hard_negatives": f"""WITH rows AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, v
  FROM ({_VECTORS}) WHERE label IS NOT NULL),
scored AS (SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same,
    list_dot_product(a.v, c.v)::BIGINT AS score
  FROM rows a JOIN rows c ON a.vec_id % 100 = 0 AND a.vec_id <> c.vec_id AND len(a.v) = len(c.v)),
positives AS (SELECT * FROM (SELECT anchor_id, vec_id AS positive_id, score AS positive_score,
    row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS place FROM scored WHERE same)
  WHERE place <= 5),
ranked AS (SELECT p.anchor_id, positive_id, n.vec_id AS negative_id, positive_score, n.score AS negative_score,
    row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY n.score DESC, n.vec_id) AS place
  FROM positives p JOIN scored n ON n.anchor_id = p.anchor_id AND NOT n.same
    AND 30 * positive_score <= 100 * n.score AND 100 * n.score <= 90 * positive_score)
SELECT anchor_id, positive_id, place::INTEGER AS "rank", negative_id, positive_score, negative_score
FROM ranked WHERE place <= 10""",
}
