"""Vectors and cluster-quality scores over the embeddings table."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.functions.numeric import np_round
from quarry.operators import scores, vectors
from quarry.plans.registry import register
from quarry.plans.standins import np_round_sql
from quarry.sources.tables import table


def points(spark, sf):
    """Stand-in for clustered texts: one embedding per point, its label as the
    cluster, label 9 playing noise (-1), unit volume."""
    e = table(spark, sf, "embeddings")
    return e.select(F.col("vec_id"),
                    F.when(F.col("label") == 9, F.lit(-1)).otherwise(F.col("label")).alias("label"),
                    vectors.as_double_array("embedding").alias("features"),
                    F.lit(1).cast("bigint").alias("count"))


_PTS_SQL = """p AS (SELECT vec_id, CASE WHEN label = 9 THEN -1 ELSE label END AS label,
                  CAST(embedding AS DOUBLE[]) AS e, 1 AS count FROM embeddings),
v AS (SELECT * FROM p WHERE label <> -1)"""


@register("m8_l2_normalize", sql=f"""WITH {_PTS_SQL},
n AS (SELECT vec_id, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS nrm FROM p),
u AS (SELECT vec_id, unnest(CASE WHEN nrm > 0 THEN list_transform(e, lambda x: x / nrm) ELSE e END) AS x,
             generate_subscripts(e, 1) - 1 AS dim FROM n)
SELECT vec_id, CAST(dim AS INTEGER) AS dim, {np_round_sql('x', 6)} AS value FROM u""")
def m8_l2_normalize(spark, sf):
    """M8: L2 row normalisation, long form (vec_id, dim, value)."""
    p = points(spark, sf).select("vec_id", vectors.l2_normalize(F.col("features")).alias("u"))
    return p.select("vec_id", F.posexplode("u").alias("dim", "x")).select(
        "vec_id", "dim", np_round("x", 6).alias("value"))


@register("e_volume_scores", sql=f"""WITH {_PTS_SQL},
vols AS (SELECT label, sum(count) AS vol FROM p GROUP BY label),
c AS (SELECT label, vol, row_number() OVER (ORDER BY vol DESC, label) AS r FROM vols WHERE label <> -1),
k AS (SELECT count(*) AS k FROM c)
SELECT {np_round_sql("(CAST((SELECT coalesce(sum(vol), 0) FROM vols WHERE label = -1) AS DOUBLE) / CAST((SELECT sum(vol) FROM vols) AS DOUBLE)) * 100.0", 2)} AS noise_ratio_pct,
       (SELECT k FROM k) AS total_clusters,
       {np_round_sql("(SELECT CAST(median(vol) AS DOUBLE) FROM c)", 2)} AS median_cluster_size,
       {np_round_sql("(CAST((SELECT sum(vol) FROM c WHERE r <= greatest(1, floor((SELECT k FROM k) * 0.1))) AS DOUBLE) / CAST(greatest(1, (SELECT sum(vol) FROM c)) AS DOUBLE)) * 100.0", 2)} AS top_10_pct_coverage""")
def e_volume_scores(spark, sf):
    """E1 + E5 + E6 + E7: noise share, cluster count, median volume, top-10 % coverage."""
    return scores.volume_scores(points(spark, sf))


_SCORE_SQL = f"""WITH {_PTS_SQL},
pairs AS (SELECT a.vec_id AS ia, a.label AS la, b.label AS lb, list_distance(a.e, b.e) AS d
          FROM v a, v b WHERE a.vec_id <> b.vec_id),
per AS (SELECT ia, la, lb, avg(d) AS md FROM pairs GROUP BY ALL),
ab AS (SELECT ia, max(CASE WHEN la = lb THEN md END) AS a, min(CASE WHEN la <> lb THEN md END) AS b FROM per GROUP BY ia),
sil AS (SELECT avg(CASE WHEN a IS NULL THEN 0.0 ELSE (b - a) / greatest(a, b) END) AS s FROM ab),
ev AS (SELECT vec_id, label, unnest(e) AS x, generate_subscripts(e, 1) AS i FROM v),
c1 AS (SELECT label, i, avg(x) AS c FROM ev GROUP BY ALL),
cent AS (SELECT label, list(c ORDER BY i) AS c FROM c1 GROUP BY label),
cn AS (SELECT label, count(*) AS n FROM v GROUP BY label),
pd AS (SELECT v.label, list_distance(v.e, cent.c) AS d FROM v JOIN cent USING (label)),
s AS (SELECT label, avg(d) AS s, sum(d * d) AS w FROM pd GROUP BY label),
cd AS (SELECT a.label AS la, b.label AS lb, list_distance(a.c, b.c) AS d FROM cent a, cent b WHERE a.label <> b.label),
db AS (SELECT avg(m) AS db FROM (
  SELECT la, max((sa.s + sb.s) / cd.d) AS m FROM cd JOIN s sa ON sa.label = cd.la JOIN s sb ON sb.label = cd.lb GROUP BY la)),
gm AS (SELECT i, avg(x) AS g FROM ev GROUP BY i),
ex AS (SELECT sum(cn.n * q.sq) AS extra FROM cn JOIN (
  SELECT c1.label, sum((c1.c - gm.g) * (c1.c - gm.g)) AS sq FROM c1 JOIN gm USING (i) GROUP BY c1.label) q USING (label)),
kk AS (SELECT count(*) AS k, sum(n) AS n FROM cn)"""


@register("e_quality_scores", sql=_SCORE_SQL + f"""
SELECT {np_round_sql('(SELECT s FROM sil)', 4)} AS silhouette,
       {np_round_sql('(SELECT db FROM db)', 4)} AS davies_bouldin,
       {np_round_sql('(SELECT extra FROM ex) * ((SELECT n FROM kk) - (SELECT k FROM kk)) / ((SELECT sum(w) FROM s) * ((SELECT k FROM kk) - 1.0))', 2)} AS calinski_harabasz""")
def e_quality_scores(spark, sf):
    """E2 + E3 + E4 + E8: silhouette (exact on the <=10k seeded sample),
    Davies-Bouldin, Calinski-Harabasz."""
    card = scores.evaluate(points(spark, sf), "vec_id")
    return card.select("silhouette", "davies_bouldin", "calinski_harabasz")
