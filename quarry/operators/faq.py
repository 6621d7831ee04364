"""Cluster summaries, FAQ tables and cluster matrices.

Input is a *mapping*: one row per unique question text with ``crop``,
``cluster_id`` (-1 = noise), ``count`` and optionally ``top_keywords``.
Per-crop work is keyed by ``crop``; a crop holding a third of the rows is split
by the cluster key in every shuffle (clusters, not crops, are the group unit).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.numeric import np_round, pct
from quarry.functions.text import file_slug, py_strip
from quarry.operators.saturation import prefix_rank


def representative(text_col: str = "query_text", count_col: str = "count"):
    """Text with the largest count; ties -> smallest text (documented order)."""
    return F.min_by(F.col(text_col), F.struct(-F.col(count_col), F.col(text_col)))


def top_keywords(mapping: DataFrame, keys: Sequence[str], kw_col: str = "top_keywords",
                 k: int = 5) -> DataFrame:
    """The ``k`` most common keywords of a comma-separated column per group
    (split on ',', strip, count, ties by keyword), as ', '-joined text."""
    kw = (mapping.where(F.length(F.coalesce(F.col(kw_col), F.lit(""))) > 0)
          .select(*keys, F.explode(F.split(kw_col, ",")).alias("kw"))
          .select(*keys, py_strip("kw").alias("kw")))
    counts = kw.groupBy(*keys, "kw").agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy(*keys).orderBy(F.desc("_n"), F.asc("kw"))
    top = counts.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k)
    return top.groupBy(*keys).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_r", "kw"))), lambda s: s["kw"]),
                     ", ").alias(kw_col))


def cluster_summary(mapping: DataFrame, group_cols: Sequence[str] = ("crop",),
                    with_keywords: bool = True) -> DataFrame:
    """Per non-noise cluster: size = sum(count), unique_queries, representative,
    top keywords."""
    keys = [*group_cols, "cluster_id"]
    clean = mapping.where(F.col("cluster_id") != -1)
    summ = clean.groupBy(*keys).agg(F.sum("count").cast("bigint").alias("size"),
                                    F.count(F.lit(1)).alias("unique_queries"),
                                    representative().alias("representative"))
    if not with_keywords:
        return summ
    kws = top_keywords(clean, keys)
    return summ.join(kws, keys, "left").withColumn(
        "top_keywords", F.coalesce(F.col("top_keywords"), F.lit("")))


def faq_themes(summary: DataFrame, crop_col: str = "crop", k: int = 5,
               crop_totals: DataFrame | None = None) -> DataFrame:
    """Per crop the ``k`` largest clusters; ``Percentage`` = count over the
    WHOLE crop total (unrounded).  ``crop_totals`` defaults to the sum of sizes."""
    if crop_totals is None:
        crop_totals = summary.groupBy(crop_col).agg(F.sum("size").alias("crop_total"))
    w = Window.partitionBy(crop_col).orderBy(F.desc("size"), F.asc("cluster_id"))
    top = summary.withColumn("theme_rank", F.row_number().over(w)).where(F.col("theme_rank") <= k)
    return (top.join(crop_totals, crop_col)
            .select(crop_col, "theme_rank", F.col("representative").alias("question"),
                    F.col("size").alias("count"), pct("size", "crop_total").alias("percentage")))


def crop_report(mapping: DataFrame, crop_col: str = "crop") -> DataFrame:
    """Per crop total queries, unique texts and non-noise cluster count."""
    return mapping.groupBy(crop_col).agg(
        F.sum("count").cast("bigint").alias("total_queries"),
        F.count(F.lit(1)).alias("unique_queries"),
        F.countDistinct(F.when(F.col("cluster_id") != -1, F.col("cluster_id"))).alias("total_clusters"))


def faq_index(themes: DataFrame, crop_col: str = "crop") -> DataFrame:
    """Per crop the sum of its theme counts (not the crop total), number of
    themes, top question and file name; keyed by crop (no slug collisions)."""
    return themes.groupBy(crop_col).agg(
        F.sum("count").cast("bigint").alias("total_queries"),
        F.count(F.lit(1)).alias("n_themes"),
        F.min_by("question", "theme_rank").alias("top_question")).withColumn(
        "csv_file", F.concat(file_slug(crop_col), F.lit("_faq.csv")))


def cluster_matrix(mapping: DataFrame, group_cols: Sequence[str] = ("Experiment", "crop"),
                   top_k: int = 5, sep: str = " || ") -> DataFrame:
    """W3 + W4: clusters re-ranked 1..n per group by volume (ties by cluster id),
    share of the non-noise group volume, running share and the ``top_k`` texts by
    count.  The running share is the exact ratio cumulative volume / total (the
    reference adds up unrounded float shares; both are rounded to 2 on output and
    differ only by float drift).

    The ranking is the distributed prefix rank, so a group with a third of all
    clusters is spread over many tasks."""
    group_cols = list(group_cols)
    clean = mapping.where(F.col("cluster_id") != -1)
    vols = clean.groupBy(*group_cols, "cluster_id").agg(F.sum("count").cast("bigint").alias("vol"))
    ranked = prefix_rank(vols, "vol", ["cluster_id"], group_cols)
    w = Window.partitionBy(*group_cols, "cluster_id").orderBy(F.desc("count"), F.asc("query_text"))
    texts = (clean.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= top_k)
             .groupBy(*group_cols, "cluster_id")
             .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_r", "query_text"))),
                                           lambda s: s["query_text"]), sep).alias("top_5_queries")))
    out = ranked.join(texts, [*group_cols, "cluster_id"])
    return out.select(*group_cols, F.col("rank").alias("cluster_id"),
                      F.col("vol").alias("queries_in_cluster"),
                      np_round(pct("vol", "total"), 2).alias("pct_of_crop"),
                      np_round(pct("cum_size", "total"), 2).alias("cumulative_pct"),
                      "top_5_queries")


def clusters_to_threshold(matrix: DataFrame, threshold: float = 85.0, crop_col: str = "crop",
                          exp_col: str = "Experiment",
                          experiments: Sequence[str] | None = None) -> DataFrame:
    """W5 + J4: first re-ranked cluster whose rounded running share reaches the
    threshold, for every (crop, experiment) pair of the grid; null if never.
    The experiment list is the (short) list of configurations."""
    from quarry.operators.joins import full_grid
    reach = (matrix.where(F.col("cumulative_pct") >= threshold)
             .groupBy(crop_col, exp_col).agg(F.min("cluster_id").alias("clusters_to_85")))
    if experiments is None:
        experiments = sorted(r[0] for r in matrix.select(exp_col).distinct().collect())
    pairs = full_grid(matrix, crop_col, experiments, exp_col)
    return pairs.join(reach, [crop_col, exp_col], "left")


def reached_only(reach: DataFrame, count_col: str = "clusters_to_85") -> DataFrame:
    """P5: pairs that never reach the threshold go, the rest is counted in int."""
    return reach.dropna(subset=[count_col]).withColumn(count_col, F.col(count_col).cast("int"))


def question_list(mapping: DataFrame, group_cols: Sequence[str] = ("Experiment", "crop")) -> DataFrame:
    """K3: every non-noise text with the re-ranked number of its cluster (W3's ranking)."""
    group_cols = list(group_cols)
    clean = mapping.where(F.col("cluster_id") != -1)
    vols = clean.groupBy(*group_cols, "cluster_id").agg(F.sum("count").cast("bigint").alias("vol"))
    ranked = prefix_rank(vols, "vol", ["cluster_id"], group_cols).select(*group_cols, "cluster_id", "rank")
    return clean.join(ranked, [*group_cols, "cluster_id"]).select(
        *group_cols, F.col("rank").alias("cluster_id"), F.col("query_text").alias("full_querytext"))
