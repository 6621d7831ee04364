"""Saturation (Pareto) curves: rank question types by volume, accumulate coverage.

W1/W2 + X1: a distributed prefix sum.  A window ``ORDER BY size DESC`` without a
partition key runs in ONE task; instead the rows are range-partitioned on the sort
key (hot sizes are split across partitions because the tie-break key is part of the
range key), each partition is ranked locally, and per-partition offsets (one row per
partition and group, a bounded table) are broadcast back.

J5/J6 + X2: nearest-value lookups.  ``pct_question_types = (rank / N) * 100`` is
monotone in ``rank``, so the argmin for a grid value ``g`` lies next to
``floor(g * N / 100)``; only a handful of candidate ranks per target are joined
back instead of a cross join of targets with every type.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.numeric import np_round, pct, trunc_int

# Fixed values of the reference's saturation report.
CURVE_STEP = 0.5                      # grid 0, 0.5, ..., 100 (201 points)
CURVE_POINTS = 201
METADATA_TARGETS = (10.0, 20.0, 30.0)  # coverage_at_10pct / 20pct / 30pct
TOP_N_TYPES = 100                      # top_100_coverage
COVERAGE_TARGETS = (50.0, 75.0, 80.0, 85.0, 90.0, 95.0)


def prefix_rank(df: DataFrame, size_col: str, tie_cols: Sequence[str],
                group_cols: Sequence[str] = (), num_partitions: int | None = None) -> DataFrame:
    """Rank rows by ``size desc, tie_cols asc`` (within ``group_cols``) and add the
    running sum of ``size``.

    Adds ``rank`` (1-based), ``cum_size``, ``n_types`` and ``total`` (per group).
    """
    spark = df.sparkSession
    n_parts = num_partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    group_cols, tie_cols = list(group_cols), list(tie_cols)
    order = ([F.col(g).asc() for g in group_cols] + [F.col(size_col).desc()]
             + [F.col(c).asc() for c in tie_cols])
    parts = (df.select(*group_cols, *tie_cols, size_col)
               .repartitionByRange(n_parts, *order)
               .withColumn("_pid", F.spark_partition_id())
               # reliable checkpoint: the partition ids must be the same for the
               # offset pass and the ranking pass, even after an executor loss
               .checkpoint(eager=True))
    stats = parts.groupBy(*group_cols, "_pid").agg(F.count(F.lit(1)).alias("_n"),
                                                   F.sum(size_col).alias("_s"))
    before = Window.partitionBy(*group_cols).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*group_cols)
    # at most (#partitions + #groups) rows; broadcast by hint only when ungrouped
    # (bounded by the partition count), otherwise AQE decides on the runtime size
    offsets = stats.select(*group_cols, "_pid",
                           F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_rank_off"),
                           F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_cum_off"),
                           F.sum("_n").over(whole).alias("n_types"),
                           F.sum("_s").over(whole).alias("total"))
    local = Window.partitionBy("_pid", *group_cols).orderBy(F.col(size_col).desc(), *tie_cols)
    ranked = (parts
              .withColumn("_lr", F.row_number().over(local))
              .withColumn("_lc", F.sum(size_col).over(local.rowsBetween(Window.unboundedPreceding, 0)))
              .join(offsets if group_cols else F.broadcast(offsets), [*group_cols, "_pid"]))
    return ranked.select(*group_cols, *tie_cols, size_col,
                         (F.col("_rank_off") + F.col("_lr")).cast("bigint").alias("rank"),
                         # sums keep their type: whole sizes give long, fractional ones double
                         (F.col("_cum_off") + F.col("_lc")).alias("cum_size"),
                         F.col("n_types").cast("bigint").alias("n_types"), "total")


def coverage_curve(sizes: DataFrame, size_col: str, tie_cols: Sequence[str],
                   group_cols: Sequence[str] = (), num_partitions: int | None = None) -> DataFrame:
    """Every type with ``rank``, ``pct_question_types``, ``pct_queries_covered``
    (unrounded, in the reference's operation order)."""
    ranked = prefix_rank(sizes, size_col, tie_cols, group_cols, num_partitions)
    return (ranked
            .withColumn("pct_question_types", pct("rank", "n_types"))
            .withColumn("pct_queries_covered", pct("cum_size", "total")))


def _targets_expr(targets: Sequence[float] | None):
    """Array column of targets; ``None`` is the 0..100 grid in steps of 0.5."""
    if targets is None:
        return F.transform(F.sequence(F.lit(0), F.lit(CURVE_POINTS - 1)),
                           lambda i: i.cast("double") * F.lit(CURVE_STEP))
    return F.array(*[F.lit(float(t)) for t in targets])


def nearest_on_rank(curve: DataFrame, targets: Sequence[float] | None = None,
                    group_cols: Sequence[str] = ()) -> DataFrame:
    """For each target, the row whose ``pct_question_types`` is nearest; first
    (lowest) rank on ties.  ``targets=None`` is the 0..100 grid in steps of 0.5."""
    group_cols = list(group_cols)
    groups = curve.groupBy(*group_cols).agg(F.max("n_types").alias("n_types"))
    # candidate ranks around floor(target * N / 100): monotone x => the argmin is
    # among them; floating error can move the crossing by one, hence -1..+2
    cand = (groups
            .select(*group_cols, "n_types", F.explode(_targets_expr(targets)).alias("target"))
            .select(*group_cols, "target", "n_types",
                    F.explode(F.array(*[F.lit(o) for o in (-1, 0, 1, 2)])).alias("_off"),
                    F.floor(F.col("target") * F.col("n_types") / F.lit(100.0)).alias("_base"))
            .select(*group_cols, "target",
                    F.least(F.greatest(F.col("_base") + F.col("_off"), F.lit(1)),
                            F.col("n_types")).cast("bigint").alias("rank"))
            .distinct())
    # #groups x #targets x 4 rows: hinted only when ungrouped (804 rows at most)
    hits = curve.join(cand if group_cols else F.broadcast(cand), [*group_cols, "rank"])
    best = (hits.groupBy(*group_cols, "target")
            .agg(F.min_by(F.struct("rank", "pct_question_types", "pct_queries_covered"),
                          F.struct(F.abs(F.col("pct_question_types") - F.col("target")), F.col("rank")))
                 .alias("b")))
    return best.select(*group_cols, "target", "b.rank", "b.pct_question_types", "b.pct_queries_covered")


def nearest_on_coverage(curve: DataFrame, targets: Sequence[float] = COVERAGE_TARGETS,
                        group_cols: Sequence[str] = ()) -> DataFrame:
    """For each coverage target, the row with the nearest ``pct_queries_covered``
    (strictly increasing in rank), lowest rank on ties.  One aggregation pass finds
    the two bracketing ranks per target; only those rows are joined back."""
    spark = curve.sparkSession
    group_cols = list(group_cols)
    aggs = []
    for i, t in enumerate(targets):
        aggs.append(F.max(F.when(F.col("pct_queries_covered") <= t, F.col("rank"))).alias(f"lo{i}"))
        aggs.append(F.min(F.when(F.col("pct_queries_covered") >= t, F.col("rank"))).alias(f"hi{i}"))
    bounds = curve.groupBy(*group_cols).agg(*aggs)
    cand = bounds.select(*group_cols, F.explode(F.array(*[
        F.struct(F.lit(float(t)).alias("target"), F.col(f"{side}{i}").alias("rank"))
        for i, t in enumerate(targets) for side in ("lo", "hi")])).alias("c"))
    cand = cand.select(*group_cols, "c.target", "c.rank").where(F.col("rank").isNotNull())
    hits = curve.join(cand if group_cols else F.broadcast(cand), [*group_cols, "rank"])
    best = (hits.groupBy(*group_cols, "target")
            .agg(F.min_by(F.struct("rank", "pct_question_types", "pct_queries_covered", "n_types"),
                          F.struct(F.abs(F.col("pct_queries_covered") - F.col("target")), F.col("rank")))
                 .alias("b")))
    return best.select(*group_cols, F.col("target").alias("coverage_target"), "b.rank",
                       "b.pct_question_types",
                       trunc_int(F.col("b.n_types") * F.col("b.pct_question_types") / F.lit(100.0))
                       .alias("num_types"))


def saturation_curve(curve: DataFrame, group_cols: Sequence[str] = ()) -> DataFrame:
    """The dashboard curve: 201 grid points, values rounded to 2 like the reference."""
    pts = nearest_on_rank(curve, None, group_cols)
    return pts.select(*group_cols, F.col("target").alias("grid_pct"), "rank",
                      np_round("pct_question_types", 2).alias("pct_question_types"),
                      np_round("pct_queries_covered", 2).alias("pct_queries_covered"))


def saturation_metadata(curve: DataFrame, group_cols: Sequence[str] = ()) -> DataFrame:
    """total, N, coverage nearest to 10/20/30 % of types, coverage at rank min(100, N)."""
    group_cols = list(group_cols)
    pts = nearest_on_rank(curve, METADATA_TARGETS, group_cols).select(
        *group_cols, "target", "pct_queries_covered",
        F.lit(None).cast("bigint").alias("total"), F.lit(None).cast("bigint").alias("n_types"))
    top = (curve.where(F.col("rank") == F.least(F.lit(TOP_N_TYPES).cast("bigint"), F.col("n_types")))
           .select(*group_cols, F.lit(-1.0).alias("target"), "pct_queries_covered", "total", "n_types"))
    both = pts.unionByName(top)
    cov = {t: F.max(F.when(F.col("target") == t, F.col("pct_queries_covered"))) for t in METADATA_TARGETS}
    return both.groupBy(*group_cols).agg(
        F.max("total").alias("total_queries"),
        F.max("n_types").alias("total_question_types"),
        *[np_round(cov[t], 2).alias(f"coverage_at_{int(t)}pct") for t in METADATA_TARGETS],
        np_round(F.max(F.when(F.col("target") == -1.0, F.col("pct_queries_covered"))), 2)
        .alias("top_100_coverage"))


def top_types(curve: DataFrame, n: int = 10, group_cols: Sequence[str] = ()) -> DataFrame:
    """The ``n`` largest types with their share of all queries (rank is exact,
    so this is a filter, not a sort)."""
    return curve.where(F.col("rank") <= n).select(
        *group_cols, "rank", *[c for c in curve.columns if c not in (
            *group_cols, "rank", "cum_size", "n_types", "total", "pct_question_types",
            "pct_queries_covered")],
        pct("size", "total").alias("pct_of_total"))


def first_rank_reaching(curve: DataFrame, threshold: float, share_col: str,
                        group_cols: Sequence[str]) -> DataFrame:
    """Smallest rank whose (rounded) cumulative share is >= threshold, per group;
    groups that never reach it are absent."""
    return (curve.where(F.col(share_col) >= threshold)
            .groupBy(*group_cols).agg(F.min("rank").alias("clusters_to_threshold")))
