"""Aggregations over the question log.

Totals used as denominators are lazy scalar subqueries over the *aggregated*
table (``DataFrame.scalar()``): no cross join, no driver round trip, and the
aggregate's exchange is reused instead of re-scanning the log.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.numeric import np_round, pct
from quarry.functions.text import py_strip


def _count() -> Column:
    return F.count(F.lit(1))


def group_sizes(df: DataFrame, keys: Sequence[str] | str, name: str = "n_queries",
                drop_null_keys: bool = True) -> DataFrame:
    """Rows per key combination.  pandas ``groupby`` drops rows with a
    null key (N2); Spark keeps a null group unless told otherwise."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    src = df.dropna(subset=keys) if drop_null_keys else df
    return src.groupBy(*keys).agg(_count().alias(name))


def collapse_duplicates(df: DataFrame, text_col: str, meta_cols: Sequence[str],
                        text_alias: str = "query_text") -> DataFrame:
    """Identical (text, metadata) rows collapse into one row with ``count``."""
    keys = [text_col, *meta_cols]
    return (group_sizes(df, keys, "count")
            .withColumnRenamed(text_col, text_alias))


def value_shares(df: DataFrame, col: str, name: str = "n_queries", digits: int | None = 2,
                 denominator: str = "non_null") -> DataFrame:
    """Value counts with their share of the total.

    ``denominator='non_null'`` (G7a) divides by the non-null rows of ``col``;
    ``'all'`` (G7b) by all rows, nulls included.  Null values get no row.
    """
    counts = df.groupBy(col).agg(_count().alias(name))
    if denominator == "all":
        total = counts.select(F.sum(name)).scalar()
    else:
        total = counts.where(F.col(col).isNotNull()).select(F.sum(name)).scalar()
    share = pct(F.col(name), total)
    return (counts.where(F.col(col).isNotNull())
            .select(col, name, (np_round(share, digits) if digits is not None else share).alias("pct")))


def top_n(df: DataFrame, order: Sequence[Column], n: int) -> DataFrame:
    """O3/G7 top-N: distributed TakeOrderedAndProject (each task keeps n rows)."""
    return df.orderBy(*order).limit(n)


def monthly_counts(df: DataFrame, date_col: str, name: str = "n_queries") -> DataFrame:
    """Calls per month (first-of-month DATE key); absent months stay absent."""
    return (df.where(F.col(date_col).isNotNull())
            .groupBy(F.to_date(F.date_trunc("month", F.col(date_col))).alias("month"))
            .agg(_count().alias(name)))


def group_summary(df: DataFrame, group_col: str, count_col: str,
                  distinct_cols: Sequence[str]) -> DataFrame:
    """Per group the non-null count of ``count_col`` and distinct counts."""
    return (df.dropna(subset=[group_col]).groupBy(group_col)
            .agg(F.count(count_col).alias("total_queries"),
                 *[F.countDistinct(c).alias(f"unique_{c.lower()}") for c in distinct_cols]))


def map_to_buckets(df: DataFrame, type_col: str, mapping: DataFrame,
                   default: str = "Unclassified") -> DataFrame:
    """J7 + G11: dimension lookup on the stripped type name; unknown or null types
    fall into ``default``.  ``mapping`` is a (type, bucket) dimension table, small
    by construction, so it is broadcast."""
    m = mapping.select(py_strip(F.col(mapping.columns[0])).alias("_t"),
                       F.col(mapping.columns[1]).alias("Bucket")).dropDuplicates(["_t"])
    out = (df.withColumn("_t", py_strip(F.col(type_col)))
           .join(F.broadcast(m), "_t", "left")
           .withColumn("Bucket", F.coalesce(F.col("Bucket"), F.lit(default))))
    return out.drop("_t")


def decode_types(df: DataFrame, type_col: str, codes: DataFrame) -> DataFrame:
    """Type codes become their names (``codes``: code, name; a short dimension), so that
    calls logged by code and by name count together; other values stay, nulls too."""
    c = codes.select(py_strip(F.col(codes.columns[0])).alias("_code"),
                     F.col(codes.columns[1]).alias("_name")).dropDuplicates(["_code"])
    return (df.withColumn("_code", py_strip(F.col(type_col))).join(F.broadcast(c), "_code", "left")
            .withColumn(type_col, F.coalesce("_name", type_col)).drop("_code", "_name"))


def bucket_totals(df: DataFrame, type_col: str, mapping: DataFrame,
                  default: str = "Unclassified") -> DataFrame:
    """Calls per bucket and share of ALL rows (null types included)."""
    counts = map_to_buckets(df, type_col, mapping, default).groupBy("Bucket").agg(_count().alias("Count"))
    total = counts.select(F.sum("Count")).scalar()
    return counts.select("Bucket", "Count", np_round(pct(F.col("Count"), total), 2).alias("Percentage"))


def shares_within(df: DataFrame, part_cols: Sequence[str], count_col: str,
                  digits: int | None = 2, name: str = "Percentage") -> DataFrame:
    """Share of ``count_col`` within its partition (one small window per part)."""
    w = Window.partitionBy(*part_cols)
    share = pct(F.col(count_col), F.sum(count_col).over(w))
    return df.withColumn(name, np_round(share, digits) if digits is not None else share)


def bucket_by_year(df: DataFrame, type_col: str, date_col: str, mapping: DataFrame,
                   default: str = "Unclassified") -> DataFrame:
    """(year, bucket) counts with the share within the year."""
    counts = (map_to_buckets(df, type_col, mapping, default)
              .groupBy(F.year(date_col).alias("year"), "Bucket").agg(_count().alias("Count")))
    return shares_within(counts, ["year"], "Count")


def year_totals(by_year: DataFrame) -> DataFrame:
    """K5 total lines: ``rollup(year)`` gives one total per year and a grand total."""
    return (by_year.rollup("year").agg(F.sum("Count").alias("total_processed"))
            .select("year", F.col("total_processed").cast("bigint").alias("total_processed")))


def pivot_shares(by_year: DataFrame, buckets: Sequence[str]) -> DataFrame:
    """Year x bucket share, columns in alphabetical order, absent cells 0.0.
    The bucket list comes from the dimension table, so the pivot needs no scan."""
    cols = sorted(buckets)
    wide = by_year.groupBy("year").pivot("Bucket", cols).agg(F.first("Percentage"))
    return wide.fillna(0.0, subset=cols).select("year", *cols)


def top_matrix(df: DataFrame, row_col: str, col_col: str, n_rows: int, n_cols: int,
               name: str = "n_queries") -> DataFrame:
    """Counts for the top-``n_rows`` x top-``n_cols`` values (both by volume,
    ties by name), zero-filled, in long form.  The two top lists are bounded by
    the parameters; the fill uses a pivot over the bounded column list."""
    def top(col, n):
        return (df.groupBy(col).agg(_count().alias("_n"))
                .orderBy(F.desc("_n"), F.asc(col)).limit(n).select(col))
    rows = top(row_col, n_rows)
    cols_df = top(col_col, n_cols)
    col_values = [r[0] for r in cols_df.collect()]  # bounded: n_cols names
    sub = df.join(F.broadcast(rows), row_col, "left_semi").where(F.col(col_col).isin(col_values))
    wide = sub.groupBy(row_col).pivot(col_col, col_values).agg(_count()).fillna(0, subset=col_values)
    wide = rows.join(wide, row_col, "left").fillna(0, subset=col_values)
    stack = F.explode(F.array(*[F.struct(F.lit(v).alias(col_col), F.col(f"`{v}`").cast("bigint").alias(name))
                                for v in col_values])).alias("_c")
    return wide.select(row_col, stack).select(row_col, f"_c.{col_col}", f"_c.{name}")


def growth(df: DataFrame, key: str, year_col: str, y1: int, y2: int) -> DataFrame:
    """Growth between two years for keys present in both (inner)."""
    yr = F.year(year_col)
    c1 = F.sum(F.when(yr == y1, 1).otherwise(0))
    c2 = F.sum(F.when(yr == y2, 1).otherwise(0))
    g = (df.where(yr.isin(y1, y2)).groupBy(key)
         .agg(c1.cast("bigint").alias(f"count_{y1}"), c2.cast("bigint").alias(f"count_{y2}")))
    g = g.where((F.col(f"count_{y1}") > 0) & (F.col(f"count_{y2}") > 0))
    return g.withColumn("growth_pct", (F.col(f"count_{y2}") - F.col(f"count_{y1}")).cast("double")
                        / F.col(f"count_{y1}").cast("double") * F.lit(100.0))


def long_tail(df: DataFrame, key: str, keep: int = 15, other: str = "All Others",
              name: str = "n_queries") -> DataFrame:
    """The top ``keep`` keys by volume, the rest summed as one row.  The top
    list is a bounded TakeOrdered result, broadcast back; no global window."""
    counts = df.groupBy(key).agg(_count().alias(name))
    top = counts.orderBy(F.desc(name), F.asc(key)).limit(keep).select(key, F.lit(True).alias("_top"))
    labelled = counts.join(F.broadcast(top), key, "left").select(
        F.when(F.col("_top"), F.col(key)).otherwise(F.lit(other)).alias(key), name)
    return labelled.groupBy(key).agg(F.sum(name).cast("bigint").alias(name))


# The dashboard's volume brackets (label, lower bound inclusive).
VOLUME_BRACKETS = (("1M+", 1_000_000), ("500k-1M", 500_000), ("100k-500k", 100_000),
                   ("50k-100k", 50_000), ("10k-50k", 10_000), ("<10k", 0))


def volume_brackets(sizes: DataFrame, size_col: str, brackets=VOLUME_BRACKETS,
                    scale: float = 1.0) -> DataFrame:
    """Number of keys per volume bracket (bounds multiplied by ``scale``)."""
    expr = None
    for label, lo in brackets:
        cond = F.col(size_col) >= F.lit(lo * scale)
        expr = F.when(cond, F.lit(label)) if expr is None else expr.when(cond, F.lit(label))
    return (sizes.select(expr.alias("bracket"))
            .groupBy("bracket").agg(_count().alias("n_crops")))


def headline(df: DataFrame, crop_col: str, type_col: str) -> DataFrame:
    """Total calls, number of crops and types, calls per type."""
    return df.agg(_count().alias("total_queries"),
                  F.countDistinct(crop_col).alias("n_crops"),
                  F.countDistinct(type_col).alias("n_query_types")).withColumn(
        "queries_per_type", np_round(F.col("total_queries") / F.col("n_query_types"), 1))


def median_size(sizes: DataFrame, size_col: str, group_cols: Sequence[str] = ()) -> DataFrame:
    """Exact interpolated median, from the middle ranks of the distributed prefix rank (a row's
    number breaks ties, so that a frequent size is split)."""
    from quarry.operators.saturation import prefix_rank
    rows = sizes.select(*group_cols, size_col, F.monotonically_increasing_id().alias("_tie")).where(F.col(size_col).isNotNull())
    k, rank = F.col("n_types"), F.col("rank")
    middle = (rank == F.floor((k + 1) / 2)) | (rank == F.floor((k + 2) / 2))
    return prefix_rank(rows, size_col, ["_tie"], group_cols).where(middle).groupBy(*group_cols).agg(
        F.avg(size_col).alias("median_size"))
