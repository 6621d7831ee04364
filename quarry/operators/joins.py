"""Joins that need composition: normalised lookups, the substring
fallback join, grids.  No cross joins: the substring join is an equi-join on the
rarest q-gram of the shorter name."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.text import normalize_key

#: Characters of the grams by which names meet.
Q = 3


def normalized_lookup(left: DataFrame, left_col: str, right: DataFrame, right_col: str,
                      value_cols: Sequence[str], order_col: str | None = None,
                      default=0) -> DataFrame:
    """Left join on ``lower(strip(name))``; missing values become ``default``.
    Duplicate right keys: the last one in ``order_col`` order wins (dict overwrite)."""
    r = right.withColumn("_k", normalize_key(right_col))
    if order_col is not None:
        r = r.groupBy("_k").agg(F.max_by(F.struct(*value_cols), F.col(order_col)).alias("_v")) \
             .select("_k", *[F.col(f"_v.{c}").alias(c) for c in value_cols])
    else:
        r = r.dropDuplicates(["_k"]).select("_k", *value_cols)
    out = left.withColumn("_k", normalize_key(left_col)).join(r, "_k", "left").drop("_k")
    for c in value_cols:
        out = out.withColumn(c, F.coalesce(F.col(c), F.lit(default)))
    return out


def _grams(name: Column, q: int) -> Column:
    """All substrings of ``q`` characters."""
    n = F.length(name)
    return F.when(n >= q, F.transform(F.sequence(F.lit(1), n - (q - 1)), lambda i: F.substring(name, i, F.lit(q)))) \
        .otherwise(F.array().cast("array<string>"))


def containing_pairs(short: DataFrame, short_col: str, long: DataFrame, long_col: str) -> DataFrame:
    """``(short_col, long_col)``: the distinct non-empty names of ``short`` that stand in one of ``long``.

    A name within another has all its q-grams there, so it meets the others by its rarest one only (a
    name of fewer than ``Q`` characters by itself), and ``contains`` decides.  A long name gives at most
    ``Q`` rows a character, a short one a single key."""
    own = short.select(short_col).where(F.length(short_col) > 0).distinct()
    index = (long.select(long_col).where(F.length(long_col) > 0).distinct()
             .select(long_col, F.explode(F.array_distinct(F.concat(
                 *[_grams(F.col(long_col), q) for q in range(1, Q + 1)]))).alias("_gram")))
    often = index.groupBy("_gram").agg(F.count(F.lit(1)).alias("_n"))
    # a gram that no long name has is the rarest: its name meets nothing
    keys = (own.select(short_col, F.explode(F.when(F.length(short_col) < Q, F.array(short_col)).otherwise(
                F.array_distinct(_grams(F.col(short_col), Q)))).alias("_gram"))
            .join(often, "_gram", "left")
            .groupBy(short_col).agg(F.min(F.struct(F.coalesce("_n", F.lit(0)).alias("n"), "_gram"))["_gram"].alias("_gram")))
    return keys.join(index, "_gram").where(F.contains(F.col(long_col), F.col(short_col))).select(short_col, long_col)


def substring_fallback(left: DataFrame, id_col: str, name_col: str, right: DataFrame,
                       right_key: str, order_col: str, value_cols: Sequence[str]) -> DataFrame:
    """For each left row, the first right row (in ``order_col`` order) whose
    normalised key is contained in the left's normalised name or contains it.

    Both directions are equi-joins of distinct names on their rarest q-gram, so no nested-loop or
    cartesian join is needed at any size.  Left rows without a match (empty and null names too) get
    null values.  ``id_col`` identifies left rows.
    """
    lk = left.select(id_col, normalize_key(name_col).alias("_ln"))
    # a repeated normalised key stands at its first place with its last values
    rk = (right.select(normalize_key(right_key).alias("_rn"), order_col, F.struct(*value_cols).alias("_val"))
          .groupBy("_rn").agg(F.max_by("_val", order_col).alias("_val"), F.min(order_col).alias(order_col))
          .select("_rn", order_col, *[F.col(f"_val.{c}").alias(c) for c in value_cols]))
    pairs = containing_pairs(rk, "_rn", lk, "_ln").unionByName(containing_pairs(lk, "_ln", rk, "_rn"))
    best = (pairs.join(rk, "_rn").groupBy("_ln")
            .agg(F.min_by(F.struct(*value_cols), F.col(order_col)).alias("_v")))
    found = lk.join(best, "_ln").select(id_col, "_v")
    return left.join(found, id_col, "left").select(
        *left.columns, *[F.col(f"_v.{c}").alias(c) for c in value_cols])


def lookup_with_fallback(left: DataFrame, id_col: str, name_col: str, right: DataFrame,
                         right_key: str, order_col: str, value_cols: Sequence[str],
                         test_col: str) -> DataFrame:
    """J1 then J2 where J1 gave ``test_col == 0`` (the reference's exact rule)."""
    first = normalized_lookup(left, name_col, right, right_key, value_cols, order_col)
    hit = first.where(F.col(test_col) != 0)
    miss = first.where(F.col(test_col) == 0).drop(*value_cols)
    fb = substring_fallback(miss, id_col, name_col, right, right_key, order_col, value_cols)
    for c in value_cols:
        fb = fb.withColumn(c, F.coalesce(F.col(c), F.lit(0)))
    return hit.unionByName(fb.select(*hit.columns))


def full_grid(rows: DataFrame, row_col: str, values: Sequence[str], value_name: str) -> DataFrame:
    """Every row value paired with every value of a short, bounded list."""
    return rows.select(row_col).distinct().select(
        row_col, F.explode(F.array(*[F.lit(v) for v in values])).alias(value_name))
