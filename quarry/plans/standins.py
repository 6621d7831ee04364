"""Stand-ins for the reference's inputs, derived by Spark from the driver tables.

The reference reads a call log (one row per farmer call: question text, crop,
question type, state, district, season, date).  The driver tables are TPC-H-like,
so the log is derived: one ``lineitem`` = one call.

| log column   | source                                         |
|--------------|------------------------------------------------|
| Crop         | part.p_name                                    |
| QueryType    | orders.o_orderpriority                         |
| StateName    | region.r_name (via customer, nation)           |
| DistrictName | nation.n_name                                  |
| Season       | customer.c_mktsegment                          |
| CallDate     | orders.o_orderdate                             |

Only the tables needed for the requested columns are joined (inner joins cannot
be removed by Catalyst; the driver data has full referential integrity, which the
SQL oracle — joining everything — confirms).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.sources.tables import table

LOG_COLUMNS = ("call_order", "call_line", "Crop", "QueryType", "StateName", "DistrictName",
               "Season", "CallDate")
_NEEDS = {
    "Crop": {"part"}, "QueryType": {"orders"}, "CallDate": {"orders"},
    "Season": {"orders", "customer"}, "DistrictName": {"orders", "customer", "nation"},
    "StateName": {"orders", "customer", "nation", "region"},
}


def call_log(spark: SparkSession, sf_dir: str, cols: Sequence[str] = LOG_COLUMNS) -> DataFrame:
    need = set().union(*[_NEEDS.get(c, set()) for c in cols])
    df = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("call_order"), F.col("l_linenumber").alias("call_line"),
        "l_partkey")
    if "orders" in need:
        o = table(spark, sf_dir, "orders").select(
            "o_orderkey", "o_custkey", F.col("o_orderdate").alias("CallDate"),
            F.col("o_orderpriority").alias("QueryType"))
        df = df.join(o, df.call_order == o.o_orderkey)
    if "customer" in need:
        c = table(spark, sf_dir, "customer").select(
            "c_custkey", "c_nationkey", F.col("c_mktsegment").alias("Season"))
        df = df.join(c, df.o_custkey == c.c_custkey)
    if "nation" in need:
        n = table(spark, sf_dir, "nation").select(
            "n_nationkey", "n_regionkey", F.col("n_name").alias("DistrictName"))
        df = df.join(n, df.c_nationkey == n.n_nationkey)
    if "region" in need:
        r = table(spark, sf_dir, "region").select("r_regionkey", F.col("r_name").alias("StateName"))
        df = df.join(r, df.n_regionkey == r.r_regionkey)
    if "part" in need:
        p = table(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("Crop"))
        df = df.join(p, df.l_partkey == p.p_partkey)
    return df.select(*cols)


LOG_SQL = """log AS (
  SELECT l.l_orderkey AS call_order, l.l_linenumber AS call_line, p.p_name AS Crop,
         o.o_orderpriority AS QueryType, r.r_name AS StateName, n.n_name AS DistrictName,
         c.c_mktsegment AS Season, o.o_orderdate AS CallDate
  FROM lineitem l
  JOIN orders o ON l.l_orderkey = o.o_orderkey
  JOIN customer c ON o.o_custkey = c.c_custkey
  JOIN nation n ON c.c_nationkey = n.n_nationkey
  JOIN region r ON n.n_regionkey = r.r_regionkey
  JOIN part p ON l.l_partkey = p.p_partkey)"""


def part_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Question types = parts; size = number of calls (lineitems) per part."""
    return (table(spark, sf_dir, "lineitem").groupBy("l_partkey")
            .agg(F.count(F.lit(1)).alias("size")))


PART_SIZES_SQL = "sizes AS (SELECT l_partkey, count(*) AS size FROM lineitem GROUP BY l_partkey)"


def np_round_sql(expr: str, digits: int) -> str:
    scale = f"{10 ** digits}.0"
    return f"(round_even(({expr}) * {scale}, 0) / {scale})"


def pct_sql(part: str, whole: str) -> str:
    return f"((CAST({part} AS DOUBLE) / CAST({whole} AS DOUBLE)) * 100.0)"
