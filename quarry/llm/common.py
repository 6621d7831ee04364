"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.session import ensure_checkpoint_dir

#: White space of the word contracts: U+0020 and U+0009..U+000D.
BLANK = r"[\x20\x09-\x0D]+"


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder that ``spark.checkpoint.dir`` names."""
    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back: lineage ends there, and
    what is lost with an executor is read again instead of computed again."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def sample(rows: DataFrame, draw: str, n: int, size: int) -> DataFrame:
    """At most ``size`` of the ``n`` rows: those with the smallest values of the hash column
    ``draw``, rows of one value counting as one.  Only hashes are compared, about ``size`` of them."""
    if n <= size:
        return rows
    # some more than needed, then exactly
    share = int(1.2 * size / n * 1_000_000) + 1
    some = rows.where(F.pmod(F.col(draw), F.lit(1_000_000)) < share)
    last = some.select(draw).distinct().orderBy(draw).limit(size).agg(F.max(draw)).first()[0]
    return some.where(F.col(draw) <= F.lit(last)).dropDuplicates([draw])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(df: DataFrame) -> int:
    """The session's number of shuffle partitions."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))
