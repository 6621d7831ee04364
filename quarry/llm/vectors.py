"""What the two vector searches share: valid vectors, query rows, blocks and the final ranking."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of one block of vectors, and queries of one block, that meet in a task.
BLOCK_ROWS, QUERY_ROWS = 8192, 4096


def finite(vectors: DataFrame) -> DataFrame:
    """(vec_id, embedding, dim) of the rows that take part: vectors null, empty, or holding null or
    non-finite components do not."""
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return (vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
            .where(F.col("embedding").isNotNull() & (F.size("embedding") > 0) & ~bad)
            .withColumn("dim", F.size("embedding")))


def is_query(every: int = 50) -> Column:
    return F.col("vec_id") % every == 0


def matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.float64)


def best(found: DataFrame, k: int) -> DataFrame:
    """The k best rows of each query: highest score, ties to the smaller vec_id.  Spark drops rows
    beyond the k-th of a query in each partition before the shuffle."""
    w = Window.partitionBy("query_id", "_copy").orderBy(F.col("score").desc(), F.col("vec_id").asc())
    return (found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
