"""Incremental monthly bucket counts over a stream of call-log files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators.aggregates import map_to_buckets


def bucket_counts_stream(spark: SparkSession, source_dir: str, schema, mapping: DataFrame,
                         type_col: str = "QueryType", date_col: str = "CallDate",
                         watermark: str = "31 days") -> DataFrame:
    """G8/G11b as a stream: (calendar month, bucket) counts with a watermark on the
    call date; the bucket dimension is a static broadcast join.  Run it in
    ``update`` or ``complete`` output mode."""
    stream = spark.readStream.schema(schema).parquet(source_dir)
    tagged = map_to_buckets(stream, type_col, mapping)
    return (tagged.withWatermark(date_col, watermark)
            .groupBy(F.to_date(F.date_trunc("month", F.col(date_col))).alias("month"), "Bucket")
            .agg(F.count(F.lit(1)).alias("Count")))
