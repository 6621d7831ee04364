"""File sources of the reference re-expressed as Spark scans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str,
             multi_line: bool = False) -> DataFrame:
    """CSV with a header and an explicit schema (no inference).  ``multi_line`` lets
    quoted fields span lines, as pandas does; such files cannot be split."""
    return (spark.read.schema(schema).option("header", True).option("multiLine", multi_line)
            .option("escape", '"').option("ignoreLeadingWhiteSpace", False)
            .option("ignoreTrailingWhiteSpace", False).csv(path))


def read_group_folders(spark: SparkSession, root: str, file_name: str, schema: T.StructType | str,
                       group_col: str = "crop", multi_line: bool = False) -> DataFrame:
    """S2 + S3 + U1: one scan over ``root/<group>/<file_name>`` for every group,
    the folder name attached as ``group_col``.  Absent folders or files are simply
    not matched by the glob (the reference skipped them one by one)."""
    df = read_csv(spark, f"{root.rstrip('/')}/*/{file_name}", schema, multi_line)
    folder = F.regexp_extract(F.col("_metadata.file_path"), r"/([^/]+)/[^/]+$", 1)
    # file paths arrive URI-encoded (blanks as %20)
    return df.withColumn(group_col, F.url_decode(folder))


def read_text_lines(spark: SparkSession, path: str) -> DataFrame:
    """S4 input: one row per line (column ``value``)."""
    return spark.read.text(path)


def read_json(spark: SparkSession, path: str, schema: T.StructType | str, multiline: bool = True) -> DataFrame:
    """JSON documents with an explicit schema."""
    return spark.read.schema(schema).option("multiLine", multiline).json(path)


def read_partitioned(spark: SparkSession, path: str) -> DataFrame:
    """S6 re-aimed: the workbook's summary tab is K3's partitioned table."""
    return spark.read.parquet(path)
