"""Sinks (K1-K5).  Writers never collect data to the driver; the only driver-side
values are the bounded 201-point curve inside one JSON row."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions.numeric import np_round
from quarry.functions.text import file_slug, sheet_label, thousands


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """K1: CSV with a header (one file per task; no driver round trip).  Spark's
    writer strips leading/trailing blanks by default; padded names such as
    '\tPlant Protection\t' are data here, so both are kept."""
    (df.write.mode(mode).option("header", True).option("escape", '"')
       .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path))


def saturation_document(curve: DataFrame, metadata: DataFrame) -> DataFrame:
    """K2 + F25: one row ``{"metadata": {...}, "curve": [{pct_question_types,
    pct_queries_covered}, ...]}`` with the curve ordered by grid value."""
    pts = curve.agg(F.sort_array(F.collect_list(F.struct(
        "grid_pct", "pct_question_types", "pct_queries_covered"))).alias("_c"))
    pts = pts.select(F.transform("_c", lambda s: F.struct(
        s["pct_question_types"].alias("pct_question_types"),
        s["pct_queries_covered"].alias("pct_queries_covered"))).alias("curve"))
    meta = metadata.select(F.struct(*metadata.columns).alias("metadata"))
    both = meta.unionByName(pts, allowMissingColumns=True)  # two one-row frames, no join
    doc = both.agg(F.first("metadata", ignorenulls=True).alias("metadata"),
                   F.first("curve", ignorenulls=True).alias("curve"))
    return doc.select(F.to_json(F.struct("metadata", "curve")).alias("value"))


def write_saturation_json(curve: DataFrame, metadata: DataFrame, path: str) -> None:
    saturation_document(curve, metadata).coalesce(1).write.mode("overwrite").text(path)


def _spread(df: DataFrame, label: str) -> DataFrame:
    """Ranges over (label, row hash): a task writes few groups, a hot group is cut over many tasks."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartitionByRange(n, label, F.xxhash64(*df.columns)).sortWithinPartitions(label)


def write_partitioned(df: DataFrame, path: str, group_col: str = "crop", mode: str = "overwrite") -> None:
    """K3/K4: one directory per group (label = first 31 characters, '/' and '\\'
    replaced); empty groups produce no directory."""
    (_spread(df.withColumn("_label", sheet_label(group_col)), "_label")
       .write.mode(mode).partitionBy("_label").parquet(path))


def faq_files(themes: DataFrame, path: str, crop_col: str = "crop") -> None:
    """K4: per-crop FAQ tables as CSV partitions keyed by the file slug."""
    (_spread(themes.withColumn("file", file_slug(crop_col)), "file")
       .write.mode("overwrite").option("header", True).option("escape", '"')
       .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
       .partitionBy("file").csv(path))


def crop_documents(themes: DataFrame, totals: DataFrame, crop_col: str = "crop") -> DataFrame:
    """K2 + G18: one row per crop with its FAQ document ``{"name", "filename", "queries",
    "faqs": [{question, count, percentage}, ...]}``, themes in rank order.  ``totals``:
    (crop, total_queries); a crop without themes has an empty list."""
    faqs = themes.groupBy(crop_col).agg(F.transform(F.array_sort(F.collect_list(F.struct(
        "theme_rank", "question", "count", np_round("percentage", 2).alias("percentage")))),
        lambda t: F.struct(t["question"].alias("question"), t["count"].alias("count"),
                           t["percentage"].alias("percentage"))).alias("faqs"))
    kind = faqs.schema["faqs"].dataType.simpleString()
    return totals.join(faqs, crop_col, "left").select(crop_col, F.to_json(F.struct(
        F.col(crop_col).alias("name"), file_slug(crop_col).alias("filename"), F.col("total_queries").alias("queries"),
        F.coalesce("faqs", F.array().cast(kind)).alias("faqs"))).alias("value"))


def bucket_report_lines(by_year: DataFrame) -> DataFrame:
    """K5: per-year report text: a header, one line per bucket (thousands
    separators, share with two decimals) and a 'Total Processed' line.
    Ordering is carried by (year, section, -count) for the writer's sort."""
    rows = by_year.select(
        "year", F.lit(1).alias("_sec"), F.col("Count").alias("_n"),
        F.format_string("%-40s %10s %9s%%", F.col("Bucket"), thousands("Count"),
                        F.format_number("Percentage", 2)).alias("value"))
    head = by_year.select("year").distinct().select(
        "year", F.lit(0).alias("_sec"), F.lit(0).cast("bigint").alias("_n"),
        F.format_string("QUERY BUCKET DISTRIBUTION - %d", F.col("year")).alias("value"))
    tot = by_year.groupBy("year").agg(F.sum("Count").alias("_n")).select(
        "year", F.lit(2).alias("_sec"), "_n",
        F.format_string("%-40s %s", F.lit("Total Processed"), thousands("_n")).alias("value"))
    return head.unionByName(rows).unionByName(tot)


def write_report(lines: DataFrame, path: str) -> None:
    """K5 sink: the sorted report as text (range-partitioned sort, no collect)."""
    lines.orderBy("year", "_sec", F.desc("_n"), "value").select("value").write.mode("overwrite").text(path)
