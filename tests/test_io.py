"""Sources and sinks: read-back equality on temporary folders."""

import json
import os

from pyspark.sql import functions as F

from quarry.plans.faq_queries import parse_run_log, run_log
from quarry.plans.registry import queries
from quarry.sources import files, sinks

SF = "/root/testdata/sf0.001"


def _rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_csv_roundtrip(spark, scratch):
    df = queries()["g1_crop_sizes"](spark, SF)
    sinks.write_csv(df, f"{scratch}/g1")
    back = files.read_csv(spark, f"{scratch}/g1", "Crop string, n_queries bigint")
    assert _rows(back) == _rows(df)


def test_group_folders_skip_missing(spark, scratch):
    summ = queries()["g15_cluster_summary"](spark, SF).select("crop", "cluster_id", "size")
    crops = sorted(r[0] for r in summ.select("crop").distinct().collect())
    for c in crops[:-1]:  # the last crop has a folder but no summary file
        sinks.write_csv(summ.where(F.col("crop") == c).drop("crop").coalesce(1), f"{scratch}/raw/{c}")
        for name in os.listdir(f"{scratch}/raw/{c}"):
            if name.endswith(".csv"):
                os.makedirs(f"{scratch}/clusters/{c} x", exist_ok=True)
                os.rename(f"{scratch}/raw/{c}/{name}", f"{scratch}/clusters/{c} x/summary.csv")
    os.makedirs(f"{scratch}/clusters/{crops[-1]} x", exist_ok=True)
    back = files.read_group_folders(spark, f"{scratch}/clusters", "summary.csv",
                                    "cluster_id int, size bigint", "crop")
    want = summ.where(F.col("crop") != crops[-1]).select(F.concat("crop", F.lit(" x")).alias("crop"),
                                                         "cluster_id", "size")
    assert _rows(back.select("crop", "cluster_id", "size")) == _rows(want)


def test_text_log_roundtrip(spark, scratch):
    lines = run_log(spark, SF)
    lines.write.mode("overwrite").text(f"{scratch}/log")
    back = parse_run_log(files.read_text_lines(spark, f"{scratch}/log"))
    assert _rows(back) == _rows(parse_run_log(lines))
    assert back.count() == lines.count()


def test_saturation_json(spark, scratch):
    doc = queries()["k2_saturation_json"](spark, SF)
    doc.coalesce(1).write.mode("overwrite").text(f"{scratch}/sat")
    txt = spark.read.text(f"{scratch}/sat").first()[0]
    obj = json.loads(txt)
    assert set(obj["metadata"]) == {"total_queries", "total_question_types", "coverage_at_10pct",
                                    "coverage_at_20pct", "coverage_at_30pct", "top_100_coverage"}
    assert len(obj["curve"]) == 201
    ys = [p["pct_queries_covered"] for p in obj["curve"]]
    assert ys == sorted(ys) and ys[-1] == 100.0
    back = files.read_json(spark, f"{scratch}/sat", "metadata struct<total_queries bigint>, "
                           "curve array<struct<pct_question_types double, pct_queries_covered double>>",
                           multiline=False)
    assert back.first()["metadata"]["total_queries"] == obj["metadata"]["total_queries"]


def test_partitioned_roundtrip(spark, scratch):
    th = queries()["g18_faq_themes"](spark, SF)
    sinks.write_partitioned(th, f"{scratch}/part", "crop")
    back = files.read_partitioned(spark, f"{scratch}/part").drop("_label")
    assert _rows(back.select(*th.columns)) == _rows(th)
    sinks.faq_files(th, f"{scratch}/faq")
    assert any(d.startswith("file=") for d in os.listdir(f"{scratch}/faq"))


def test_report_text(spark, scratch):
    from quarry.plans.log_queries import _mapping
    from quarry.operators import aggregates as agg
    from quarry.plans.standins import call_log
    by_year = agg.bucket_by_year(call_log(spark, SF, ["QueryType", "CallDate"]), "QueryType", "CallDate",
                                 _mapping(spark))
    sinks.write_report(sinks.bucket_report_lines(by_year), f"{scratch}/rep")
    text = [r[0] for r in spark.read.text(f"{scratch}/rep").collect()]
    assert sum(t.startswith("Total Processed") for t in text) == by_year.select("year").distinct().count()


def test_stream_bucket_counts(spark, scratch):
    from quarry.plans.log_queries import _mapping
    from quarry.plans.standins import call_log
    from quarry.streaming.incremental import bucket_counts_stream
    log = call_log(spark, SF, ["QueryType", "CallDate"]).withColumn("CallDate", F.col("CallDate").cast("timestamp"))
    log.write.mode("overwrite").parquet(f"{scratch}/in")
    s = bucket_counts_stream(spark, f"{scratch}/in", log.schema, _mapping(spark))
    q = s.writeStream.outputMode("complete").format("memory").queryName("bucket_stream").start()
    q.processAllAvailable()
    q.stop()
    total = spark.sql("SELECT sum(Count) FROM bucket_stream").first()[0]
    assert total == log.count()


def test_csv_dirty_values(spark, scratch):
    rows = [("what is \"best\" seed,\nfor wheat", "\tPlant Protection\t", "9999", 3),
            ("", "Weather", "Paddy (Dhan)", 1), (None, None, " Others ", 2)]
    schema = "query_text string, QueryType string, Crop string, count bigint"
    df = spark.createDataFrame(rows, schema)
    sinks.write_csv(df.coalesce(1), f"{scratch}/dirty")
    back = files.read_csv(spark, f"{scratch}/dirty", schema, multi_line=True)
    got = sorted((tuple(r) for r in back.collect()), key=repr)
    # CSV cannot tell '' from null: both come back as null, as with pandas read_csv
    want = sorted([(rows[0]), (None, "Weather", "Paddy (Dhan)", 1), rows[2]], key=repr)
    assert got == want
