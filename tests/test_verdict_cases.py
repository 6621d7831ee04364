"""Cases outside the tables' data: repeated keys, empty and tiny inputs, all-noise labels."""

import pytest

from quarry.operators import clustering, joins, neighbours


@pytest.mark.parametrize("n", [0, 1])
def test_clustering_of_no_or_one_point(spark, n):
    df = spark.createDataFrame([(k, [1.0, 2.0]) for k in range(n)], "id long, features array<double>")
    assert neighbours.knn(df, df, "id", "features", 3).count() == 0
    for out in (clustering.dbscan(df), clustering.hdbscan_levels(df)):
        assert [r.cluster_id for r in out.collect()] == [-1] * n


def test_neighbourhood_larger_than_the_input(spark):
    df = spark.createDataFrame([(k, [float(k), 0.0]) for k in range(8)], "id long, features array<double>")
    assert {r.cluster_id for r in clustering.hdbscan_levels(df, min_samples=15).collect()} == {-1}


def test_repeated_key_keeps_first_place_and_last_values(spark):
    left = spark.createDataFrame([(1, "Black Gram")], "id long, name string")
    right = spark.createDataFrame([(0, "Gram", 4, 2), (1, "GRAM ", 9, 8), (2, "Black", 5, 5)],
                                  "pos int, key string, a int, b int")
    got = joins.substring_fallback(left, "id", "name", right, "key", "pos", ["a", "b"]).first()
    assert (got.a, got.b) == (9, 8)


def test_fractional_sizes_are_not_cut(spark):
    from quarry.operators.saturation import prefix_rank
    sizes = spark.createDataFrame([("a", 2.6), ("b", 1.7)], "k string, size double")
    rows = {r["k"]: r for r in prefix_rank(sizes, "size", ["k"]).collect()}
    assert abs(rows["b"]["cum_size"] - 4.3) < 1e-9 and abs(rows["a"]["total"] - 4.3) < 1e-9


def test_question_lists_faq_documents_and_reached(spark):
    import json
    from quarry.operators import faq
    from quarry.sources.sinks import crop_documents
    m = spark.createDataFrame([("e", "c (1)", "x", 7, 2), ("e", "c (1)", "y", 3, 5), ("e", "c (1)", "z", -1, 9),
                               ("e", "d", "w", -1, 1)],
                              "Experiment string, crop string, query_text string, cluster_id int, count int")
    lists = {(r["crop"], r["full_querytext"], r["cluster_id"]) for r in faq.question_list(m).collect()}
    assert lists == {("c (1)", "y", 1), ("c (1)", "x", 2)}  # noise has no place in the lists
    totals = faq.crop_report(m).select("crop", "total_queries")
    themes = faq.faq_themes(faq.cluster_summary(m, with_keywords=False), k=1,
                            crop_totals=totals.withColumnRenamed("total_queries", "crop_total"))
    found = {r["crop"]: json.loads(r["value"]) for r in crop_documents(themes, totals).collect()}
    assert found["c (1)"] == {"name": "c (1)", "filename": "c_1", "queries": 16,
                              "faqs": [{"question": "y", "count": 5, "percentage": 31.25}]}
    assert found["d"]["faqs"] == []
    reach = spark.createDataFrame([("c", 3), ("d", None)], "crop string, clusters_to_85 bigint")
    assert [tuple(r) for r in faq.reached_only(reach).collect()] == [("c", 3)]


def test_codes_become_names(spark):
    from quarry.operators.aggregates import decode_types
    rows = spark.createDataFrame([("1",), (" 1 ",), ("One",), ("9",), (None,)], "t string")
    codes = spark.createDataFrame([("1", "One"), ("1", "One")], "code string, name string")
    assert sorted(str(r["t"]) for r in decode_types(rows, "t", codes).collect()) == ["9", "None", "One", "One", "One"]


def test_top_terms_keep_documents_without_terms(spark):
    from quarry.operators.tfidf import top_terms
    w = spark.createDataFrame([(1, "a", 0.5), (1, "b", 0.9)], "id int, term string, weight double")
    docs = spark.createDataFrame([(1,), (2,)], "id int")
    assert {r["id"]: r["keywords"] for r in top_terms(w, ["id"], 5, docs).collect()} == {1: ["b", "a"], 2: []}


def test_hot_group_is_written_by_many_tasks(spark, scratch):
    from pathlib import Path
    from quarry.sources.sinks import write_partitioned
    df = spark.range(4000).selectExpr("id", "if(id % 100 = 0, concat('g', id % 3), 'hot') AS crop")
    write_partitioned(df, f"{scratch}/hot", "crop")
    assert len(list(Path(f"{scratch}/hot/_label=hot").glob("*.parquet"))) > 3
    assert spark.read.parquet(f"{scratch}/hot").count() == 4000
