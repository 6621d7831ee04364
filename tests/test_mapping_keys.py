"""Texts of the mapping are compared by digest: they are no key of a shuffle; copies and nulls."""

import re

from pyspark.sql import functions as F

from quarry.plans import faq_queries


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_texts_are_no_key_of_a_shuffle(spark):
    plan = _plan(faq_queries.mapping(spark, "/root/testdata/sf0.001", keywords=True))
    keys = re.findall(r"Exchange hashpartitioning\(([^)]*)\)", plan)
    assert keys and not [k for k in keys if "text#" in k]


def test_copies_and_nulls(spark, monkeypatch):
    rows = [(1, "en", "src1", "red wheat"), (2, "en", "src1", "red wheat"), (3, "en", "src0", "red wheat"),
            (4, "hi", "src1", "red wheat"), (5, "en", "src2", None), (6, "en", "src2", None), (7, "en", "src2", "")]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, source string, text string")
    weights = spark.createDataFrame([("en", i, t, w) for i in (1, 2, 3) for t, w in (("red", 1.0), ("wheat", 2.0))]
                                    + [("hi", 4, "red", 1.0)], "lang string, doc_id long, term string, weight double")
    monkeypatch.setattr(faq_queries, "table", lambda *_: docs)
    monkeypatch.setattr("quarry.plans.text_queries._word_tfidf", lambda *_: (None, weights))
    got = faq_queries.mapping(None, None, keywords=True).orderBy(F.col("crop"), "cluster_id", "query_text").collect()
    assert [tuple(r) for r in got] == [
        ("en", "red wheat", -1, 1, "wheat, red"), ("en", "red wheat", 1, 2, "wheat, red"),
        ("en", None, 2, 2, ""), ("en", "", 2, 1, ""), ("hi", "red wheat", 1, 1, "red")]
