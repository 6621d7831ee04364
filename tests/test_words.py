"""Words counted in Arrow batches against Spark's own expressions."""

from pyspark.sql import functions as F

from quarry.functions.text import STOP_WORDS, clean_tokens
from quarry.operators import tfidf, words
from quarry.plans import text_queries

TEXTS = [None, "", "the of", "x y", "x yy the YY", "ab", "cd", "ab́cd İstanbul Kelvin ſo Straße 한국word\U0001f600end",
         "a" * 50 + "1" + "b", "  Wheat\tPRICE\nwheat ", "ΣΣ cafés", "wheat-crop don't", "zz" * 4000 + " zz", "0", "last"]


def _docs(spark):
    rows = [(i, f"g{i % 2}", t) for i, t in enumerate(TEXTS * 3)]
    return spark.createDataFrame(rows, "id long, lang string, text string").repartition(3)


def test_words_equal_spark(spark, monkeypatch):
    for size in (1, 40, 4_000_000):
        monkeypatch.setattr(words, "BYTES", size)
        docs = _docs(spark).coalesce(1)
        tokens = docs.select("id", "lang", clean_tokens("text").alias("t")).where(F.size("t") > 0)
        want = {(r.id, r.lang): r.t for r in tokens.collect()}
        for least in (1, 2):
            found = words.word_counts(docs, "text", STOP_WORDS, least).collect()
            got = [(r.id, r.lang, r.term, r.tf) for r in found]
            expected = [(*k, w, t.count(w)) for k, t in want.items() for w in set(t) if len(w) >= least]
            expected += [(*k, None, None) for k, t in want.items() if all(len(w) < least for w in t)]
            assert sorted(got, key=str) == sorted(expected, key=str)
            assert sorted((r.id, r.lang) for r in found if r.place == 0) == sorted(want)


def test_no_rows(spark):
    none = spark.createDataFrame([], "id long, text string")
    assert words.word_counts(none, "text", STOP_WORDS).isEmpty()


def test_words_of_the_fit_are_counted_in_batches(spark, monkeypatch):
    plans, put = [], tfidf.stored
    monkeypatch.setattr(tfidf, "stored", lambda df, name: (
        plans.append(df._jdf.queryExecution().executedPlan().toString()), put(df, name))[1])
    text_queries.m1_tfidf_weights(spark, "/root/testdata/sf0.001")
    assert len(plans) == 1 and "MapInArrow" in plans[0] and "regexp_extract_all" not in plans[0]
