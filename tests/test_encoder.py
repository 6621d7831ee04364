"""The character encoder counts as MLlib's HashingTF does; dense arrays of sparse rows."""

import numpy as np
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from quarry.operators import tfidf, vectors

TEXTS = ["wheat rust in the north", "", None, "ab", "abc", "Déjà  vu\n\n12 kg", "गेहूं की फसल", "a😀b😀c", "   ", "x" * 700]


def test_encoder_equals_hashing_tf_without_a_string_per_gram(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "id long, t string").repartition(3)
    for n in (2, 3, 5):
        out = vectors.hashed_char_embedding(df, "t", "d", 64, n)
        assert "regexp_extract_all" not in out._jdf.queryExecution().toString()
        got = {r.id: r.d for r in out.collect()}
        grams = df.withColumn("g", tfidf.char_terms(F.col("t"), (n, n)))
        tf = HashingTF(numFeatures=64, inputCol="g", outputCol="h").transform(grams)
        want = {r.id: r.d for r in tf.select("id", vectors.l2_normalize(vector_to_array("h")).alias("d")).collect()}
        assert got.keys() == want.keys() and all(np.array_equal(got[i], want[i]) for i in want)


def test_sparse_rows_become_dense_without_a_look_up_of_every_place(spark):
    rows = [(1, 4, 0.5), (1, 0, 2.0), (2, 2, 1.5), (3, 1, 1.0), (3, 2, 1.0), (3, 3, 1.0)]
    out = vectors.sparse_to_dense(spark.createDataFrame(rows, "id long, feature_index int, weight double"), ["id"], 5)
    assert "map_from_entries" not in out._jdf.queryExecution().toString()
    assert {r.id: r.sparse for r in out.collect()} == {
        1: [2.0, 0.0, 0.0, 0.0, 0.5], 2: [0.0, 0.0, 1.5, 0.0, 0.0], 3: [0.0, 1.0, 1.0, 1.0, 0.0]}
