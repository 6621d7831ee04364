"""Names within names by their rarest q-gram, against plain Python."""

import random

from pyspark.sql import functions as F

from quarry.operators import joins


def _names(seed, n):
    rng = random.Random(seed)
    found = ["".join(rng.choice("abc ñ水") for _ in range(rng.randint(0, 9))) for _ in range(n)]
    return [*found, None, "", "a", "ab", "水", "cab" * 40]


def test_pairs_equal_python(spark):
    short, long = _names(1, 150), _names(2, 150) * 2
    got = joins.containing_pairs(spark.createDataFrame([(x,) for x in short], "s string"), "s",
                                 spark.createDataFrame([(x,) for x in long], "l string"), "l").collect()
    want = {(a, b) for a in short if a for b in long if b and a in b}
    assert len(got) == len(want) and {tuple(r) for r in got} == want


def test_fallback_equals_python(spark):
    left, right = _names(3, 80), _names(4, 40)
    l_df = spark.createDataFrame(list(enumerate(left)), "id long, name string")
    r_df = spark.createDataFrame([(x, i, i * 10 + 1) for i, x in enumerate(right)], "key string, pos long, v long")
    got = {r.id: r.v for r in joins.substring_fallback(l_df, "id", "name", r_df, "key", "pos", ["v"]).collect()}

    def norm(x):
        return x.strip().lower() if x else ""

    last = {}
    for i, x in enumerate(right):
        first = last.get(norm(x), (i,))[0]
        last[norm(x)] = (first, i * 10 + 1)
    for i, x in enumerate(left):
        hits = sorted(v for k, v in last.items() if norm(x) and k and (k in norm(x) or norm(x) in k))
        assert got[i] == (hits[0][1] if hits else None), x
    assert len(got) == len(left)


def test_rows_by_length(spark):
    long = spark.createDataFrame([("".join(random.Random(5).choices("abcdefghij", k=300)),)], "l string")
    grams = long.select(F.size(F.concat(*[joins._grams(F.col("l"), q) for q in range(1, joins.Q + 1)])).alias("n")).first().n
    assert grams <= joins.Q * 300


def test_term_counts(spark):
    from quarry.operators import tfidf
    rows = [(1, ["b", "a", "b", "b"]), (2, []), (3, None), (4, [None, None]), (5, ["x"] * 1000 + ["水", None])]
    docs = spark.createDataFrame(rows, "id long, t array<string>")
    got = docs.select("id", F.array_sort(F.array_compact("t")).alias("s")).select("id", tfidf.term_counts(F.col("s")).alias("n"))
    assert {r.id: r.n and {x.term: x.tf for x in r.n} for r in got.collect()} == {
        1: {"a": 1, "b": 3}, 2: None, 3: None, 4: None, 5: {"x": 1000, "水": 1}}
    vocab, weights = tfidf.fit_tfidf(docs, "id", "t", [], None, 1.0, 1)
    # all five documents count, those without a term too
    assert {round(2.718281828459045 ** (r.idf - 1), 6) for r in vocab.collect()} == {3.0}
    assert {(r.id, r.term): r.tf for r in weights.collect()}[(5, "x")] == 1000
