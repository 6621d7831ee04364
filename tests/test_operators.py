"""Mini-fixture tests: null/rounding traps (N1-N10), identities, guards, brute force."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.functions import text as tx
from quarry.functions.numeric import np_round
from quarry.operators import aggregates as agg
from quarry.operators import clustering as cl
from quarry.operators import filters as flt
from quarry.operators import saturation as sat
from quarry.operators import scores
from quarry.operators.components import connected_components
from quarry.operators.joins import lookup_with_fallback
from quarry.operators.neighbours import eps_pairs, knn

LOG_SCHEMA = "QueryText string, Crop string, QueryType string, StateName string, Season string, CallDate date"


@pytest.fixture(scope="module")
def log(spark):
    import datetime as dt
    d = dt.date
    rows = [
        ("dhan ki jankari", "Paddy Dhan", None, "UP", "Kharif", d(2020, 1, 5)),
        ("Déjà-vu 12 kg/ha", "Paddy (Dhan)", "3", "UP", None, d(2020, 1, 9)),
        ("", "9999", "\tPlant Protection\t", "MP", "Rabi", d(2020, 3, 1)),
        (None, " Others ", "Weather", "MP", "Rabi", d(2021, 3, 1)),
        ("weed control wheat", "other", "Weather", "MP", "Rabi", d(2021, 3, 2)),
        ("weed control wheat", "Wheat", "Plant Protection", "MP", "Rabi", d(2021, 3, 2)),
        ("weed control wheat", "Wheat", "Plant Protection", "MP", "Rabi", d(2021, 3, 2)),
    ]
    return spark.createDataFrame(rows, LOG_SCHEMA)


def test_n1_not_in_keeps_null(log):
    kept = flt.exclude_values(log, "QueryType", ["Weather"])
    assert kept.where(F.col("QueryType").isNull()).count() == 1
    assert kept.count() == 5


def test_n2_groupby_drops_null_keys(log):
    g = agg.collapse_duplicates(log, "QueryText", ["StateName", "Season", "QueryType"])
    assert g.where(F.col("query_text") == "weed control wheat").select(F.sum("count")).first()[0] == 3
    assert g.where(F.col("Season").isNull() | F.col("QueryType").isNull()).count() == 0


def test_g7a_g7b_denominators(log):
    a = {r[0]: r[2] for r in agg.value_shares(log, "QueryType").collect()}
    b = {r[0]: r[2] for r in agg.value_shares(log, "QueryType", denominator="all").collect()}
    assert a["Weather"] == np.round(2 / 6 * 100, 2) and b["Weather"] == np.round(2 / 7 * 100, 2)


def test_n4_n8_f11_cleaning(spark):
    df = spark.createDataFrame([("Déjà-vu 12 kg/ha",), ("dhan ki jankari",), ("",), (None,),
                                ("Weed CONTROL\tin  the field!",)], "t string")
    out = [r[0] for r in df.select(tx.clean_text("t")).collect()]
    assert out == ["d j vu kg", "", "", "", "weed"]
    wc = [r[0] for r in df.select(tx.word_count(tx.clean_text("t"))).collect()]
    assert wc == [4, 0, 0, 0, 1]


def test_n10_python_strip(spark):
    df = spark.createDataFrame([("\tPlant Protection\t",), (" Others \n",)], "t string")
    assert [r[0] for r in df.select(tx.py_strip("t")).collect()] == ["Plant Protection", "Others"]
    assert [r[0] for r in df.select(tx.normalize_key("t")).collect()] == ["plant protection", "others"]


def test_n5_numpy_rounding(spark):
    vals = [0.125, 2.675, 12.355, 84.995, 1.005, 17.226645226681498]
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    got = [r[0] for r in df.select(np_round("x", 2)).collect()]
    assert got == [float(np.round(v, 2)) for v in vals]


def test_f3_normalised_exclusion(log):
    kept = flt.exclude_normalized(log, "Crop", ["others", "other"])
    assert sorted(r[0] for r in kept.select("Crop").distinct().collect()) == \
        ["9999", "Paddy (Dhan)", "Paddy Dhan", "Wheat"]


def test_f7_numeric_codes(log):
    assert [r[0] for r in log.where(flt.is_numeric_code("Crop")).select("Crop").collect()] == ["9999"]


def test_f14_f17_labels(spark):
    df = spark.createDataFrame([("Green Gram (Moong Bean/ Moong)", 1234567), ("Wheat", 45300), ("Rice", 999)],
                               "c string, n bigint")
    r = df.select(tx.file_slug("c"), tx.compact_number("n"), tx.thousands("n"),
                  tx.truncate_label("c", 20), tx.sheet_label("c")).collect()
    assert r[0][0] == "Green_Gram_Moong_Bean__Moong"
    assert [x[1] for x in r] == ["1.2M", "45.3k", "999"]
    assert r[0][2] == "1,234,567"
    assert r[0][3] == "Green Gram (Moong Be..." and r[1][3] == "Wheat"
    assert r[0][4] == "Green Gram (Moong Bean_ Moong)"[:31]


def test_g8_absent_months_not_filled(log):
    months = [r[0].month for r in agg.monthly_counts(log, "CallDate").orderBy("month").collect()]
    assert months == [1, 3, 3]


def test_g12_pivot_fills_zero(spark, log):
    m = spark.createDataFrame([("Plant Protection", "Protection"), ("Weather", "Weather")], "t string, b string")
    by_year = agg.bucket_by_year(log, "QueryType", "CallDate", m)
    piv = {r["year"]: r.asDict() for r in agg.pivot_shares(by_year, ["Protection", "Unclassified", "Weather"]).collect()}
    assert piv[2020]["Weather"] == 0.0 and piv[2020]["Unclassified"] == np.round(2 / 3 * 100, 2)
    # identity: each year's buckets sum to that year's rows
    tot = {r[0]: r[1] for r in agg.year_totals(by_year).collect()}
    assert tot[None] == 7 and tot[2020] == 3


def test_g14_growth_inner(spark, log):
    g = agg.growth(log, "Crop", "CallDate", 2020, 2021).collect()
    assert g == []  # no crop appears in both years


def _sizes(spark, sizes):
    return spark.createDataFrame([(i, s) for i, s in enumerate(sizes)], "k long, size long")


def test_prefix_rank_matches_pandas_and_partitioning(spark):
    rng = np.random.default_rng(7)
    sizes = [int(v) for v in np.minimum(rng.zipf(1.6, 3000), 500)]
    df = _sizes(spark, sizes)
    a = sat.coverage_curve(df, "size", ["k"], num_partitions=7).orderBy("rank").collect()
    b = sat.coverage_curve(df, "size", ["k"], num_partitions=1).orderBy("rank").collect()
    assert [tuple(r) for r in a] == [tuple(r) for r in b]  # N: independent of partition count
    order = sorted(range(len(sizes)), key=lambda i: (-sizes[i], i))
    cum = np.cumsum([sizes[i] for i in order])
    assert [r["k"] for r in a] == order
    assert [r["pct_queries_covered"] for r in a] == list((cum / cum[-1]) * 100)


def test_nearest_lookups_match_argmin(spark):
    sizes = [50, 50, 20, 10, 10, 10, 5, 3, 1, 1, 1]
    curve = sat.coverage_curve(_sizes(spark, sizes), "size", ["k"])
    x = (np.arange(1, len(sizes) + 1) / len(sizes)) * 100
    cum = np.cumsum(sizes)
    y = cum / cum[-1] * 100
    got = {r["grid_pct"]: r["rank"] for r in sat.saturation_curve(curve).collect()}
    for g in np.arange(0, 100.5, 0.5):
        assert got[float(g)] == int(np.argmin(np.abs(x - g))) + 1
    cov = {r["coverage_target"]: r for r in sat.nearest_on_coverage(curve).collect()}
    for t in (50, 75, 80, 85, 90, 95):
        i = int(np.argmin(np.abs(y - t)))
        assert cov[float(t)]["rank"] == i + 1
        assert cov[float(t)]["num_types"] == int(len(sizes) * x[i] / 100)
    meta = sat.saturation_metadata(curve).first()
    assert meta["top_100_coverage"] == 100.0 and meta["total_queries"] == sum(sizes)


def test_j1_j2_lookup(spark):
    summary = spark.createDataFrame([("Melon", 10, 5), ("Mango", 0, 0), ("Green Gram", 7, 3), ("Gram", 4, 2)],
                                    "crop string, total bigint, uniq bigint").withColumn("_o", F.col("crop"))
    logs = spark.createDataFrame([(1, " MELON "), (2, "Mango"), (3, "Black Gram"), (4, "Pig")],
                                 "id int, name string")
    out = {r["id"]: (r["total"], r["uniq"]) for r in
           lookup_with_fallback(logs, "id", "name", summary, "crop", "_o", ["total", "uniq"], "total").collect()}
    assert out[1] == (10, 5)      # J1 normalised hit
    assert out[2] == (0, 0)       # J1 hit with 0 -> J2 finds only itself (0)
    assert out[3] == (4, 2)       # 'gram' inside 'black gram'; first in table order = 'Gram'
    assert out[4] == (0, 0)       # no match


def test_components_bruteforce(spark):
    edges = [(1, 2), (2, 3), (5, 4), (7, 7), (8, 9), (9, 10), (10, 8)]
    nodes = spark.createDataFrame([(i,) for i in range(1, 12)], "id long")
    e = spark.createDataFrame(edges, "src long, dst long")
    got = {r[0]: r[1] for r in connected_components(nodes, e, "id").collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 6: 6, 7: 7, 8: 8, 9: 8, 10: 8, 11: 11}


@pytest.fixture(scope="module")
def blobs(spark):
    rng = np.random.default_rng(3)
    centers = rng.normal(0, 5, (4, 6))
    X = np.vstack([c + rng.normal(0, 0.4, (40, 6)) for c in centers] + [rng.normal(0, 8, (10, 6))])
    rows = [(int(i), [float(v) for v in x]) for i, x in enumerate(X)]
    return X, spark.createDataFrame(rows, "id long, features array<double>")


def test_eps_pairs_and_knn_exact(blobs):
    X, df = blobs
    D = np.sqrt(((X[:, None] - X[None]) ** 2).sum(-1))
    eps = 1.0
    want = {(i, j) for i in range(len(X)) for j in range(len(X)) if i != j and D[i, j] <= eps}
    got = {(r[0], r[1]) for r in eps_pairs(df, df, "id", "features", eps).collect()}
    assert got == want
    nn = knn(df, df, "id", "features", 5).collect()
    for r in nn:
        order = sorted((D[r["src"], j], j) for j in range(len(X)) if j != r["src"])
        assert order[r["rank"] - 1][1] == r["dst"]
    assert len(nn) == 5 * len(X)


def test_dbscan_bruteforce(blobs):
    X, df = blobs
    eps, ms = 1.0, 5
    D = np.sqrt(((X[:, None] - X[None]) ** 2).sum(-1))
    core = (D <= eps).sum(1) >= ms
    got = {r["id"]: r["cluster_id"] for r in cl.dbscan(df, eps, ms, "id").collect()}
    for i in range(len(X)):
        if core[i]:
            assert got[i] >= 0
        elif not ((D[i] <= eps) & core).any():
            assert got[i] == -1
    # core points in the same cluster are connected through core points
    labels = {got[i] for i in range(len(X)) if core[i]}
    assert len(labels) >= 4


def test_agglomerative_and_kmeans(blobs):
    X, df = blobs
    for out in (cl.agglomerative(df, 4), cl.kmeans(df, 4)):
        labs = {r["id"]: r["cluster_id"] for r in out.collect()}
        assert set(labs.values()) <= set(range(4)) and len(labs) == len(X)
        for b in range(4):  # each blob is mostly one cluster
            vals = [labs[i] for i in range(b * 40, b * 40 + 40)]
            assert max(vals.count(v) for v in set(vals)) >= 36


def test_c9_strictly_more_than_50(spark):
    df = spark.createDataFrame([(1, 0, 10), (2, -1, 50), (3, -1, 51), (4, -1, 60), (5, 1, 3)],
                               "id long, cluster_id int, count long")
    got = {r["id"]: r["cluster_id"] for r in cl.promote_heavy_noise(df, "id").collect()}
    assert got == {1: 0, 2: -1, 3: 2, 4: 3, 5: 1}


def test_scores_against_sklearn_formulas(blobs, spark):
    X, df = blobs
    lab = np.array([i // 40 if i < 160 else -1 for i in range(len(X))])
    pts = df.withColumn("label", F.when(F.col("id") < 160, (F.col("id") / 40).cast("int")).otherwise(-1)) \
        .withColumn("count", F.lit(1))
    card = scores.evaluate(pts, "id").first()
    v = lab != -1
    Xv, lv = X[v], lab[v]
    D = np.sqrt(((Xv[:, None] - Xv[None]) ** 2).sum(-1))
    s = []
    for i in range(len(Xv)):
        own = lv == lv[i]
        a = D[i, own].sum() / (own.sum() - 1)
        b = min(D[i, lv == k].mean() for k in set(lv) if k != lv[i])
        s.append((b - a) / max(a, b))
    assert card["silhouette"] == float(np.round(np.mean(s), 4))
    C = np.array([Xv[lv == k].mean(0) for k in range(4)])
    intra = np.array([np.linalg.norm(Xv[lv == k] - C[k], axis=1).mean() for k in range(4)])
    cd = np.sqrt(((C[:, None] - C[None]) ** 2).sum(-1))
    cd[cd == 0] = np.inf
    db = np.mean(np.max((intra[:, None] + intra) / cd, axis=1))
    assert card["davies_bouldin"] == float(np.round(db, 4))
    extra = sum(40 * ((C[k] - Xv.mean(0)) ** 2).sum() for k in range(4))
    within = sum(((Xv[lv == k] - C[k]) ** 2).sum() for k in range(4))
    assert math.isclose(card["calinski_harabasz"], float(np.round(extra * (160 - 4) / (within * 3), 2)),
                        rel_tol=1e-9)
    assert card["noise_ratio_pct"] == float(np.round(10 / 170 * 100, 2))
    assert card["total_clusters"] == 4 and card["top_10_pct_coverage"] == 25.0


def test_e8_guards(spark):
    one = spark.createDataFrame([(1, 0, [0.0, 1.0], 1), (2, 0, [1.0, 0.0], 1), (3, -1, [5.0, 5.0], 1)],
                                "id long, label int, features array<double>, count long")
    card = scores.evaluate(one, "id").first()
    assert card["silhouette"] == -1.0 and math.isinf(card["davies_bouldin"]) and card["calinski_harabasz"] == 0.0
    noise = spark.createDataFrame([(1, -1, [0.0], 2)], "id long, label int, features array<double>, count long")
    c2 = scores.evaluate(noise, "id").first()
    assert c2["total_clusters"] == 0 and c2["noise_ratio_pct"] == 100.0 and c2["top_10_pct_coverage"] == 0.0


def test_hybrid_knn_bruteforce(spark):
    from quarry.operators.neighbours import hybrid_knn
    rng = np.random.default_rng(11)
    X = rng.normal(0, 1, (60, 8))
    X[5] = 0.0  # a zero vector: cosine distance 1 to everything
    vocab = ["a", "b", "c", "d", "e", "f"]
    T = [sorted(set(rng.choice(vocab, size=int(rng.integers(0, 4))))) for _ in range(60)]
    rows = [(i, [float(v) for v in X[i]], T[i]) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, v array<double>, t array<string>")
    got = {(r["src"], r["rank"]): r["dst"] for r in hybrid_knn(df, "id", "v", "t", 4, 0.7).collect()}

    def h(i, j):
        ni, nj = np.linalg.norm(X[i]), np.linalg.norm(X[j])
        cd = 1.0 if ni * nj == 0 else 1.0 - X[i] @ X[j] / (ni * nj)
        u = set(T[i]) | set(T[j])
        jd = 0.0 if not u else 1.0 - len(set(T[i]) & set(T[j])) / len(u)
        return 0.7 * cd + 0.3 * jd
    for i in range(60):
        order = sorted((h(i, j), j) for j in range(60) if j != i)
        for r in range(4):
            assert got[(i, r + 1)] == order[r][1]
