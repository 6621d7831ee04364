"""The embedding against NumPy on the whole matrix; groups that one dimension mixes."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.operators import clustering as cl
from quarry.operators import spectral as sp


def _edges(n, seed=0):
    rng = np.random.default_rng(seed)
    group = np.arange(n) % 4
    w = np.where(group[:, None] == group, rng.random((n, n)) < 0.5, rng.random((n, n)) < 0.02) * rng.uniform(0.5, 1.5, (n, n))
    w = np.triu(w, 1)
    return w + w.T, [(int(i), int(j), float(w[i, j])) for i, j in zip(*np.nonzero(w), strict=True)]


def _same(labels, truth):
    return len(set(zip(labels, truth, strict=True))) == len(set(truth)) == len(set(labels))


def test_embedding_equals_numpy(spark):
    w, edges = _edges(120)
    found, values = sp.spectral_embedding(spark.createDataFrame(edges, "src long, dst long, weight double"), 4)
    d = 1 / np.sqrt(w.sum(1))
    want, vectors = np.linalg.eigh(w * d[:, None] * d)
    assert np.allclose(values, want[::-1][:4], atol=1e-3)
    u = np.array([r.vector for r in found.orderBy("id").collect()])
    v = vectors[:, ::-1][:, :4]
    assert np.allclose(u.T @ u, np.eye(4), atol=1e-6)
    assert np.linalg.norm(u @ u.T - v @ v.T) < 0.05


def test_small_graphs(spark):
    pair = spark.createDataFrame([(1, 2, 1.0)], "src long, dst long, weight double")
    found, values = sp.spectral_embedding(pair, 5)
    assert found.count() == 2 and np.allclose(values, [1.0, -1.0])
    one = spark.createDataFrame([(7, [1.0, 2.0])], "id long, features array<double>")
    assert [r.cluster_id for r in cl.spectral(one, 3).collect()] == [-1]
    assert cl.spectral(one.limit(0), 3).count() == 0


def test_limit_raises(spark, monkeypatch):
    monkeypatch.setattr(sp, "ROUNDS", 1)
    monkeypatch.setattr(sp, "TOLERANCE", 1e-12)
    _, edges = _edges(80, 1)
    with pytest.raises(RuntimeError, match="residual"):
        sp.spectral_embedding(spark.createDataFrame(edges, "src long, dst long, weight double"), 3)


def test_rings_and_groups(spark):
    rng = np.random.default_rng(3)
    t = rng.uniform(0, 2 * np.pi, 240)
    rings = np.c_[np.cos(t), np.sin(t)] * np.where(np.arange(240) < 80, 1.0, 4.0)[:, None] + rng.normal(0, 0.04, (240, 2))
    groups = rng.normal(0, 0.4, (150, 2)) + np.array([[12, 0], [15, 0], [13.5, 3]])[np.arange(150) % 3]
    truth = [0 if i < 80 else 1 for i in range(240)] + [2 + i % 3 for i in range(150)]
    rows = [(i, [float(x) for x in p]) for i, p in enumerate(np.r_[rings, groups])]
    df = spark.createDataFrame(rows, "id long, features array<double>").repartition(5)
    got = cl.spectral(df, 5, graph_k=10).orderBy("id").select("cluster_id").collect()
    assert _same([r.cluster_id for r in got], truth)


def test_vectors_have_k_places(spark):
    _, edges = _edges(60, 2)
    found, _ = sp.spectral_embedding(spark.createDataFrame(edges, "src long, dst long, weight double"), 2)
    assert found.where(F.size("vector") != 2).isEmpty()


def test_parts_equal_numpy_and_steps_are_not_written(spark, monkeypatch):
    names, put = [], sp.stored
    monkeypatch.setattr(sp, "stored", lambda df, name: (names.append(name), put(df, name))[1])
    monkeypatch.setattr(sp, "SMALL", 16, raising=False)  # 8 parts of about 15 nodes
    w, edges = _edges(120, 5)
    found, values = sp.spectral_embedding(spark.createDataFrame(edges, "src long, dst long, weight double"), 4)
    d = 1 / np.sqrt(w.sum(1))
    want, vectors = np.linalg.eigh(w * d[:, None] * d)
    assert np.allclose(values, want[::-1][:4], atol=1e-3)
    u = np.array([r.vector for r in found.orderBy("id").collect()])
    v = vectors[:, ::-1][:, :4]
    assert np.allclose(u.T @ u, np.eye(4), atol=1e-6)
    assert np.linalg.norm(u @ u.T - v @ v.T) < 0.05
    # one table a round beside the three of the graph and the result, not one a product
    assert len(names) == names.count("block") + 3


def test_a_product_sends_a_node_once_to_a_part(spark):
    n, parts, width = 200, 4, 5
    _, edges = _edges(n, 4)
    links, found = sp._normalised(spark.createDataFrame(edges, "src long, dst long, weight double"))
    graph = sp._graph(links, parts)
    sent = sp._started(graph, width, 1).collect()
    graph.unpersist()
    assert found == n and sum(len(r.prev) for r in sent if r.peer < 0) == n * width * 4
    copies = sum(len(r.cur) for r in sent if r.peer >= 0) / (width * 4)
    # the ends of the edges between parts are several times as many
    assert copies <= n * (parts - 1) < len(edges)
