"""Exact top-k inner products with a KD-tree per shard (operator 9).

Components become floor(256 * x).  Vectors are hashed into shards of about ``BLOCK_ROWS``; each
shard's tree is built in the task that searches it: median splits of the widest dimension, down to
``LEAF`` points, with tight bounding boxes.  A query visits boxes best-first by the largest inner
product that the box allows and stops when that is below its k-th score so far.

Two rounds propagate the k-th score: round 1 searches one shard per query (its home), whose k-th
score then starts the search of all shards in round 2, so that most boxes are never opened.  Boxes
that tie with the k-th score are opened, as a smaller vec_id wins a tie.

Defined results: vectors null, empty, or holding null or non-finite components take no part; a
candidate of another dimension than the query's is none; null vec_ids are candidates (last in
ties), never queries; repeated rows are candidates each, repeated query rows each get their rows;
scores beyond a long stop at its ends.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import table, written
from quarry.llm.vectors import BLOCK_ROWS, QUERY_ROWS, best, finite, is_query, matrix

SCALE = 256
LEAF = 128
_SCHEMA = "query_id long, _copy long, vec_id long, score long"
_NULL_ID = np.iinfo(np.int64).max


def quantised(column: pd.Series) -> np.ndarray:
    """floor(256 * x), as doubles that hold the integers exactly."""
    return np.floor(SCALE * matrix(column))


class Tree:
    """Boxes of all nodes as rows of ``low`` and ``high``; a leaf is a range of ``order``."""

    def __init__(self, points: np.ndarray):
        self.order = np.arange(len(points))
        self.low, self.high, self.child, self.range = [], [], [], []
        todo = [(0, len(points), None, 0)]
        while todo:
            a, b, parent, side = todo.pop()
            node, own = len(self.low), points[self.order[a:b]]
            low, high = own.min(axis=0), own.max(axis=0)
            self.low.append(low)
            self.high.append(high)
            self.child.append([-1, -1])
            self.range.append((a, b))
            if parent is not None:
                self.child[parent][side] = node
            if b - a > LEAF:
                axis, mid = int(np.argmax(high - low)), (b - a) // 2
                self.order[a:b] = self.order[a:b][np.argpartition(own[:, axis], mid)]
                todo += [(a, a + mid, node, 0), (a + mid, b, node, 1)]
        self.low, self.high = np.array(self.low), np.array(self.high)

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """Largest inner product that each box allows each query."""
        return np.maximum(queries, 0) @ self.high.T + np.minimum(queries, 0) @ self.low.T


def search(tree: Tree, points: np.ndarray, ids: np.ndarray, query: np.ndarray, own_id: int,
           bounds: np.ndarray, k: int, kth: float) -> list[tuple]:
    """Best-first traversal; (score, -id) of the best k with a score of at least kth."""
    found: list[tuple] = []
    boxes = [(-bounds[0], 0)]
    while boxes and -boxes[0][0] >= (max(kth, found[0][0]) if len(found) == k else kth):
        _, node = heapq.heappop(boxes)
        left, right = tree.child[node]
        if left >= 0:
            heapq.heappush(boxes, (-bounds[left], left))
            heapq.heappush(boxes, (-bounds[right], right))
            continue
        a, b = tree.range[node]
        scores = points[a:b] @ query
        floor = max(kth, found[0][0]) if len(found) == k else kth
        for j in np.flatnonzero(scores >= floor).tolist():
            if ids[a + j] != own_id:
                (heapq.heappush if len(found) < k else heapq.heappushpop)(found, (scores[j], -int(ids[a + j])))
    return found


def _searcher(k: int):
    def run(shard: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        if not len(shard) or not len(queries):
            return pd.DataFrame({"query_id": [], "_copy": [], "vec_id": [], "score": []}, dtype="int64")
        points, asked = quantised(shard["embedding"]), quantised(queries["embedding"])
        # products and sums below 2**53 are exact in doubles; larger ones take Python's integers
        exact = points.shape[1] * (np.abs(points).max() + 1) * (np.abs(asked).max() + 1) < 2.0**53
        tree = Tree(points)
        if not exact:
            points, asked = _integers(points), _integers(asked)
            tree.low, tree.high = _integers(tree.low), _integers(tree.high)
        points = points[tree.order]
        ids = shard["vec_id"].fillna(_NULL_ID).to_numpy(np.int64)[tree.order]
        out = []
        for low in range(0, len(asked), 256):
            bounds = tree.bounds(asked[low:low + 256])
            for j, q in enumerate(asked[low:low + 256]):
                own, copy, kth = (queries[c].iloc[low + j] for c in ("vec_id", "_copy", "kth"))
                out += [(own, copy, None if -i == _NULL_ID else -i, min(max(int(s), -2**63), 2**63 - 1))
                        for s, i in search(tree, points, ids, q, int(own), bounds[j], k,
                                           -np.inf if pd.isna(kth) else int(kth))]
        found = pd.DataFrame(out, columns=["query_id", "_copy", "vec_id", "score"])
        return found.astype({"vec_id": "Int64"})

    return run


def _integers(values: np.ndarray) -> np.ndarray:
    """Python integers: no product or sum overflows."""
    return np.array([[int(x) for x in row] for row in values], dtype=object)


def exact_topk(vectors: DataFrame, k: int = 5, every: int = 50) -> DataFrame:
    """(query_id, rank, vec_id, score): the k highest integer inner products of each query row."""
    rows = written(finite(vectors).withColumn("_copy", F.lit(0).cast("long")), "topk-vectors")
    n, n_queries = rows.agg(F.count("*"), F.count_if(is_query(every))).first()
    shards, blocks = max(1, -(-n // BLOCK_ROWS)), max(1, -(-n_queries // QUERY_ROWS))
    place = F.pmod(F.xxhash64("vec_id", "embedding"), F.lit(shards)).cast("int")
    points = rows.select("vec_id", "embedding", "dim", place.alias("shard"), F.explode(
        F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    # equal query rows (same id) are told apart, so that each gets its own k rows
    asked = rows.where(is_query(every)).select(
        "vec_id", F.monotonically_increasing_id().alias("_copy"), "embedding", "dim", place.alias("home"),
        F.pmod(F.xxhash64(F.lit(1), "vec_id"), F.lit(blocks)).cast("int").alias("block"))
    asked = written(asked, "topk-queries")
    meet = ["dim", "shard", "block"]

    def searched(queries: DataFrame) -> DataFrame:
        return points.groupBy(*meet).cogroup(queries.groupBy(*meet)).applyInPandas(_searcher(k), _SCHEMA)

    home = searched(asked.withColumn("shard", F.col("home")).withColumn("kth", F.lit(None).cast("long")))
    # a k-th score exists where the home shard had k candidates; without it a search starts open
    kth = home.groupBy("_copy").agg(F.min("score").alias("kth"), F.count("*").alias("n")).where(
        F.col("n") == k).select("_copy", "kth")
    everywhere = asked.join(kth, "_copy", "left").withColumn(
        "shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    return best(searched(everywhere), k)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_topk(table(spark, sf_dir, "embeddings"))
