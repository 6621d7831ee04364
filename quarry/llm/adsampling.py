"""Approximate nearest neighbours by adaptive dimension scan (operator 5).

Vectors are scaled to length 1 (largest cosine = smallest distance) and listed under the nearest
of the centroids, which k-means fits on a bounded, seeded sample; every row is listed.  A query
probes its ``PROBE`` share of the lists.  Inside a list, vectors are turned by one random rotation,
so that the first columns hold a fair share of any distance; they are scanned in blocks of
``COLUMNS`` columns, and after each block a hypothesis test drops the candidates whose partial
distance is too large for the query's k-th distance so far: dropped if
``partial * d / d' > kth * (1 + EPSILON / sqrt(d'))**2``.  Survivors get the exact cosine of the
original vectors in double precision.

Lists of any size are cut into hashed pieces of about ``BLOCK_ROWS`` rows, so a vector that a third
of all rows share burdens no task.  Recall against brute force is measured in the tests (>= 0.9).

Defined results: vectors null, zero, empty, or holding null or non-finite components take no part;
a candidate of another dimension than the query's is none; null vec_ids are candidates (last in
ties), never queries; repeated rows are candidates each, repeated query rows each get their rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import table, written
from quarry.llm.vectors import BLOCK_ROWS, QUERY_ROWS, best, finite, is_query, matrix

#: Rows that k-means sees at most, per centroid and in all.
SAMPLE_PER_LIST, SAMPLE = 64, 100_000
#: Lists: half the root of the rows, at most MAX_LISTS (longer lists are cut into pieces).
MAX_LISTS, ROUNDS = 2048, 6
PROBE = 0.75
COLUMNS, EPSILON, SLACK = 16, 2.1, 1e-9
#: Queries whose first partial distances are held at once.
TOGETHER = 256
SEED = 11
_SCHEMA = "query_id long, _copy long, vec_id long, score double"


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def centroids(sample: np.ndarray, n: int) -> np.ndarray:
    """k-means on unit vectors; an empty centroid keeps its place."""
    rng = np.random.default_rng(SEED)
    at = sample[rng.choice(len(sample), size=min(n, len(sample)), replace=False)]
    for _ in range(ROUNDS):
        own = np.concatenate([(part @ at.T).argmax(axis=1) for part in np.array_split(sample, -(-len(sample) // 4096))])
        sums = np.zeros_like(at)
        np.add.at(sums, own, sample)
        size = np.sqrt((sums * sums).sum(axis=1))
        at = np.where(size[:, None] > 0, sums / np.where(size > 0, size, 1)[:, None], at)
    return at


def rotation(d: int) -> np.ndarray:
    """A random orthogonal matrix."""
    q, r = np.linalg.qr(np.random.default_rng(SEED).standard_normal((d, d)))
    return q * np.sign(np.diag(r))


def scan(points: np.ndarray, queries: np.ndarray, k: int) -> Iterator[np.ndarray]:
    """Per query the places of the rotated points that the tests leave: first k by whole distances,
    then the others in column blocks against the k-th distance so far.  Of the first block, partial
    distances are one matrix product for all queries."""
    d, first = points.shape[1], min(len(points), max(64, k))
    if first == len(points):
        yield from (np.arange(first) for _ in queries)
        return
    head = min(COLUMNS, d)
    whole = _sq_distances(queries, points[:first])
    kth = np.partition(whole, k - 1, axis=1)[:, k - 1]
    begun = _sq_distances(queries[:, :head], points[first:, :head])
    stays = begun * (d / head) <= (_limit(kth, head, d) + SLACK)[:, None]
    for j, query in enumerate(queries):
        left = np.flatnonzero(stays[j])
        partial = begun[j, left]
        left += first
        for low in range(head, d, COLUMNS):
            high = min(low + COLUMNS, d)
            partial = partial + ((points[left, low:high] - query[low:high]) ** 2).sum(axis=1)
            near = partial * (d / high) <= _limit(kth[j], high, d) + SLACK
            left, partial = left[near], partial[near]
        yield np.concatenate([np.flatnonzero(whole[j] <= kth[j] + SLACK), left])


def _sq_distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1) - 2 * (a @ b.T), 0)


def _limit(kth, columns: int, d: int):
    """What a distance carried on from the first columns may be at most."""
    return kth * (1 + EPSILON / np.sqrt(columns)) ** 2 if columns < d else kth


def _searcher(k: int):
    def run(piece: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        if not len(piece) or not len(queries):
            return pd.DataFrame({"query_id": [], "_copy": [], "vec_id": [], "score": []})
        points, asked = _unit(matrix(piece["embedding"])), _unit(matrix(queries["embedding"]))
        turn = rotation(points.shape[1])
        turned, turned_asked = points @ turn, asked @ turn
        ids = piece["vec_id"].astype("Int64")
        known = ids.fillna(np.iinfo(np.int64).max).to_numpy(np.int64)
        names, at, places, scores = queries["vec_id"].to_numpy(np.int64), [], [], []
        for low in range(0, len(asked), TOGETHER):
            # one more, as the query itself may be among them
            found = scan(turned, turned_asked[low:low + TOGETHER], min(k + 1, len(points)))
            for j, left in enumerate(found, low):
                left = left[known[left] != names[j]]
                score = (points[left] * asked[j]).sum(axis=1)
                order = np.lexsort((known[left], -score))[:k]
                at.append(np.full(len(order), j))
                places.append(left[order])
                scores.append(score[order])
        own, place = np.concatenate(at), np.concatenate(places)
        return pd.DataFrame({"query_id": names[own], "_copy": queries["_copy"].to_numpy()[own],
                             "vec_id": ids.iloc[place].array, "score": np.concatenate(scores)})

    return run


def nearest(vectors: DataFrame, k: int = 5, every: int = 50, probe: float = PROBE) -> DataFrame:
    """(query_id, rank, vec_id, score): about the k largest cosines of each query row."""
    spark = vectors.sparkSession
    rows = written(finite(vectors).where(F.exists("embedding", lambda x: x != 0)), "ann-vectors")
    found = None
    # one pass for each dimension; a corpus has one, or very few
    for dim, n in sorted((r[0], r[1]) for r in rows.groupBy("dim").count().collect()):
        one = _nearest(rows.where(F.col("dim") == dim), n, k, every, probe)
        found = one if found is None else found.unionByName(one)
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    return empty if found is None else found


def _nearest(rows: DataFrame, n: int, k: int, every: int, probe: float) -> DataFrame:
    lists = int(min(MAX_LISTS, max(1, n**0.5 / 2)))
    share = min(1.0, min(SAMPLE, SAMPLE_PER_LIST * lists) / n)
    sample = rows.where(F.pmod(F.xxhash64(F.lit(SEED), "vec_id"), F.lit(1_000_000)) < int(share * 1_000_000) + 1)
    # bounded by SAMPLE; by id, so that it does not depend on partitions
    drawn = sample.orderBy("vec_id").limit(SAMPLE).select("embedding").toPandas()
    if not len(drawn):
        drawn = rows.orderBy("vec_id").limit(1).select("embedding").toPandas()
    at = centroids(_unit(matrix(drawn["embedding"])), lists)
    lists, wide = len(at), max(1, -(-int(len(at) * probe * 1000) // 1000))

    def listed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if len(frame):
                yield frame.assign(list=(_unit(matrix(frame["embedding"])) @ at.T).argmax(axis=1))

    def probed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if len(frame):
                near = np.argsort(-(_unit(matrix(frame["embedding"])) @ at.T), axis=1, kind="stable")[:, :wide]
                yield frame.assign(lists=list(near))

    points = written(rows.select("vec_id", "embedding").mapInPandas(
        listed, "vec_id long, embedding array<float>, list int"), "ann-lists")
    # one row per list, at most MAX_LISTS
    pieces = points.groupBy("list").count().select(
        "list", F.ceil(F.col("count") / BLOCK_ROWS).cast("int").alias("pieces"))
    n_queries = rows.where(is_query(every)).count()
    blocks = max(1, -(-n_queries // QUERY_ROWS))
    points = (points.join(F.broadcast(pieces), "list")
              .withColumn("piece", F.pmod(F.xxhash64("vec_id", "embedding"), F.col("pieces")).cast("int"))
              .withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))))
    asked = written(rows.where(is_query(every)).select(
        "vec_id", F.monotonically_increasing_id().alias("_copy"), "embedding"), "ann-queries")
    asked = (asked.mapInPandas(probed, "vec_id long, _copy long, embedding array<float>, lists array<int>")
             .withColumn("list", F.explode("lists")).drop("lists")
             .join(F.broadcast(pieces.select(F.col("list").alias("list"), F.col("pieces").alias("own"))), "list")
             .withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("own") - 1)))
             .withColumn("block", F.pmod(F.xxhash64(F.lit(1), "vec_id"), F.lit(blocks)).cast("int")))
    meet = ["list", "piece", "block"]
    return best(points.groupBy(*meet).cogroup(asked.groupBy(*meet)).applyInPandas(_searcher(k), _SCHEMA), k)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"))
