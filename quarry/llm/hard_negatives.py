"""Hard-negative mining by a secondary-sort shuffle (operator 13).

Rows meet anchors in blocks, whose scores are one matrix product.  Pair scores are packed into byte
keys (anchor, descending score, kind, id) and sorted by ``repartitionAndSortWithinPartitions``; an
iterator walks through each anchor's pairs once, opens a window of scores for each of the first
positives and emits the negatives that fall into it.  A positive stands before the negatives of
its score, and no window reaches above its positive, so every window is open when its first
negative comes.  The iterator holds at most ``POSITIVES`` windows and no list of an anchor's pairs.

Before the shuffle, what can't come out is left out, as a combiner does: a first round keeps each
block's first positives of an anchor and, of these, the corpus's; a second round keeps each block's
first negatives of each window.  The first rows of the corpus are among the first of its blocks, so
nothing is lost, and an anchor has a bounded number of rows a block.

Scores are integer inner products of floor(256 * x).  Negatives of a positive score p lie within
30 % to 90 % of it: ``30 * p <= 100 * score <= 90 * p``.  Ties are ordered by vec_id, nulls last.

Defined results: rows with a null label or vector, or a null or non-finite component, take no
part; where vec_id is divisible by ``SHIFTED``, the label is first moved on by one (of ten); rows
with the anchor's own vec_id are no pairs of it; rows of another dimension are none either; null
vec_ids are positives and negatives, never anchors; repeated rows are rows each, repeated anchor
rows each get their result; scores beyond a long stop at its ends; extra columns are ignored; an
empty table gives an empty result.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.llm.common import partitions, table, written

SCALE, POSITIVES, NEGATIVES, EVERY, SHIFTED = 256, 5, 10, 100, 7
#: Window of a negative's score, in tenths of the positive's.
LOW, HIGH = 3, 9
#: Rows and anchors of a block, and scores held at once.
ROWS, ANCHORS, SCORES = 16_384, 4_096, 4_000_000
_LONG = 2**63
_KEY = struct.Struct(">QQB?Q")
_PAIRS = "copy long, anchor_id long, vec_id long, score long"
_OUT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def window(positive: int) -> tuple[int, int]:
    """Lowest and highest integer score of a negative (empty for negative scores)."""
    return -(-LOW * positive // 10), HIGH * positive // 10


def packed(copy: int, score: int, negative: bool, vec_id: int | None) -> bytes:
    """Sorts by anchor row, descending score, positives first, and ascending vec_id, null last."""
    return _KEY.pack(copy, _LONG - 1 - score, negative, vec_id is None, (vec_id or 0) + _LONG)


def unpacked(key: bytes) -> tuple[int, int, bool, int | None]:
    copy, score, negative, no_id, vec_id = _KEY.unpack(key)
    return copy, _LONG - 1 - score, bool(negative), None if no_id else vec_id - _LONG


def mined(pairs: Iterator[tuple[bytes, int]], n_negatives: int = NEGATIVES) -> Iterator[tuple]:
    """The result rows of sorted (key, anchor_id) pairs."""
    anchor, windows = None, []          # a window: lowest, highest, vec_id, score, negatives so far
    for key, anchor_id in pairs:
        copy, score, negative, vec_id = unpacked(key)
        if copy != anchor:
            anchor, windows = copy, []
        if not negative:
            windows.append([*window(score), vec_id, score, 0])
            continue
        for own in windows:
            if own[0] <= score <= own[1] and own[4] < n_negatives:
                own[4] += 1
                yield anchor_id, own[2], own[4], vec_id, own[3], score


def valid(vectors: DataFrame) -> DataFrame:
    """(vec_id, label, embedding, dim) of the rows that take part, with the label in force."""
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    vec_id, label = F.col("vec_id").cast("long"), F.col("label").cast("long")
    return vectors.where(F.col("embedding").isNotNull() & F.col("label").isNotNull() & ~bad).select(
        vec_id.alias("vec_id"), F.when(vec_id % SHIFTED == 0, (label + 1) % 10).otherwise(label).alias("label"),
        "embedding", F.size("embedding").alias("dim"))


def _quantised(column: pd.Series) -> np.ndarray:
    return np.floor(SCALE * np.stack(column.to_numpy()).astype(np.float64))


def _integers(values: np.ndarray) -> np.ndarray:
    return np.array([[int(x) for x in row] for row in values], dtype=object).reshape(values.shape)


def _scored(pick: Callable) -> Callable:
    """``pick(scores, rows, anchors, n)`` of each anchor of a block, as a cogroup of rows and anchors."""
    def run(rows: pd.DataFrame, anchors: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame({c: [] for c in ("copy", "anchor_id", "vec_id", "score")}, dtype="Int64")
        if not len(rows) or not len(anchors):
            return none
        # equal scores are taken in the order of vec_id, nulls last
        rows = rows.sort_values("vec_id", na_position="last", kind="stable", ignore_index=True)
        points, asked = _quantised(rows["embedding"]), _quantised(anchors["embedding"])
        # products and sums below 2**53 are exact in doubles; larger ones take Python's integers
        if points.size and points.shape[1] * (np.abs(points).max() + 1) * (np.abs(asked).max() + 1) >= 2.0**53:
            points, asked = _integers(points), _integers(asked)
        ids, labels = rows["vec_id"].astype("Int64"), rows["label"].to_numpy(np.int64)
        own_id = ids.fillna(0).to_numpy(np.int64)
        is_null = ids.isna().to_numpy()
        out, step = [], max(1, SCORES // len(points))
        for low in range(0, len(asked), step):
            block = asked[low:low + step] @ points.T
            if block.dtype == object:
                block = np.array([[max(-_LONG, min(int(s), _LONG - 1)) for s in row] for row in block], object)
            for scores, (_, anchor) in zip(block, anchors.iloc[low:low + step].iterrows(), strict=True):
                other = is_null | (own_id != anchor["vec_id"])
                taken = pick(scores, labels == anchor["label"], other, anchor)
                out.append(pd.DataFrame({"copy": anchor["copy"], "anchor_id": anchor["vec_id"], "vec_id": ids[taken].array,
                                         "score": np.array([int(s) for s in scores[taken]], np.int64)}))
        return pd.concat(out, ignore_index=True).astype({"vec_id": "Int64"})

    return run


def _first(scores: np.ndarray, among: np.ndarray, n: int) -> np.ndarray:
    """Places of the n highest scores among some places, which are in the order of vec_id."""
    if len(among) > n:
        own = scores[among]
        bar = np.sort(own)[-n] if own.dtype == object else np.partition(own, -n)[-n]
        among = among[own >= bar]
    return among[np.argsort(-scores[among], kind="stable")[:n]]


def _positives(scores, same, other, anchor) -> np.ndarray:
    return _first(scores, np.flatnonzero(same & other), POSITIVES)


def _negatives(scores, same, other, anchor) -> np.ndarray:
    free, taken = ~same & other, []
    for low, high in {window(int(p)) for p in anchor["positives"]}:
        taken.append(_first(scores, np.flatnonzero(free & (scores >= low) & (scores <= high)), NEGATIVES))
    return np.unique(np.concatenate([np.empty(0, np.int64), *taken]))


def hard_negatives(vectors: DataFrame, every: int = EVERY) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score)."""
    spark = vectors.sparkSession
    rows = written(valid(vectors), "mining-rows")
    anchor = F.col("vec_id") % every == 0
    n, n_anchors = rows.agg(F.count("*"), F.count_if(anchor)).first()
    shards, blocks = max(1, -(-n // ROWS)), max(1, -(-n_anchors // ANCHORS))
    points = rows.withColumn("shard", F.pmod(F.xxhash64("vec_id", "embedding", "label"), F.lit(shards)).cast("int")).withColumn(
        "block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    # equal anchor rows are told apart, so that each gets its own result
    anchors = written(rows.where(anchor).withColumn("copy", F.monotonically_increasing_id()).withColumn(
        "block", F.pmod(F.xxhash64("copy"), F.lit(blocks)).cast("int")), "mining-anchors")

    def scored(asked: DataFrame, pick: Callable) -> DataFrame:
        meet = ["dim", "shard", "block"]
        spread = asked.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
        return points.groupBy(*meet).cogroup(spread.groupBy(*meet)).applyInPandas(_scored(pick), _PAIRS)

    w = Window.partitionBy("copy").orderBy(F.col("score").desc(), F.col("vec_id").asc_nulls_last())
    positives = written(scored(anchors, _positives).withColumn("place", F.row_number().over(w)).where(
        F.col("place") <= POSITIVES).drop("place"), "mining-positives")
    windows = positives.groupBy("copy").agg(F.collect_list("score").alias("positives"))
    negatives = scored(anchors.join(windows, "copy"), _negatives)

    def keyed(part: Iterator) -> Iterator[tuple[bytes, int]]:
        for row in part:
            yield packed(row.copy, row.score, row.negative, row.vec_id), row.anchor_id

    pairs = negatives.withColumn("negative", F.lit(True)).unionByName(positives.withColumn("negative", F.lit(False)))
    found = pairs.rdd.mapPartitions(keyed).repartitionAndSortWithinPartitions(
        partitions(rows), lambda key: zlib.crc32(key[:8])).mapPartitions(mined)
    return spark.createDataFrame(found, _OUT)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives(table(spark, sf_dir, "embeddings"))
