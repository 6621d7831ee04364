"""Mixing sources to target weights by Sainte-Laguë apportionment (operator 8).

1. Sizes: words per document, summed per source.  Sources in code-point order (null last) weigh
   1, 2, 3, 1, 2, 3, ...; targets share the corpus total by weight, stop at ``CAP`` times the
   source's size, and the excess is shared again by weight until none is above.
2. Equal-token blocks go to sources by the highest quotients target / (2 * seats + 1).
3. A source's blocks beyond whole passes over all its documents are shared out to its shards
   (hashed, about ``SHARD_WORDS`` words each) by the same rule: integer quotas per shard.  A source of
   more than ``RANGE`` shards shares them out to ranges of shards first, then within each range.
4. In a shard, documents stand in seeded hash order, their words are cut into blocks, and blocks
   are taken in seeded hash order until the quota is full.

A document is taken ``passes`` whole times and its ``spans`` (word ranges) once more, so at most
``CAP`` times.  Nothing depends on partitioning; reruns agree.

The driver sees one row per source.  A shard is bounded by its words; documents without words
take part in no shard.

Defined results: a null text has size 0; null doc_ids are rows like others; copies of a row are
interchangeable; without words all targets are 0; clashing extra columns stay untouched unless carried.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator, Sequence
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.llm.common import table, text_or_empty, written

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (1, 2, 3)
#: Most words taken of a source, as a multiple of its size.
CAP = 3
#: A block has total / BLOCKS words, at least 1 and at most BLOCK_WORDS.
BLOCKS, BLOCK_WORDS = 100_000, 64
SHARD_WORDS = 250_000
#: Shards that are dealt with at once, and sources whose plan is broadcast at most.
RANGE, PLANNED = 4_096, 100_000
SEED = 20_240_607


def targets(sizes: Sequence[int], weights: Sequence[int]) -> list[float]:
    """Share ``sum(sizes)`` by weight, no target above CAP * size, the excess shared again."""
    capped, total = [False] * len(sizes), sum(sizes)
    while True:
        open_weight = sum(w for w, c in zip(weights, capped, strict=True) if not c)
        rest = total - sum(CAP * s for s, c in zip(sizes, capped, strict=True) if c)
        out = [float(CAP * s) if c else rest * w / open_weight
               for s, w, c in zip(sizes, weights, capped, strict=True)]
        above = [k for k, (t, s) in enumerate(zip(out, sizes, strict=True)) if not capped[k] and t > CAP * s]
        if not above:
            return out
        for k in above:
            capped[k] = True


def sainte_lague(weights: Sequence[float], seats: int) -> list[int]:
    """Seats by highest quotients weight / (2 * seats + 1), ties to the earlier party.  Starts from
    the rounded shares, which differ from the result by few seats, and moves the differing ones."""
    total = float(sum(weights))
    if total <= 0 or seats <= 0:
        return [0] * len(weights)
    won = [int(w / total * seats + 0.5) for w in weights]
    missing = seats - sum(won)
    if missing > 0:
        heap = [(-w / (2 * n + 1), k) for k, (w, n) in enumerate(zip(weights, won, strict=True)) if w > 0]
        heapq.heapify(heap)
        for _ in range(missing):
            k = heap[0][1]
            won[k] += 1
            heapq.heapreplace(heap, (-weights[k] / (2 * won[k] + 1), k))
    elif missing < 0:
        heap = [(w / (2 * n - 1), -k) for k, (w, n) in enumerate(zip(weights, won, strict=True)) if n]
        heapq.heapify(heap)
        for _ in range(-missing):
            k = -heapq.heappop(heap)[1]
            won[k] -= 1
            if won[k]:
                heapq.heappush(heap, (weights[k] / (2 * won[k] - 1), -k))
    return won


def _plan(totals: list[tuple[str, int]]) -> tuple[int, list[tuple]]:
    """Block size, and per source (key, source_size, target, passes, blocks of the last pass, shards)."""
    totals = sorted(totals, key=lambda r: r[0].encode())
    sizes = [size for _, size in totals]
    goal = targets(sizes, [WEIGHTS[k % len(WEIGHTS)] for k in range(len(sizes))]) if sizes else []
    block = min(BLOCK_WORDS, max(1, sum(sizes) // BLOCKS))
    rows = []
    for (key, size), target, seats in zip(totals, goal, sainte_lague(goal, sum(sizes) // block), strict=True):
        quota = min(seats * block, CAP * size)
        passes = quota // size if size else 0
        rows.append((key, size, target, passes, round((quota - passes * size) / block) if size else 0,
                     max(1, -(-size // SHARD_WORDS))))
    return block, rows


def _shared_out(parts: pd.DataFrame) -> pd.DataFrame:
    """Blocks, shared out to the parts of a source or range by their words."""
    parts = parts.sort_values("part")
    won = sainte_lague(parts["words"].tolist(), int(parts["blocks"].iloc[0]))
    return parts[["key", "part"]].assign(won=won)


def _quotas(some: DataFrame) -> DataFrame:
    """(key, shard, won): no group holds more than RANGE shards or the ranges of a source."""
    shards = some.groupBy("key", F.floor(F.col("shard") / RANGE).alias("range"), "shard").agg(
        F.sum("size").alias("words"), F.first("blocks").alias("blocks"))
    schema = "key string, part long, won long"
    ranges = (shards.groupBy("key", F.col("range").alias("part")).agg(F.sum("words").alias("words"), F.first("blocks").alias("blocks"))
              .groupBy("key").applyInPandas(_shared_out, schema)
              .select("key", F.col("part").alias("range"), F.col("won").alias("blocks")))
    return (shards.drop("blocks").join(ranges, ["key", "range"])
            .select("key", "range", F.col("shard").alias("part"), "words", "blocks")
            .groupBy("key", "range").applyInPandas(_shared_out, schema)
            .select("key", F.col("part").alias("shard"), "won"))


def _selector(block: int, fields: list[str]):
    def select(docs: pd.DataFrame, quota: pd.DataFrame) -> pd.DataFrame:
        docs = docs.sort_values(["_order", "_tie", "size"], kind="stable").reset_index(drop=True)
        ends = docs["size"].to_numpy(np.int64).cumsum()
        starts, total = ends - docs["size"].to_numpy(np.int64), int(ends[-1]) if len(docs) else 0
        n = -(-total // block)
        left = min(int(quota["won"].iloc[0]) * block if len(quota) else 0, total)
        name = f"{SEED}/{docs['key'].iloc[0]}/{docs['shard'].iloc[0]}/" if len(docs) else ""
        by = sorted(range(n), key=lambda b: (crc32(f"{name}{b}".encode()), b))
        taken = np.zeros(n, np.int64)
        for b in by:
            if left <= 0:
                break
            taken[b] = min(left, block, total - b * block)
            left -= int(taken[b])
        spans = []
        for start, end in zip(starts.tolist(), ends.tolist(), strict=True):
            own: list[list[int]] = []
            for b in range(start // block, -(-end // block)):
                low, high = max(start, b * block), min(end, b * block + int(taken[b]))
                if low < high:
                    if own and own[-1][1] == low - start:
                        own[-1][1] = high - start
                    else:
                        own.append([low - start, high - start])
            spans.append(own)
        docs["spans"] = spans
        docs["taken"] = docs["passes"] * docs["size"] + [sum(b - a for a, b in s) for s in spans]
        return docs[fields]

    return select


def _mixed(docs: DataFrame, carry: Sequence[str]) -> DataFrame:
    """As :func:`mix`, with the carried columns named c_0, c_1, ...: none clashes with the mix's own."""
    spark = docs.sparkSession
    key = F.when(F.col("source").isNull(), F.lit("z")).otherwise(F.concat(F.lit("a"), F.col("source")))
    sized = written(docs.select(
        *[F.col(c).alias(f"c_{k}") for k, c in enumerate(carry)], key.alias("key"),
        F.regexp_count(text_or_empty(), F.lit(WORD)).cast("long").alias("size"),
        F.xxhash64(F.col("doc_id"), text_or_empty()).alias("_tie")), "mix-sizes")
    # one row per source: sources are datasets or crawls, few against documents
    totals = [(r[0], int(r[1])) for r in sized.groupBy("key").agg(F.sum("size")).collect()]
    block, plan = _plan(totals)
    plan_df = spark.createDataFrame(plan, "key string, source_size long, target double, passes long, "
                                          "blocks long, shards long")
    # a row per source: a checked size
    joined = sized.join(F.broadcast(plan_df) if len(plan) <= PLANNED else plan_df, "key")
    some = joined.where("size > 0").withColumn("shard", F.pmod(F.col("_tie"), F.col("shards"))).withColumn(
        "_order", F.xxhash64(F.lit(SEED), F.col("_tie")))
    quotas = _quotas(some)
    flat = [f"c_{k}" for k in range(len(carry))]
    own = T.StructType.fromDDL("size long, source_size long, target double, passes long, "
                               "spans array<array<long>>, taken long")
    schema = T.StructType([sized.schema[c] for c in flat] + own.fields)
    picked = (some.select("key", "shard", "_order", "_tie", "size", "source_size", "target", "passes", *flat)
              .groupBy("key", "shard").cogroup(quotas.groupBy("key", "shard"))
              .applyInPandas(_selector(block, schema.names), schema))
    rest = joined.where("size = 0").select(
        *flat, "size", "source_size", "target", "passes",
        F.array().cast("array<array<long>>").alias("spans"), F.lit(0).cast("long").alias("taken"))
    return picked.unionByName(rest)


def mix(docs: DataFrame, carry: Sequence[str] = ("doc_id",)) -> DataFrame:
    """Per row of ``docs`` (doc_id, text, source): the ``carry`` columns, size, source_size, target,
    passes, spans and taken."""
    return _mixed(docs, carry).select(*[F.col(f"c_{k}").alias(c) for k, c in enumerate(carry)],
                                      "size", "source_size", "target", "passes", "spans", "taken")


def mixed_texts(docs: DataFrame) -> DataFrame:
    """The mix itself, with the columns of ``docs``: each document as many times as passes say, and
    once more with the words of its spans (white space between neighbouring words kept, spans on
    lines of their own)."""
    columns = docs.columns
    at, n_at = columns.index("text"), columns.index("n_chars") if "n_chars" in columns else None

    def copies(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        word = re.compile(WORD)
        for frame in frames:
            rows = []
            for row in frame.itertuples(index=False):
                values, spans = list(row[:len(columns)]), row.spans
                rows += [values] * int(row.passes)
                if len(spans):
                    words = [m.span() for m in word.finditer(values[at])]
                    values = list(values)
                    values[at] = "\n".join(row[at][words[a][0]:words[b - 1][1]] for a, b in spans)
                    if n_at is not None:
                        values[n_at] = len(values[at])
                    rows.append(values)
            yield pd.DataFrame(rows, columns=columns, dtype=object)

    return _mixed(docs, columns).where("taken > 0").mapInPandas(copies, docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")
