"""SimHash near-dedup by meet-in-the-middle ball hashing (operator 6).

1. Fingerprint: XXH64 (seed 42) of every 3-word shingle, a bit is 1 if set in over half of them.
2. Equal fingerprints are one node; only distinct fingerprints go on.
3. Two fingerprints at distance ``RADIUS`` = 3 have a common variant half the way: for half of 3,
   each emits all variants within one flipped bit (one and one make two) with one of ``ERASED``
   equal bit blocks erased (the third).  If 3 bits differ, erasing the block of one of them leaves
   at most two, and these meet.  That is 4 * (1 + 48) = 196 variants, where whole balls of radius 2
   would be 2,081.
4. Variants are shuffled and sorted; fingerprints that collide are verified by their bit distance.
   A collision group yields links that connect it as all its true pairs would, not all pairs.
5. Connected components by label exchange with pointer jumping until nothing changes.

Nothing about all fingerprints, links or components reaches the driver.

Defined results: a null or blank text has fingerprint 0 and is linked like any other; under three
words the whole sequence is the shingle; repeated rows and ids are rows each (one component_id);
null doc_ids keep their row, and a component of such rows alone has a null component_id; extra
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import partitions, table, text_or_empty, written

SHINGLE, RADIUS, SEED = 3, 3, 42
#: Blocks of which one is erased in a variant.
ERASED = 4
#: Shingles hashed before their bits are added up, and fingerprints verified at once.
CHUNK, VERIFY = 1 << 16, 512


def fingerprint(text: str) -> int:
    """64-bit SimHash of a whole text, as a signed 64-bit integer."""
    from xxhash import xxh64_intdigest

    words = text.encode().lower().split()  # bytes: only A-Z change, only ASCII white space splits
    n = max(1, len(words) - SHINGLE + 1) if words else 0
    counts = np.zeros(64, np.int64)
    for low in range(0, n, CHUNK):
        part = words[low:low + CHUNK + SHINGLE - 1]
        shingles = map(b" ".join, zip(*(part[k:] for k in range(SHINGLE)), strict=False)) \
            if len(words) >= SHINGLE else [b" ".join(words)]
        hashes = np.array([xxh64_intdigest(s, SEED) for s in shingles], "<u8")
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    value = sum(1 << b for b in np.flatnonzero(2 * counts > n).tolist())
    return value - (1 << 64) if value >> 63 else value


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, copy, fp) of every row; copy is a hash of the text, equal for exact copies."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [fingerprint(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(fps, pa.int64())],
                                             names=["doc_id", "copy", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"),
                       F.xxhash64(text_or_empty()).alias("copy")).mapInArrow(run, "doc_id long, copy long, fp long")


def _variants() -> tuple[np.ndarray, np.ndarray]:
    """(keep, flip): a fingerprint's variants are ``fp & keep ^ flip``; the block's number, which
    tells the blocks' variants apart, is added to the shuffle key."""
    size, keep, flip = 64 // ERASED, [], []
    for block in range(ERASED):
        mask = ((1 << 64) - 1) ^ (((1 << size) - 1) << (block * size))
        for bit in [None, *range(64)]:
            if bit is None or mask >> bit & 1:
                keep.append(mask)
                flip.append(0 if bit is None else 1 << bit)
    return np.array(keep, np.uint64), np.array(flip, np.uint64)


def emitted(fps: DataFrame) -> DataFrame:
    """(key, fp) for every variant of every fingerprint; the erased bits hold the block's number."""
    size = 64 // ERASED

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep, flip = _variants()
        block = np.repeat(np.arange(ERASED, dtype=np.uint64), len(keep) // ERASED)
        tag = block << (block * np.uint64(size))
        for batch in batches:
            own = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for part in np.array_split(own, -(-len(own) // 2048)) if len(own) else []:
                keys = ((part[:, None] & keep) ^ flip) | tag
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys.ravel().view(np.int64)), pa.array(np.repeat(part, len(keep)).view(np.int64)),
                     pa.array(np.tile(block, len(part)).astype(np.int8))], names=["key", "fp", "block"])

    return fps.mapInArrow(run, "key long, fp long, block byte")


def linked(group: np.ndarray) -> list[tuple[int, int]]:
    """Links that connect the fingerprints of a collision group as all pairs within RADIUS would:
    a search from each fingerprint not reached yet, which verifies blocks of unreached ones."""
    left, links = group, []
    while len(left) > 1:
        frontier, left = left[:1], left[1:]
        while len(frontier) and len(left):
            near = np.full(len(left), -1)
            for low in range(0, len(frontier), VERIFY):
                distance = np.bitwise_count(frontier[low:low + VERIFY, None] ^ left[None, :])
                hit = (distance <= RADIUS) & (near < 0)
                found = hit.any(axis=0)
                near[found] = low + hit[:, found].argmax(axis=0)
            reached = near >= 0
            links += zip(frontier[near[reached]].tolist(), left[reached].tolist(), strict=True)
            frontier, left = left[reached], left[~reached]
    return links


def links(variants: DataFrame) -> DataFrame:
    """Verified links (a, b) of fingerprints that share a variant."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last_key = np.empty((0, 2), np.int64)
        last_fp = np.empty(0, np.int64)
        for batch in batches:
            keys = np.column_stack([batch.column(2).to_numpy(zero_copy_only=False).astype(np.int64),
                                    batch.column(0).to_numpy(zero_copy_only=False)])
            keys = np.concatenate([last_key, keys])
            fps = np.concatenate([last_fp, batch.column(1).to_numpy(zero_copy_only=False)])
            starts = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]).any(axis=1)]) if len(keys) else np.empty(0, int)
            if len(starts) == 0:
                continue
            yield _verified(fps[:starts[-1]], starts)
            last_key, last_fp = keys[starts[-1]:], fps[starts[-1]:]
        if len(last_fp):
            yield _verified(last_fp, np.array([0, len(last_fp)]))

    n = partitions(variants)
    return (variants.repartition(n, "block", "key").sortWithinPartitions("block", "key", "fp")
            .mapInArrow(run, "a long, b long").distinct())


def _verified(fps: np.ndarray, starts: np.ndarray) -> pa.RecordBatch:
    ends = np.append(starts[1:], len(fps)) if starts[-1] != len(fps) else starts[1:]
    out: set[tuple[int, int]] = set()
    unsigned = fps.view(np.uint64)
    for a, b in zip(starts[:len(ends)].tolist(), ends.tolist(), strict=True):
        if b - a > 1:
            out.update(linked(unsigned[a:b]))
    pairs = np.array(sorted(out), np.uint64).reshape(-1, 2).view(np.int64)
    return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(pairs[:, 0])),
                                       pa.array(np.ascontiguousarray(pairs[:, 1]))], names=["a", "b"])


def components(links: DataFrame, rounds: int = 200) -> DataFrame:
    """(fp, root) for every linked fingerprint, root the smallest of its component.

    Each round gives a node the smallest label of its neighbours' labels and then that label's own
    label, so labels travel exponentially far along a chain.  Minima combine before the shuffle,
    and the tables of a round are written to the shared folder."""
    both = written(links.union(links.select("b", "a")), "links")
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("a"), F.min("b")).alias("label")), "labels")
    for _ in range(rounds):
        seen = both.join(labels, both["b"] == labels["node"]).select(F.col("a").alias("node"), "label")
        low = seen.union(labels).groupBy("node").agg(F.min("label").alias("label"))
        jump = labels.select(F.col("node").alias("at"), F.col("label").alias("further"))
        new = written(low.join(jump, F.col("label") == F.col("at"), "left").select(
            "node", F.least("label", "further").alias("label")), "labels")
        old = labels.select("node", F.col("label").alias("before"))
        changed = new.join(old, "node").where(F.col("label") != F.col("before")).limit(1).count()
        labels = new
        if not changed:
            return labels.select(F.col("node").alias("fp"), F.col("label").alias("root"))
    raise RuntimeError(f"components: labels still change after {rounds} rounds")


def _members(rows: DataFrame) -> DataFrame:
    """``rows`` of :func:`fingerprints` with the root fingerprint of their component."""
    # dealt out by hand: a fingerprint is 8 bytes, its variants are 196 rows (another number than
    # the shuffle's, which Spark would take for the same and merge into few partitions)
    fps = rows.select("fp").distinct().repartition(2 * partitions(rows), "fp")
    found = components(links(emitted(fps)))
    return rows.join(found, "fp", "left").withColumn("root", F.coalesce("root", "fp"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, fp, component_id) of every row; component_id is the smallest doc_id reachable."""
    member = _members(written(fingerprints(docs), "fingerprints"))
    lows = member.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    return member.join(lows, "root").select("doc_id", "fp", "component_id")


def kept(docs: DataFrame) -> DataFrame:
    """One document of each component stays, the one of the smallest doc_id (null ids last); of
    repeated rows, the one whose other columns hash lowest."""
    member = _members(written(fingerprints(docs), "fingerprints"))
    first = member.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "copy")).alias("_first"))
    stay = first.select(F.col("_first.doc_id").alias("_id"), F.col("_first.copy").alias("_copy")).distinct()
    copy = F.xxhash64(text_or_empty())
    own = F.col("doc_id").cast("long")
    rest = [c for c, kind in docs.dtypes if c != "text" and "map<" not in kind]     # maps have no hash
    rows = docs.select(F.struct(*docs.columns).alias("_row"), own.alias("_own"), copy.alias("_of"),
                       F.xxhash64(*rest).alias("_low"))
    return (rows.join(stay, F.col("_own").eqNullSafe(F.col("_id")) & (F.col("_of") == F.col("_copy")), "left_semi")
            .groupBy("_own", "_of").agg(F.min_by("_row", "_low").alias("_row")).select("_row.*"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
