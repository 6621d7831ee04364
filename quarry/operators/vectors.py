"""Dense/sparse feature vectors as array<double> columns (M7-M9).

Vectors stay per row (one row per text); every operation is a column expression
(``aggregate``/``zip_with``/``transform``) so it runs inside whole-stage codegen."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Texts whose character grams are looked up at once, and grams hashed at once.
GRAM_ROWS, GRAMS = 256, 1 << 18


def as_double_array(col: Column | str) -> Column:
    c = F.col(col) if isinstance(col, str) else col
    return F.transform(c, lambda v: v.cast("double"))


def sq_norm(vec: Column) -> Column:
    return F.aggregate(vec, F.lit(0.0), lambda acc, v: acc + v * v)


def _with_each(vec: Column, value: Column, fn) -> Column:
    """``transform(vec, v -> fn(v, value))`` with ``value`` evaluated ONCE per row:
    a lambda that referenced an outer expression would re-evaluate it for every
    element once Catalyst inlines it."""
    return F.zip_with(vec, F.array_repeat(value, F.size(vec)), fn)


def l2_normalize(vec: Column) -> Column:
    """M8: row / ||row||; all-zero rows stay zero."""
    n = F.sqrt(sq_norm(vec))
    return _with_each(vec, F.when(n > 0, n).otherwise(F.lit(1.0)), lambda v, m: v / m)


def scale(vec: Column, factor: float) -> Column:
    return F.transform(vec, lambda v: v * F.lit(float(factor)))


def sq_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda acc, v: acc + v)


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(sq_distance(a, b))


def cosine_distance(a: Column, b: Column) -> Column:
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, v: acc + v)
    den = F.sqrt(sq_norm(a)) * F.sqrt(sq_norm(b))
    return F.when(den > 0, F.lit(1.0) - dot / den).otherwise(F.lit(1.0))


def sparse_to_dense(weights: DataFrame, id_cols: Sequence[str], size: int,
                    index_col: str = "feature_index", value_col: str = "weight") -> DataFrame:
    """Long (id, index, value) -> one dense array per id (missing indices 0).
    Used for the bounded vocabularies of M1-M3 (size <= max_features)."""
    grouped = weights.groupBy(*id_cols).agg(
        F.array_sort(F.collect_list(F.struct(F.col(index_col).cast("int").alias("i"), F.col(value_col).cast("double").alias("v"))))
        .alias("_m"))
    # the array between two places of the sorted ones is zeros
    m = F.col("_m")
    before = F.concat(F.array(F.lit(-1)), m["i"])
    after = F.concat(m["i"], F.array(F.lit(size)))
    gaps = F.zip_with(before, after, lambda a, b: F.array_repeat(F.lit(0.0), b - a - 1))
    values = F.concat(F.transform(m["v"], lambda v: F.array(v)), F.array(F.array().cast("array<double>")))
    return grouped.select(*id_cols, F.flatten(F.zip_with(gaps, values, lambda g, v: F.concat(g, v))).alias("sparse"))


def fuse(dense: Column, sparse: Column | None, alpha: float,
         length_z: Column | None = None, onehot: Column | None = None) -> Column:
    """M9 early fusion: ``[sqrt(a)*dense/|dense|, sqrt(1-a)*sparse/|sparse|, 0.1*len, 0.25*onehot]``;
    alpha = 1 -> raw dense only, alpha = 0 -> raw sparse only (neither normalised)."""
    if alpha >= 1.0 or sparse is None:
        base = dense
    elif alpha <= 0.0:
        base = sparse
    else:
        base = F.concat(scale(l2_normalize(dense), alpha ** 0.5), scale(l2_normalize(sparse), (1.0 - alpha) ** 0.5))
    parts = [base]
    if length_z is not None:
        parts.append(F.array(length_z * F.lit(0.1)))
    if onehot is not None:
        parts.append(scale(onehot, 0.25))
    return parts[0] if len(parts) == 1 else F.concat(*parts)


def _rotl(x: np.ndarray, by: int) -> np.ndarray:
    return (x << np.uint32(by)) | (x >> np.uint32(32 - by))


def _murmur3(rows: np.ndarray, seed: int = 42) -> np.ndarray:
    """MurmurHash3 (32 bits) of the rows of a matrix of bytes, as MLlib's ``HashingTF`` has it."""
    n, size = rows.shape
    h = np.full(n, seed, np.uint32)

    def mixed(places: range) -> np.ndarray:
        k = np.zeros(n, np.uint32)
        for shift, at in enumerate(places):
            k |= rows[:, at].astype(np.uint32) << np.uint32(8 * shift)
        return _rotl(k * np.uint32(0xCC9E2D51), 15) * np.uint32(0x1B873593)

    whole = size - size % 4
    for at in range(0, whole, 4):
        h = _rotl(h ^ mixed(range(at, at + 4)), 13) * np.uint32(5) + np.uint32(0xE6546B64)
    if whole < size:
        h ^= mixed(range(whole, size))
    h ^= np.uint32(size)
    h = (h ^ (h >> np.uint32(16))) * np.uint32(0x85EBCA6B)
    h = (h ^ (h >> np.uint32(13))) * np.uint32(0xC2B2AE35)
    return h ^ (h >> np.uint32(16))


def _gram_counts(texts: pa.Array, n: int, dim: int) -> np.ndarray:
    """(texts x dim) how many character ``n``-grams of each text fall into each bucket."""
    texts = texts.cast(pa.large_binary()).fill_null(b"")
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[ends[0]:ends[-1]]
    ends = ends - ends[0]
    first = np.flatnonzero((data & 0xC0) != 0x80)          # where characters begin
    starts, stops = first[:len(first) - n + 1], np.append(first, len(data))[n:]
    row = np.searchsorted(ends, starts, side="right") - 1  # empty texts hold no start
    within = stops <= ends[row + 1]
    starts, sizes, row = starts[within], (stops - starts)[within], row[within]
    counts = np.zeros(len(texts) * dim, np.int64)
    for size in np.unique(sizes):
        own = np.flatnonzero(sizes == size)
        for low in range(0, len(own), GRAMS):
            few = own[low:low + GRAMS]
            # as a signed number modulo dim, never below zero
            bucket = _murmur3(data[starts[few][:, None] + np.arange(size)]).view(np.int32) % np.int32(dim)
            counts += np.bincount(row[few] * dim + bucket, minlength=len(counts))
    return counts.reshape(len(texts), dim)


def hashed_char_embedding(df: DataFrame, text_col: str, out_col: str = "dense", dim: int = 64,
                          n: int = 3) -> DataFrame:
    """M7 default encoder (no model files): character ``n``-grams of the text (lower case, blanks collapsed, as
    ``tfidf.char_terms``) hashed into ``dim`` buckets as MLlib ``HashingTF`` does, L2-normalised.  The
    grams are counted in Arrow batches, none becomes a string of its own.
    A model-backed encoder plugs in instead as an input column."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, GRAM_ROWS):
                part = batch.slice(low, GRAM_ROWS)
                counts = _gram_counts(part.column(part.num_columns - 1), n, dim).astype(np.float64)
                held = pa.ListArray.from_arrays(pa.array(np.arange(len(counts) + 1) * dim, pa.int32()), pa.array(counts.ravel()))
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], held], names=[*part.schema.names[:-1], out_col])

    text = F.regexp_replace(F.lower(F.coalesce(F.col(text_col), F.lit(""))), r"\s\s+", " ")
    schema = T.StructType([*df.schema.fields, T.StructField(out_col, T.ArrayType(T.DoubleType()))])
    return df.withColumn("_text", text).mapInArrow(run, schema).withColumn(out_col, l2_normalize(F.col(out_col)))


def jaccard_distance(a_terms: Column, b_terms: Column) -> Column:
    """Jaccard distance of two term sets (non-zero TF-IDF entries); two empty sets -> 0."""
    inter = F.size(F.array_intersect(a_terms, b_terms))
    union = F.size(F.array_union(a_terms, b_terms))
    return F.when(union == 0, F.lit(0.0)).otherwise(F.lit(1.0) - inter / union)


def hybrid_distance(a_dense: Column, b_dense: Column, a_terms: Column, b_terms: Column,
                    alpha: float = 0.7) -> Column:
    """``alpha * cosine(dense) + (1 - alpha) * jaccard(terms)`` for a pair."""
    return F.lit(alpha) * cosine_distance(a_dense, b_dense) + \
        F.lit(1.0 - alpha) * jaccard_distance(a_terms, b_terms)
