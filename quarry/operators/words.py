"""Cleaned words of texts (F11), counted in Arrow batches.

The words are those of :func:`quarry.functions.text.clean_tokens`: the runs of letters of the lower-cased
text without stop words.  Lower-casing is Spark's; a task finds the runs of a batch in its UTF-8 bytes,
gives every distinct word of the batch a number and counts numbers, so no string is made of a word that
comes again.  At most about ``BYTES`` of text are taken at once.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of text whose words are counted together (a longer text alone).
BYTES = 4_000_000


def _pieces(batch: pa.RecordBatch, at: int) -> Iterator[pa.RecordBatch]:
    size = np.cumsum(pc.binary_length(batch.column(at)).to_numpy(zero_copy_only=False).astype(np.int64))
    low = 0
    while low < batch.num_rows:
        high = max(low + 1, int(np.searchsorted(size, (size[low - 1] if low else 0) + BYTES, "right")))
        yield batch.slice(low, high - low)
        low = high


def _numbered(texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray, pa.StringArray]:
    """Of every run of a-z: the row it stands in and the number of its word; and the words by number."""
    _, places, data = texts.buffers()
    ends = np.frombuffer(places, np.int32)[texts.offset:texts.offset + len(texts) + 1]
    data = np.frombuffer(data, np.uint8)[ends[0]:ends[-1]] if data is not None else np.empty(0, np.uint8)
    ends = ends - ends[0]
    letter = (data - np.uint8(97)) < 26
    first = letter.copy()
    first[1:] &= ~letter[:-1]
    cuts = ends[:-1][ends[:-1] < len(data)]
    first[cuts] = letter[cuts]  # no word goes on from one text into the next
    row = np.repeat(np.arange(len(texts)), np.diff(np.searchsorted(np.flatnonzero(first), ends)))
    chars = data[letter]
    starts = np.r_[np.flatnonzero(first[letter]), len(chars)].astype(np.int32)
    words = pa.StringArray.from_buffers(len(row), pa.py_buffer(starts), pa.py_buffer(chars)).dictionary_encode()
    return row, words.indices.to_numpy(), words.dictionary


def _kept(words: pa.StringArray, stop_words: Iterable[str]) -> np.ndarray:
    return ~pc.is_in(words, value_set=pa.array(list(stop_words), pa.string())).to_numpy(zero_copy_only=False)


def word_counts(docs: DataFrame, text_col: str, stop_words: Iterable[str], min_len: int = 1) -> DataFrame:
    """One row for every distinct word of at least ``min_len`` letters of every row that keeps a word,
    without the text: ``term``, its count ``tf`` and its place among the row's.  A row whose words are all
    shorter has one without a term."""
    stops = list(stop_words)
    keep = [c for c in docs.columns if c != text_col]
    low = docs.select(*keep, F.lower(F.coalesce(F.col(text_col).cast("string"), F.lit(""))).alias("_text"))
    fields = T.StructType.fromDDL("place int, term string, tf long").fields

    def of(texts: pa.StringArray) -> tuple[np.ndarray, list[pa.Array]]:
        row, code, words = _numbered(texts)
        kept = _kept(words, stops)
        live = kept[code]
        none = np.setdiff1d(row[live], row[(used := live & (pc.binary_length(words).to_numpy() >= min_len)[code])])
        key, tf = np.unique(row[used] * np.int64(max(len(words), 1)) + code[used], return_counts=True)
        row, code = np.divmod(key, max(len(words), 1))
        place = np.arange(len(row)) - np.searchsorted(row, row)
        gone = np.repeat([False, True], [len(row), len(none)])
        pad = np.zeros(len(none), np.int64)
        return np.r_[row, none], [pa.array(np.r_[place, pad], pa.int32()), words.take(pa.array(np.r_[code, pad], mask=gone)),
                                  pa.array(np.r_[tf, pad], pa.int64(), mask=gone)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in _pieces(batch, len(keep)):
                row, columns = of(piece.column(len(keep)))
                held = piece.select(keep).take(pa.array(row))
                yield pa.RecordBatch.from_arrays([*held.columns, *columns], names=[*keep, *(f.name for f in fields)])

    return low.mapInArrow(run, T.StructType([*low.schema.fields[:-1], *fields]))
