"""Token-ID files (operator 1).

A corpus is written as pairs of flat files per partition, documents in ascending doc_id order
across the partitions (null ids first):

``part-NNNNN.bin``  the ids, unsigned 16-bit (32-bit for larger vocabularies), little-endian
``part-NNNNN.idx``  unsigned 64-bit little-endian start of each document in the whole corpus,
                    and the end of the last: one more entry than documents
``part-NNNNN.doc``  per document its doc_id (int64) and whether that is null (uint8)

Job 1 range-partitions the texts, encodes each partition in one pass and writes .bin and .doc;
it returns one row of totals per partition.  Prefix sums of these give each partition's base,
and job 2 writes the .idx files.  A file is written under an attempt's own name and renamed, and
its content depends on the input alone, so repeated or speculative tasks do no harm.
:func:`read` memory-maps the files (other file systems than a local or mounted one: reads them).

Defined results: a null text is an empty text and yields just the end id; documents with equal
ids are ordered by a hash of their text; extra columns are ignored; an empty table yields no files.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import partitions, text_or_empty

#: Words kept with their ids by a worker, and the longest word kept; text encoded at once.
CACHE_WORDS, CACHE_CHARS, SLICE_BYTES = 800_000, 40, 8_000_000
#: A row of a .doc file.
_DOC = np.dtype([("id", "<i8"), ("null", "u1")])
#: Texts encoded whole: separators to Arrow's splitting that are not white space to the tokenizer's
#: pattern, marks that compose with a letter differently once it is lower-cased, and what may be a
#: special string.
_WHOLE = r"[\x1c-\x1f\x{300}-\x{36F}]|<\|"
#: The tokenizer's pattern ends a run of letters here, and no normal form spans it.
_LETTERS_END = r"([a-z\x{E0}-\x{F6}\x{F8}-\x{FF}])([!-@\[-`{-~])"


class WordEncoder:
    """Encodes texts with a tokenizer that lower-cases and whose pattern never spans white space or
    the end of a run of letters: a text's ids are those of its parts, so each distinct part is
    encoded once."""

    #: Texts that are one part, and what each part begins with besides its own characters.
    whole, before = _WHOLE, ""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.dtype = "<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4"
        self.words: dict[str, bytes] = {}

    def _codes(self, words: list[str]) -> list[bytes]:
        """Each distinct part's ids; those not seen before are encoded in one call."""
        known = self.words
        if len(known) > CACHE_WORDS:
            known.clear()
        new = [w for w in words if w not in known]
        asked = [self.before + w for w in new] if self.before else new
        found = {w: np.array(e.ids, self.dtype).tobytes() for w, e in
                 zip(new, self.tokenizer.encode_batch_fast(asked, add_special_tokens=False), strict=True)}
        codes = [found[w] if w in found else known[w] for w in words]
        known.update((w, ids) for w, ids in found.items() if len(w) <= CACHE_CHARS)
        return codes

    def parts(self, texts: pa.Array) -> pa.Array:
        return pc.utf8_split_whitespace(pc.replace_substring_regex(pc.ascii_lower(texts), _LETTERS_END, r"\1 \2"))

    def __call__(self, texts: pa.Array, end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after the other, each with end_id, if any, at its end; ids per text)."""
        whole = pc.match_substring_regex(texts, self.whole)
        if pc.any(whole).as_py():
            lists = [[t] if one else None for t, one in zip(texts.to_pylist(), whole.to_pylist(), strict=True)]
            rest = iter(self.parts(texts.filter(pc.invert(whole))).to_pylist())
            words = pa.array([next(rest) if own is None else own for own in lists], pa.list_(pa.string()))
        else:
            words = self.parts(texts)
        coded = words.flatten().dictionary_encode()
        codes = self._codes(coded.dictionary.to_pylist())
        numbers = coded.indices.to_numpy().astype(np.int64)
        own = pc.list_value_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
        if end_id is not None:      # one more part of each text
            numbers = np.insert(numbers, np.cumsum(own), len(codes))
            codes, own = [*codes, np.array([end_id], self.dtype).tobytes()], own + 1
        ids = np.frombuffer(b"".join(codes), self.dtype)
        sizes = np.fromiter(map(len, codes), np.int64, len(codes)) // ids.itemsize
        starts = np.cumsum(sizes) - sizes
        lengths = sizes[numbers]
        ends = np.cumsum(lengths)
        at = np.repeat(starts[numbers] - (ends - lengths), lengths)
        at += np.arange(len(at))
        return ids[at], np.diff(np.append(0, ends)[np.append(0, np.cumsum(own))])


@lru_cache(maxsize=2)
def encoder(path: str) -> WordEncoder:
    """One encoder per worker process: its words serve all tasks the worker runs."""
    return WordEncoder(path)


def _open(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def _publish(fs: pafs.FileSystem, own: str, path: str) -> None:
    """The attempt's file gets its final name; equal content of another attempt may be there."""
    fs.move(own, path)


def _own(path: str) -> str:
    return f"{path}.attempt-{TaskContext.get().taskAttemptId()}"


def write(docs: DataFrame, out: str, tokenizer: str, end_id: int = 1,
          n_parts: int | None = None) -> DataFrame:
    """Encode ``docs`` (doc_id, text) into files under ``out``; returns (part, base, docs, tokens)."""
    spark = docs.sparkSession
    fs, root = _open(out)
    fs.create_dir(root, recursive=True)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode_texts = encoder(tokenizer)
        part = TaskContext.get().partitionId()
        fs, root = _open(out)
        stem = f"{root}/part-{part:05d}"
        n_docs = n_tokens = 0
        with fs.open_output_stream(_own(f"{stem}.bin")) as ids, fs.open_output_stream(_own(f"{stem}.doc")) as names, \
                fs.open_output_stream(_own(f"{stem}.len")) as lengths:
            for batch in batches:
                doc_ids, texts = batch.column(0), batch.column(1)
                rows = np.zeros(batch.num_rows, _DOC)
                rows["id"] = doc_ids.fill_null(0).to_numpy(zero_copy_only=False)
                rows["null"] = doc_ids.is_null().to_numpy(zero_copy_only=False)
                names.write(rows.tobytes())
                ends, low = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)), 0
                while low < batch.num_rows:
                    before = ends[low - 1] if low else 0
                    high = max(low + 1, int(np.searchsorted(ends, before + SLICE_BYTES, "right")))
                    codes, sizes = encode_texts(texts.slice(low, high - low), end_id)
                    ids.write(codes.tobytes())
                    lengths.write(sizes.astype("<u8").tobytes())
                    n_tokens += len(codes)
                    low = high
                n_docs += batch.num_rows
        for kind in ("bin", "doc", "len"):
            _publish(fs, _own(f"{stem}.{kind}"), f"{stem}.{kind}")
        if n_docs:
            yield pa.RecordBatch.from_pydict({"part": [part], "docs": [n_docs], "tokens": [n_tokens]},
                                             schema=pa.schema([("part", pa.int64()), ("docs", pa.int64()),
                                                               ("tokens", pa.int64())]))

    n_parts = n_parts or partitions(docs)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    ordered = (rows.repartitionByRange(n_parts, F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
               .sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.xxhash64("text")))
    # one row per partition, whatever the corpus size
    totals = sorted(ordered.mapInArrow(encode, "part long, docs long, tokens long").collect())
    bases, base = [], 0
    for part, n_docs, n_tokens in totals:
        bases.append((part, base, n_docs, n_tokens))
        base += n_tokens
    parts = spark.createDataFrame(bases, "part long, base long, docs long, tokens long")

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _open(out)
        for batch in batches:
            for part, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                stem = f"{root}/part-{part:05d}"
                with fs.open_input_stream(f"{stem}.len") as f:
                    sizes = np.frombuffer(f.read(), "<u8")
                starts = np.concatenate([[0], np.cumsum(sizes)]).astype("<u8") + np.uint64(base)
                with fs.open_output_stream(_own(f"{stem}.idx")) as f:
                    f.write(starts.tobytes())
                _publish(fs, _own(f"{stem}.idx"), f"{stem}.idx")
            yield batch

    if bases:
        parts.repartition(min(len(bases), n_parts), "part").mapInArrow(index, parts.schema).collect()
    return parts


def _mapped(fs: pafs.FileSystem, path: str, dtype) -> np.ndarray:
    if isinstance(fs, pafs.LocalFileSystem):
        return np.memmap(path, dtype, "r") if os.path.getsize(path) else np.empty(0, dtype)
    with fs.open_input_file(path) as f:
        return np.frombuffer(f.read(), dtype)


def read(parts: DataFrame, out: str, id_dtype: str) -> DataFrame:
    """Per document of the files: doc_id, start, n_tokens, ids_crc32 (CRC-32 of the ids as
    little-endian unsigned 32-bit integers)."""
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()),
                        ("ids_crc32", pa.int64())])

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _open(out)
        for batch in batches:
            for part in batch.column(0).to_pylist():
                stem = f"{root}/part-{part:05d}"
                ids, starts = _mapped(fs, f"{stem}.bin", id_dtype), _mapped(fs, f"{stem}.idx", "<u8").astype("i8")
                names = _mapped(fs, f"{stem}.doc", _DOC)
                at = starts - starts[0]
                for low in range(0, len(names), 4096):
                    some = names[low:low + 4096]
                    cuts = at[low:low + len(some) + 1]
                    crc = [zlib.crc32(ids[a:b].astype("<u4").tobytes())
                           for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(some["id"].astype("i8"), mask=some["null"].astype(bool)),
                         pa.array(starts[low:low + len(some)]), pa.array(np.diff(cuts)),
                         pa.array(crc, pa.int64())], schema=schema)

    n = max(1, parts.count())
    return parts.select("part").repartition(n, "part").mapInArrow(
        digests, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_files(docs: DataFrame, out: str, tokenizer: str, end_id: int = 1) -> DataFrame:
    """Write the corpus and read it back."""
    return read(write(docs, out, tokenizer, end_id), out, encoder(tokenizer).dtype)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from quarry.llm.common import shared_path, table
    return token_files(table(spark, sf_dir, "documents"), shared_path(spark, "tokens"),
                       public_tokenizers.path("word_bpe_49k.json"))
