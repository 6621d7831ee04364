"""Byte-level BPE encoding and decoding (operator 7).

The merges run in Spark: higher-order functions fold them over the bytes of distinct words, looking
ranks up in one map; a word is folded once, however often the corpus has it.

1. Spark splits the texts into words.  A ``mapInArrow`` pass cuts each partition into blocks of
   about ``BLOCK_WORDS`` words, numbers a block's distinct words, writes the block's documents as
   word numbers to a file in the shared folder, and returns (block, number, word).
2. The words are shuffled and grouped; each distinct word is folded to its ids.
3. The ids go back to their blocks; a block's task reads its file and puts the ids in place.

So the texts themselves are never shuffled.  A block's file is written under an attempt's own name
and renamed, with content that depends on the input alone.  Grouping is per ``GROUP`` partitions, so
that the list of blocks of a frequent word is bounded.  Decoding concatenates the tokens' bytes.

Defined results: a null text is an empty text (no ids); null doc_ids are kept; repeated rows are
encoded each; extra input columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import json
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import partitions, shared_path, table, text_or_empty

#: Word occurrences of a block (a longer document is a block of its own), texts handed over at
#: once, and partitions whose blocks are grouped together.
BLOCK_WORDS, GROUP = 6_000_000, 1024
#: Ids whose bytes are laid out at once.
STEP = 1_000_000
#: Bits of a place that number a word within its block (more than a text of Spark's longest, 2 GiB,
#: can hold distinct ones), and a block within its partition.
_NUMBER, _BLOCK = 30, 13
#: The literal map is cut into this many small maps, picked by CRC-32 of the key.
BUCKETS = 1 << 15
#: A rank is kept as one character, U+0800 + rank, so that characters order as ranks do (in three
#: bytes each; ranks of 50,256 tokens end below the surrogates).
_BASE = 0x800
_NO_RANK = chr(0x10FFFF)
#: Bytes are written as U+0000..U+00FF; beyond them, the piece at either end and the piece separator.
_EDGE, _SEP = "\u0100", "\u0101"


def load_ranks(path: str) -> dict[bytes, int]:
    """Rank file (base64 token, blank, rank per line) as token -> rank."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f) if token}


def java_pattern(pattern: str) -> str:
    r"""The split pattern with ``\s`` written out: Java's ``\s`` is ASCII only."""
    return (pattern.replace(r"[^\s", r"[^\p{IsWhite_Space}").replace(r"\S", r"\P{IsWhite_Space}")
            .replace(r"\s", r"\p{IsWhite_Space}"))


_RANKS = "array<map<string,string>>"


def rank_buckets(ranks: dict[bytes, int]) -> str:
    """JSON array of maps, token (bytes as U+0000..U+00FF) -> rank character, in bucket
    the low bits of crc32(token): an element is found in O(1), where one large map is searched in O(n)."""
    buckets: list[dict[str, str]] = [{} for _ in range(BUCKETS)]
    for token, rank in ranks.items():
        key = token.decode("latin-1")
        buckets[zlib.crc32(key.encode()) % BUCKETS][key] = chr(_BASE + rank)
    return json.dumps(buckets)


def rank_map(ranks: dict[bytes, int]) -> Column:
    """The buckets as a literal: the cheapest to look words up in."""
    return F.from_json(F.lit(rank_buckets(ranks)), _RANKS)


def rank_table(spark: SparkSession, ranks: dict[bytes, int]) -> Column:
    """The buckets as the one value of a small table in the shared folder.  A literal is written out in
    every description of the plan (millions of characters, anew with each step of an adaptive query),
    which a driver that runs more than this query has no room for; a lookup takes a fifth longer."""
    path = shared_path(spark, "ranks")
    fs, root = _open(path)
    with fs.open_output_stream(root) as f:
        f.write(rank_buckets(ranks).encode())
    return spark.read.text(path, wholetext=True).select(F.from_json("value", _RANKS)).scalar()


def _let(value: Column, body) -> Column:
    """``body(value)`` with value evaluated once: a fold over nothing that starts with it."""
    return F.aggregate(F.array().cast("array<int>"), value, lambda v, _: v, body)


def bpe_ids(word: Column, ranks: Column) -> Column:
    """Ids of one word, one character (U+0800 + id) each: the leftmost lowest-ranked pair is
    merged first, until no pair has a rank.

    The fold's state holds the pieces, joined by a separator, and the rank characters of the
    pairs between them; strings are much cheaper in a fold than arrays, which are rebuilt
    element by element."""

    def encode(m: Column) -> Column:
        def rank(piece: Column) -> Column:
            found = F.try_element_at(m[F.crc32(piece.cast("binary")).bitwiseAND(F.lit(BUCKETS - 1).cast("long")).cast("int")], piece)
            return F.coalesce(found, F.lit(_NO_RANK))

        def pair(pieces: Column, j: Column) -> Column:
            two = F.call_function("substring_index", F.call_function("substring_index", pieces, F.lit(_SEP), j),
                                  F.lit(_SEP), F.lit(-2))
            return rank(F.replace(two, F.lit(_SEP), F.lit("")))

        def merge(s: Column, _: Column) -> Column:
            def at(j: Column) -> Column:
                cut = F.length(F.call_function("substring_index", s.p, F.lit(_SEP), j)) + 1
                return _let(F.overlay(s.p, F.lit(""), cut, F.lit(1)), lambda p: F.struct(
                    p.alias("p"),
                    F.overlay(s.r, F.concat(pair(p, j), pair(p, j + 1)), j - 1, F.lit(3)).alias("r")))

            return _let(F.call_function("instr", s.r, F.array_min(F.split(s.r, ""))), lambda j: F.when(
                j == 1, s).otherwise(at(j)))

        def fold(byte_text: Column) -> Column:
            size = F.length(byte_text)
            pieces = F.concat(F.lit(_EDGE + _SEP), F.array_join(F.split(byte_text, ""), _SEP), F.lit(_SEP + _EDGE))
            pairs = F.array_join(F.transform(F.sequence(F.lit(1), size - 1), lambda i: rank(
                F.substring(byte_text, i, F.lit(2)))), "")
            start = F.struct(pieces.alias("p"), F.concat(F.lit(_NO_RANK), pairs, F.lit(_NO_RANK)).alias("r"))
            merged = F.aggregate(F.sequence(F.lit(2), size), start, merge).p
            parts = F.split(F.substring(merged, F.lit(3), F.length(merged) - 4), _SEP)
            return _let(rank(byte_text), lambda whole: F.when((whole != _NO_RANK) | (size < 2), whole).otherwise(
                F.array_join(F.transform(parts, rank), "")))

        return _let(F.decode(F.encode(word, "UTF-8"), "ISO-8859-1"), fold)

    return _let(ranks, encode)


def _open(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def _words(docs: DataFrame, out: str, pattern: str) -> DataFrame:
    """(place, word) of the blocks' distinct words, and number 0 with an empty word once a block;
    writes the blocks' files: doc ids, words per document, and the documents as word numbers.  A
    place is partition, block and number in one long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _open(out)
        part, attempt = TaskContext.get().partitionId(), TaskContext.get().taskAttemptId()
        held: list[pa.RecordBatch] = []
        n_blocks = n_words = 0

        def block() -> Iterator[pa.RecordBatch]:
            nonlocal n_blocks, n_words
            coded = pa.chunked_array([b.column(1).flatten() for b in held], pa.string()).dictionary_encode()
            numbers = np.concatenate([np.empty(0, np.int32), *(c.indices.to_numpy() for c in coded.chunks)])
            found = coded.chunk(0).dictionary if coded.num_chunks else pa.array([], pa.string())
            # frequent words get small numbers: their high bytes, kept apart, compress to little
            rank = np.empty(len(found), np.int32)
            rank[np.argsort(-np.bincount(numbers, minlength=len(found)), kind="stable")] = np.arange(len(found))
            planes = rank[numbers].astype("<u4").view(np.uint8).reshape(-1, 4) if len(numbers) else np.empty((0, 4), np.uint8)
            own = pa.table({"doc_id": pa.chunked_array([b.column(0) for b in held]),
                            "words": pa.chunked_array([pc.list_value_length(b.column(1)) for b in held])})
            name = (part << _BLOCK) + n_blocks
            path = f"{root}/block-{name}"
            with fs.open_output_stream(f"{path}.attempt-{attempt}") as f:
                for part_table in (own, pa.table([np.ascontiguousarray(planes[:, k]) for k in range(4)], ["0", "1", "2", "3"])):
                    with pa.ipc.new_stream(f, part_table.schema,
                                           options=pa.ipc.IpcWriteOptions(compression="zstd")) as stream:
                        stream.write_table(part_table)
            fs.move(f"{path}.attempt-{attempt}", path)
            # in the order of words, so that neighbours in the shuffle share their beginnings
            order = pc.sort_indices(found).to_numpy()
            found = pa.concat_arrays([pa.array([""], pa.string()), found.take(pa.array(order))])
            places = (name << _NUMBER) + np.append(0, rank[order].astype(np.int64) + 1)
            for low in range(0, len(found), 50_000):
                yield pa.RecordBatch.from_arrays([pa.array(places[low:low + 50_000]), found.slice(low, 50_000)],
                                                 names=["place", "word"])
            held.clear()
            n_blocks, n_words = n_blocks + 1, 0
            del coded, numbers, planes, found, own
            pa.default_memory_pool().release_unused()

        for batch in batches:
            # a batch may hold many long texts: it is cut where a block is full
            ends = np.cumsum(pc.list_value_length(batch.column(1)).to_numpy(zero_copy_only=False))
            low = 0
            while low < batch.num_rows:
                before = int(ends[low - 1]) if low else 0
                high = max(low + 1, int(np.searchsorted(ends, before + BLOCK_WORDS - n_words, "right")))
                held.append(batch.slice(low, high - low))
                n_words += int(ends[high - 1]) - before
                if n_words >= BLOCK_WORDS or high < batch.num_rows:
                    yield from block()
                low = high
        if held:
            yield from block()

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select(F.col("doc_id").cast(kind), F.regexp_extract_all(
        text_or_empty(), F.lit(java_pattern(pattern)), F.lit(0)).alias("words")).mapInArrow(
        run, "place long, word string")


def read_block(out: str, name: int) -> tuple[pa.ChunkedArray, np.ndarray, np.ndarray]:
    """(doc ids, words per document, word numbers) of a block."""
    fs, root = _open(out)
    with fs.open_input_stream(f"{root}/block-{name}") as f:
        own, numbers = (pa.ipc.open_stream(f).read_all() for _ in range(2))
    planes = [numbers[k].to_numpy().astype(np.int32) for k in ("0", "1", "2", "3")]
    return own["doc_id"], own["words"].to_numpy(), planes[0] | planes[1] << 8 | planes[2] << 16 | planes[3] << 24


def put_in_place(own: np.ndarray, numbers: np.ndarray, word_ids: np.ndarray, sizes: np.ndarray) -> tuple:
    """(ids of all documents, start of each document and the end): word number k has the ids
    ``word_ids[start_k:start_k + sizes[k]]``."""
    starts = np.cumsum(sizes, dtype=np.int32) - sizes
    lengths = sizes[numbers]
    ends = np.cumsum(lengths, dtype=np.int32)
    at = np.repeat(starts[numbers] - (ends - lengths), lengths)
    at += np.arange(len(at), dtype=np.int32)
    return word_ids[at], np.append(0, ends)[np.append(0, np.cumsum(own))]


def _encoded(docs: DataFrame, ranks: Column, pattern: str, schema: str,
             rows: Callable[[pa.ChunkedArray, np.ndarray, np.ndarray], pa.Table]) -> DataFrame:
    """``rows(doc_ids, ids, starts)`` of every block; ``ranks`` is a :func:`rank_map` or :func:`rank_table`."""
    spark = docs.sparkSession
    out = shared_path(spark, "bpe")
    fs, root = _open(out)
    fs.create_dir(root, recursive=True)
    # dealt out by hand: folding is the work, and few bytes of words make much of it
    n = 2 * partitions(docs)
    group = F.shiftright("place", _NUMBER + _BLOCK + (GROUP - 1).bit_length())
    words = (_words(docs, out, pattern).repartition(n, "word").groupBy("word", group.alias("grp"))
             .agg(F.collect_list("place").alias("places")))
    # a column of its own first: a subquery may not be written inside a fold, into which Spark then moves it
    ids = words.withColumn("ranks", ranks).select(
        "places", F.when(F.col("word") != "", bpe_ids(F.col("word"), F.col("ranks"))).alias("ids"))
    back = ids.select(F.explode("places").alias("place"), "ids")

    def block(found: pa.Table) -> pa.Table:
        name = found["place"][0].as_py() >> _NUMBER
        text = found.sort_by("place")["ids"].combine_chunks()[1:]
        word_ids = np.frombuffer("".join(text.to_pylist()).encode("utf-32-le"), "<u4").astype(np.int32) - _BASE
        doc_ids, own, numbers = read_block(out, name)
        return rows(doc_ids, *put_in_place(own, numbers, word_ids,
                                           pc.utf8_length(text).to_numpy(zero_copy_only=False).astype(np.int32)))

    return back.groupBy(F.shiftright("place", _NUMBER).alias("block")).applyInArrow(block, schema)


def encode(docs: DataFrame, ranks: dict[bytes, int], pattern: str) -> DataFrame:
    """(doc_id, n_tokens, ids) of every row."""
    def rows(doc_ids: pa.ChunkedArray, ids: np.ndarray, starts: np.ndarray) -> pa.Table:
        listed = pa.LargeListArray.from_arrays(starts, pa.array(ids.astype(np.int32))).cast(pa.list_(pa.int32()))
        return pa.table({"doc_id": doc_ids, "n_tokens": np.diff(starts), "ids": listed})

    kind = docs.schema["doc_id"].dataType.simpleString()
    return _encoded(docs, rank_table(docs.sparkSession, ranks), pattern, f"doc_id {kind}, n_tokens long, ids array<int>", rows)


def decode(ids: list[int], tokens: dict[int, bytes]) -> bytes:
    """The tokens' bytes, one after the other."""
    return b"".join(map(tokens.__getitem__, ids))


def joined_sha256(ids: np.ndarray, starts: np.ndarray, pieces: pa.LargeBinaryArray, last: int) -> list[str]:
    """SHA-256 of each document's pieces, one after the other, but for the ``last`` bytes at its end;
    ``STEP`` ids at a time are laid out as bytes, however long a document is."""
    found, low, high = [], 0, 0
    for start, stop in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
        digest, at = hashlib.sha256(), start
        while at < stop:
            if at >= high:
                low, high = at, min(at + STEP, len(ids))
                laid = pieces.take(pa.array(ids[low:high])).buffers()
                offsets, data = np.frombuffer(laid[1], "<i8"), memoryview(laid[2])
            end = min(stop, high)
            digest.update(data[offsets[at - low]:offsets[end - low] - (last if end == stop else 0)])
            at = end
        found.append(digest.hexdigest())
    return found


def digests(docs: DataFrame, ranks: dict[bytes, int], pattern: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every row."""
    tokens = {rank: token for token, rank in ranks.items()}
    every = range(max(tokens, default=-1) + 1)
    numbers = pa.array([b"%d," % k for k in every], pa.large_binary())
    pieces = pa.array([tokens.get(k, b"") for k in every], pa.large_binary())

    def rows(doc_ids: pa.ChunkedArray, ids: np.ndarray, starts: np.ndarray) -> pa.Table:
        coded, decoded = joined_sha256(ids, starts, numbers, 1), joined_sha256(ids, starts, pieces, 0)
        return pa.table({"doc_id": doc_ids, "n_tokens": np.diff(starts),
                         "ids_sha256": pa.array(coded, pa.string()), "decoded_sha256": pa.array(decoded, pa.string())})

    kind = docs.schema["doc_id"].dataType.simpleString()
    return _encoded(docs, rank_map(ranks), pattern,
                    f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string", rows)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers
    return digests(table(spark, sf_dir, "documents"),
                   load_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")), public_tokenizers.PATTERN)
