"""Token counts without ids (operator 11).

1. Each partition's documents are cut into blocks of about ``BLOCK_BYTES`` of text.  A block has a
   dictionary of its distinct pre-tokens and, per document, the frequencies of these.
2. The dictionaries are shuffled by pre-token and sorted; the tokenizer's model counts the pieces
   of each distinct pre-token once, when the first of its equal rows comes by.
3. The counts go back to their blocks and are joined to the frequencies: a document's tokens are
   the sum of frequency times pieces.  No list of ids is ever made.

A frequent pre-token has one row a block, not one a document, so it makes no hot key; a task holds
one block.  Pre-tokens are those of the tokenizer itself: normalised, split by its pattern and
written in its byte alphabet.  Texts of printable ASCII take the pattern's ASCII form, other words
go through the tokenizer's own normaliser and splitter.

Defined results: a null text is an empty text (0 bytes, 0 tokens); a special string inside a text
is one token, as the library has it by default; null doc_ids are kept; repeated rows are counted
each; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import os
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import partitions, table, text_or_empty, written

#: Tokens beyond which a document is over the limit.
LIMIT = 2048
#: Text of a block (a longer document is a block of its own), and documents of one of its rows.
BLOCK_BYTES, CHUNK = 16_000_000, 512
#: Words outside printable ASCII whose pre-tokens a worker keeps.
KEPT_WORDS = 200_000
#: Bits of a block's number within its partition.
_BLOCK = 24
#: The tokenizer's pattern on lower-case ASCII.
_ASCII = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\sa-z0-9]+")
#: Control characters: they split or spell differently in Python and in the tokenizer.
_CONTROL = re.compile(r"[\x00-\x08\x0e-\x1f\x7f]")


class PreTokens:
    """Pre-tokens of texts, in the byte alphabet of the tokenizer's model."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(map(re.escape, sorted(added, key=len, reverse=True)))) if added else None
        self.kept: dict[str, list[str]] = {}

    def _split(self, text: str) -> list[str]:
        normal = self.tokenizer.normalizer.normalize_str(text)
        return [piece for piece, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(normal)]

    def counts(self, text: str) -> tuple[Counter, int]:
        """(frequency of each pre-token, special strings)."""
        if self.special is not None and self.special.search(text):
            found = Counter()
            parts = self.special.split(text)
            for part in parts:
                found += self.counts(part)[0]
            return found, len(parts) - 1
        if _CONTROL.search(text):
            return Counter(self._split(text)), 0
        if text.isascii():
            return Counter(_ASCII.findall(text.lower())), 0
        words = text.split()
        found = Counter(_ASCII.findall(" ".join([w for w in words if w.isascii()]).lower()))
        for word, n in Counter([w for w in words if not w.isascii()]).items():
            pieces = self.kept.get(word)
            if pieces is None:
                if len(self.kept) >= KEPT_WORDS:
                    self.kept.clear()
                pieces = self._split(word)
                if len(word) <= 40:
                    self.kept[word] = pieces
            for piece in pieces:
                found[piece] += n
        return found, 0

    def pieces(self, word: str) -> int:
        return len(self.tokenizer.model.tokenize(word))


@lru_cache(maxsize=2)
def pre_tokens(path: str) -> PreTokens:
    """One per worker process."""
    return PreTokens(path)


def packed(numbers: np.ndarray) -> bytes:
    """Unsigned 32-bit numbers as compressed byte planes: high bytes are mostly zero."""
    planes = numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T
    return zstandard.compress(np.ascontiguousarray(planes).tobytes(), 3)


def unpacked(code: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(code), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").ravel().astype(np.int64)


_FREQUENCIES = ("block long, doc_id array<long>, n_bytes array<long>, special array<long>, sizes array<int>, "
                "numbers binary, times binary, words array<string>")


def frequencies(docs: DataFrame, tokenizer: str, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Rows of up to ``CHUNK`` documents: their ids, and the numbers and frequencies of their
    pre-tokens one after the other; a block's first row has its dictionary in ``words``, sorted,
    the k-th being pre-token number k."""
    schema = pa.schema([("block", pa.int64()), ("doc_id", pa.list_(pa.int64())), ("n_bytes", pa.list_(pa.int64())),
                        ("special", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int32())), ("numbers", pa.binary()),
                        ("times", pa.binary()), ("words", pa.list_(pa.string()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = pre_tokens(tokenizer)
        part, n_blocks, held = TaskContext.get().partitionId(), 0, 0
        words: dict[str, int] = {}
        rows: list[tuple] = []      # (doc_id, bytes, special strings, numbers, frequencies)

        def block() -> Iterator[pa.RecordBatch]:
            name = (part << _BLOCK) + n_blocks
            known = sorted(words)
            place = np.empty(len(words), np.int64)
            place[[words[w] for w in known]] = np.arange(len(known))
            for low in range(0, len(rows), CHUNK):
                some = rows[low:low + CHUNK]
                numbers = place[np.concatenate([r[3] for r in some])]
                times = np.concatenate([r[4] for r in some])
                sizes = np.array([len(r[3]) for r in some])
                # in order within a document, as steps: small numbers pack well
                order = np.lexsort((numbers, np.repeat(np.arange(len(some)), sizes)))
                numbers, times = numbers[order], times[order]
                steps = np.diff(numbers, prepend=0)
                first = (np.cumsum(sizes) - sizes)[sizes > 0]
                steps[first] = numbers[first]
                yield pa.RecordBatch.from_pylist([{
                    "block": name, "doc_id": [r[0] for r in some], "n_bytes": [r[1] for r in some],
                    "special": [r[2] for r in some], "sizes": sizes.tolist(), "numbers": packed(steps),
                    "times": packed(times), "words": None if low else known}], schema=schema)
            words.clear()
            rows.clear()

        for batch in batches:
            for doc_id, n_bytes, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(),
                                             batch.column(2), strict=True):
                found, special = split.counts(text.as_py())
                for word in found:
                    if word not in words:
                        words[word] = len(words)
                rows.append((doc_id, n_bytes, special,
                             np.fromiter(map(words.__getitem__, found), np.int64, len(found)),
                             np.fromiter(found.values(), np.int64, len(found))))
                held += n_bytes
                if held >= block_bytes:
                    yield from block()
                    n_blocks, held = n_blocks + 1, 0
        if rows:
            yield from block()

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                      F.octet_length(text_or_empty()).cast("long").alias("n_bytes"), text_or_empty().alias("text"))
    return own.mapInArrow(run, _FREQUENCIES)


def piece_counts(dictionary: DataFrame, tokenizer: str) -> DataFrame:
    """(block, number, pieces) of the rows (block, number, word): equal words come one after the
    other, and the model sees each once."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, word, n = pre_tokens(tokenizer).pieces, None, 0
        for batch in batches:
            pieces = np.empty(batch.num_rows, np.int32)
            for k, own in enumerate(batch.column(2).to_pylist()):
                if own != word:
                    word, n = own, count(own)
                pieces[k] = n
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(pieces)],
                                             names=["block", "number", "pieces"])

    return (dictionary.select("block", "number", "word").repartition(partitions(dictionary), "word")
            .sortWithinPartitions("word").mapInArrow(run, "block long, number int, pieces int"))


def _summed(limit: int):
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()),
                        ("over_limit", pa.bool_())])

    def run(found: pa.Table, counts: pa.Table) -> pa.Table:
        pieces = np.zeros(counts.num_rows, np.int64)
        pieces[counts["number"].to_numpy()] = counts["pieces"].to_numpy()
        out = []
        for row in found.select(["doc_id", "n_bytes", "special", "sizes", "numbers", "times"]).to_pylist():
            sizes = np.array(row["sizes"], np.int64)
            ends = np.cumsum(sizes)
            numbers = np.cumsum(unpacked(row["numbers"]))
            # steps start anew with each document
            before = np.append(0, numbers)[ends - sizes]
            numbers -= np.repeat(before, sizes)
            sums = np.append(0, np.cumsum(pieces[numbers] * unpacked(row["times"])))
            tokens = sums[ends] - sums[ends - sizes] + np.array(row["special"], np.int64)
            out.append(pa.table([pa.array(row["doc_id"], pa.int64()), pa.array(row["n_bytes"], pa.int64()),
                                 pa.array(tokens), pa.array(tokens > limit)], schema=schema))
        return pa.concat_tables(out) if out else schema.empty_table()

    return run


def token_counts(docs: DataFrame, tokenizer: str, limit: int = LIMIT, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every row."""
    found = written(frequencies(docs, tokenizer, block_bytes), "frequencies")
    dictionary = found.where(F.col("words").isNotNull()).select("block", F.posexplode("words").alias("number", "word"))
    counts = piece_counts(dictionary, tokenizer)
    return found.drop("words").groupBy("block").cogroup(counts.groupBy("block")).applyInArrow(
        _summed(limit), "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers
    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
