"""Cross-tokenizer alignment (operator 12).

1. Texts are shuffled and grouped by their whole text; each distinct text goes on once, with the
   number of documents that have it.
2. It is encoded by both tokenizers and aligned on byte offsets: groups end where tokens of both
   end, links are the token pairs whose byte ranges overlap.  The texts of a partition form blocks
   of about ``BLOCK_BYTES``; a block has a dictionary of its distinct pairs of ids, each with the
   number of documents that hold it (texts weighted by their multiplicity), and a text keeps the
   numbers of its pairs and how often it links them.
3. The blocks' numbers of documents are summed by pair over the corpus, and the highest sum of
   each id of tokenizer A is taken (at most one row an id: bounded by the vocabulary).
4. The sums go back to the blocks, whose texts add them up; the measures of a text are joined to
   the doc_ids of its documents by its SHA-256.

A frequent pair has one row a block; a text that many documents copy is one row a map task in
step 1 and one row in the last join, whose other side Spark splits.

Defined results: a text that is null or empty, or that either tokenizer does not give back byte by
byte, has no tokens: zeros and an empty groups_sha256.  Strings of special tokens are plain text.
Null doc_ids are kept; repeated rows are documents each; extra columns are ignored; an empty table
gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import table, text_or_empty, written
from quarry.llm.token_files import WordEncoder

#: Text of a block, and of the batches it is aligned in (a longer text is one of its own).
BLOCK_BYTES, BATCH_BYTES = 16_000_000, 2_000_000
#: Bits of a block's number within its partition.
_BLOCK = 24
MEASURES = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")


def byte_alphabet() -> dict[str, int]:
    """Characters of a byte-level vocabulary -> byte: printable Latin-1 stands for itself, the
    other bytes in order for U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = sorted(set(range(256)) - set(shown))
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


class Side:
    """One tokenizer: ids of texts, the bytes of each id, and their decimal forms."""

    def __init__(self, tokens: list[bytes]):
        self.tokens = tokens
        self.length = np.array([len(t) for t in tokens], np.int64)
        self.comma, self.bar, self.semicolon = (
            np.array([b"%d%c" % (k, end) for k in range(len(tokens))], object) for end in b",|;")

    def __len__(self) -> int:
        return len(self.tokens)

    def spells(self, ids: np.ndarray, n: np.ndarray, texts: list[bytes]) -> np.ndarray:
        """Whether the ids of each text give back its bytes."""
        blob = b"".join(map(self.tokens.__getitem__, ids.tolist()))
        cuts = np.append(0, np.cumsum(self.length[ids]))[np.append(0, np.cumsum(n))].tolist()
        return np.array([blob[low:high] == text for low, high, text in zip(cuts[:-1], cuts[1:], texts, strict=True)])


class SpacedEncoder(WordEncoder):
    """Encodes a blank and the text.  The tokenizer's pattern starts anew at a blank that has white
    space on one side at most, so that a text is cut at its blanks, each part with its blank before
    it, and each distinct part is encoded once; texts with other blanks are encoded whole."""

    whole, before = r"[\s\x0b\x1c-\x1f\x{85}\p{Z}] (?:[\s\x0b\x1c-\x1f\x{85}\p{Z}]|$)|^ (?:[\s\x0b\x1c-\x1f\x{85}\p{Z}]|$)", " "

    def __init__(self, path: str):
        super().__init__(path)
        self.tokenizer.encode_special_tokens = True

    def parts(self, texts: pa.Array) -> pa.Array:
        return pc.split_pattern(texts, " ")


class Aligner:
    """Both tokenizers of a worker process."""

    def __init__(self, path_a: str, path_b: str):
        import sentencepiece
        self.words_a = SpacedEncoder(path_a)
        self.lib_b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        alphabet = byte_alphabet()
        vocabulary = self.words_a.tokenizer.get_vocab(with_added_tokens=True)
        tokens = [b""] * (max(vocabulary.values()) + 1)
        for token, k in vocabulary.items():
            tokens[k] = bytes(alphabet[c] for c in token) if all(c in alphabet for c in token) else token.encode()
        self.a = Side(tokens)
        pieces = [self.lib_b.id_to_piece(k) for k in range(self.lib_b.get_piece_size())]
        self.b = Side([bytes([int(p[3:5], 16)]) if self.lib_b.is_byte(k) else p.replace("▁", " ").encode()
                       for k, p in enumerate(pieces)])

    def ids(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids by A and by B, and how many each text has; none where either does not spell the text."""
        a, n_a = self.words_a(pa.array(texts, pa.string()))
        found = self.lib_b.encode(texts, num_threads=1)
        n_b = np.array([len(x) for x in found], np.int64)
        b = np.fromiter((k for x in found for k in x), np.int64, int(n_b.sum()))
        spelled = [f" {t}".encode() for t in texts]
        good = self.a.spells(a, n_a, spelled) & self.b.spells(b, n_b, spelled) & np.array([t != "" for t in texts])
        return a[np.repeat(good, n_a)].astype(np.int64), n_a * good, b[np.repeat(good, n_b)], n_b * good

    def align(self, texts: list[str]) -> tuple[np.ndarray, list[str], np.ndarray, np.ndarray, np.ndarray]:
        """(n_a, n_b, n_groups, n_links per text as rows; the texts' digests; and the texts' distinct
        pairs: text, pair = a * len(B) + b, links)."""
        a, n_a, b, n_b = self.ids(texts)
        # the texts stand one after the other; each ends where tokens of both end
        end_a, end_b = np.cumsum(self.a.length[a]), np.cumsum(self.b.length[b])
        both = end_a[np.append(end_b, -1)[np.searchsorted(end_b, end_a)] == end_a]
        group_a, group_b = np.searchsorted(both, end_a), np.searchsorted(both, end_b)
        text_a, text_b = np.repeat(np.arange(len(texts)), n_a), np.repeat(np.arange(len(texts)), n_b)
        last_a = np.diff(group_a, append=len(both)) > 0
        last_b = np.diff(group_b, append=len(both)) > 0
        n_groups = np.bincount(text_a[last_a], minlength=len(texts))

        sizes_a, sizes_b = (np.bincount(g, minlength=len(both)) for g in (group_a, group_b))
        shown = np.empty(len(a) + len(b), object)
        shown[np.arange(len(a)) + (np.cumsum(sizes_b) - sizes_b)[group_a]] = np.where(last_a, self.a.bar[a], self.a.comma[a])
        shown[np.arange(len(b)) + np.cumsum(sizes_a)[group_b]] = np.where(last_b, self.b.semicolon[b], self.b.comma[b])
        ends = np.cumsum(n_a + n_b)
        digests = [hashlib.sha256(b"".join(shown[low:high])[:-1]).hexdigest() if high > low else ""
                   for low, high in zip((ends - n_a - n_b).tolist(), ends.tolist(), strict=True)]

        low = np.searchsorted(end_b, end_a - self.a.length[a], "right")     # first B token that ends after A starts
        high = np.searchsorted(end_b - self.b.length[b], end_a, "left")     # first that starts where A has ended
        n = high - low
        mate = np.repeat(low - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        pairs = np.repeat(a, n) * len(self.b) + b[mate]
        n_links = np.bincount(np.repeat(text_a, n), minlength=len(texts))
        space = len(self.a) * len(self.b)
        keys, links = np.unique(np.repeat(text_a, n) * space + pairs, return_counts=True)
        return np.stack([n_a, n_b, n_groups, n_links]), digests, keys // space, keys % space, links


@lru_cache(maxsize=2)
def aligner(path_a: str, path_b: str) -> Aligner:
    return Aligner(path_a, path_b)


_ALIGNED = ("block long, key binary, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, "
            "numbers array<int>, links array<int>, pairs array<long>, holders array<long>")


def aligned(texts: DataFrame, path_a: str, path_b: str, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """A row per distinct text of (key, n, text); a block's first row has its dictionary: ``pairs``
    and ``holders``, the number of documents that hold each."""
    schema = pa.schema([("block", pa.int64()), ("key", pa.binary()), ("n_a", pa.int64()), ("n_b", pa.int64()),
                        ("n_groups", pa.int64()), ("n_links", pa.int64()), ("groups_sha256", pa.string()),
                        ("numbers", pa.list_(pa.int32())), ("links", pa.list_(pa.int32())),
                        ("pairs", pa.list_(pa.int64())), ("holders", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        align = aligner(path_a, path_b).align
        part, n_blocks, n_bytes = TaskContext.get().partitionId(), 0, 0
        done: list[tuple] = []
        texts: list[str] = []
        keys: list[bytes] = []
        copies: list[int] = []

        def block() -> Iterator[pa.RecordBatch]:
            measures = np.concatenate([d[0] for d in done], axis=1)
            digests = [x for d in done for x in d[1]]
            shift = np.cumsum([0, *(d[0].shape[1] for d in done)])
            of = np.concatenate([d[2] + s for d, s in zip(done, shift[:-1], strict=True)])
            links = np.concatenate([d[4] for d in done])
            known, numbers = np.unique(np.concatenate([d[3] for d in done]), return_inverse=True)
            holders = np.zeros(len(known), np.int64)
            np.add.at(holders, numbers, np.array(copies, np.int64)[of])
            cuts = pa.array(np.searchsorted(of, np.arange(len(keys) + 1)).astype(np.int32))
            first = pa.array(np.r_[0, np.full(len(keys), len(known))].astype(np.int32))
            only = pa.array(np.arange(len(keys)) > 0)
            rows = pa.RecordBatch.from_arrays([
                pa.array(np.full(len(keys), (part << _BLOCK) + n_blocks)), pa.array(keys, pa.binary()),
                *(pa.array(m) for m in measures), pa.array(digests, pa.string()),
                pa.ListArray.from_arrays(cuts, pa.array(numbers.astype(np.int32))),
                pa.ListArray.from_arrays(cuts, pa.array(links.astype(np.int32))),
                pa.ListArray.from_arrays(first, pa.array(known), mask=only),
                pa.ListArray.from_arrays(first, pa.array(holders), mask=only)], schema=schema)
            for low in range(0, rows.num_rows, 1024):
                yield rows.slice(low, 1024)
            for x in (done, keys, copies):
                x.clear()

        size = 0
        for batch in batches:
            for key, n, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2),
                                    strict=True):
                texts.append(text.as_py())
                keys.append(key)
                copies.append(n)
                size += len(texts[-1].encode())
                if size >= min(BATCH_BYTES, block_bytes):
                    done.append(align(texts))
                    n_bytes, size = n_bytes + size, 0
                    texts.clear()
                    if n_bytes >= block_bytes:
                        yield from block()
                        n_blocks, n_bytes = n_blocks + 1, 0
        if texts:
            done.append(align(texts))
        if done:
            yield from block()

    return texts.select("key", "n", "text").mapInArrow(run, _ALIGNED)


def pair_counts(dictionary: DataFrame, size_b: int) -> DataFrame:
    """(pair, count, best): documents that hold each pair, and whether no pair of its A id has more."""
    counts = written(dictionary.groupBy("pair").agg(F.sum("holders").alias("count")), "pair-counts")
    own = F.floor(F.col("pair") / F.lit(size_b)).alias("a")     # exact: pairs are far below 2**53
    # at most one row for each id of vocabulary A
    highest = F.broadcast(counts.groupBy(own).agg(F.max("count").alias("highest")))
    return counts.withColumn("a", own).join(highest, "a").select(
        "pair", "count", (F.col("count") == F.col("highest")).alias("best"))


def _measured(texts: pa.Table, counted: pa.Table) -> pa.Table:
    count, best = np.zeros(counted.num_rows, np.int64), np.zeros(counted.num_rows, np.int64)
    at = counted["number"].to_numpy()
    count[at], best[at] = counted["count"].to_numpy(), counted["best"].to_numpy()
    texts = texts.combine_chunks()
    numbers, links = (texts[c].combine_chunks().flatten().to_numpy().astype(np.int64) for c in ("numbers", "links"))
    ends = np.cumsum(texts["numbers"].combine_chunks().value_lengths().to_numpy())
    starts = np.append(0, ends[:-1])
    sums = [np.append(0, np.cumsum(links * of[numbers])) for of in (best, count)]
    n_best, count_sum = (s[ends] - s[starts] for s in sums)
    return pa.table([texts["key"], texts["n_a"], texts["n_b"], texts["n_groups"], texts["n_links"], pa.array(n_best),
                     pa.array(count_sum), texts["groups_sha256"]], names=["key", *MEASURES, "groups_sha256"])


def alignment(docs: DataFrame, path_a: str, path_b: str, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of every row."""
    text = text_or_empty()
    key = F.unhex(F.sha2(text, 256))
    distinct = (docs.select(text.alias("text")).where(F.col("text") != "").groupBy("text")
                .agg(F.count("*").alias("n")).select(key.alias("key"), "n", "text"))
    found = written(aligned(distinct, path_a, path_b, block_bytes), "aligned")
    dictionary = found.where(F.col("pairs").isNotNull()).select(
        "block", F.posexplode(F.arrays_zip("pairs", "holders")).alias("number", "_of")).select(
        "block", "number", F.col("_of.pairs").alias("pair"), F.col("_of.holders").alias("holders"))
    counts = pair_counts(dictionary, len(aligner(path_a, path_b).b))
    counted = dictionary.join(counts, "pair").select(F.col("block").alias("of"), "number", "count", "best")
    measures = found.drop("pairs", "holders").groupBy("block").cogroup(counted.groupBy("of")).applyInArrow(
        _measured, "key binary, " + ", ".join(f"{m} long" for m in MEASURES) + ", groups_sha256 string")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), key.alias("key")).join(measures, "key", "left")
    return rows.select("doc_id", *(F.coalesce(m, F.lit(0)).cast("long").alias(m) for m in MEASURES),
                       F.coalesce("groups_sha256", F.lit("")).alias("groups_sha256"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers
    return alignment(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"),
                     public_tokenizers.path("piece_bpe_32k.model"))
