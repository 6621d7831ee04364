"""Toxicity classifier with counterfactual regularisation (operator 10).

Features are words and word beginnings of a text, present or present often.  Their document counts
by label are gathered in Spark over the training rows, and those that tell the classes apart (by
the z value of their log odds) become the model's features.  A logistic model is then fitted with
two terms: the labels' log loss, and for each training text that names a group of people, the
squared change of its score when the group term is swapped for another of its kind.  The second
term keeps weight off neutral mentions of groups, which labelled data often pair with insults.

Training rows are a seeded sample of at most ``TRAIN_ROWS`` labelled documents outside the
held-out fold (crc32 of the id as text, mod 5, is 0); statistics and fit see no others.  Labels,
lang, source and doc_id are never inputs of a score.

Defined results: a null text is an empty text and has the intercept's score; a null doc_id is not
held out, and never trains; null labels do not train; of repeated labels of an id the highest
counts; without training rows of both classes all scores are the share of toxic ones (0 if none).
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import sample, table, text_or_empty, written

TRAIN_ROWS = 20_000
FOLDS = 5
#: Features kept at most, least documents and least |z| of one.
FEATURES, MIN_DOCS, MIN_Z = 20_000, 8, 4.0
#: Lengths of word beginnings, and how many words of a text must share one to count as often.
PREFIXES, OFTEN = (4, 5, 6, 7), (1, 2, 4, 8)
L2, SWAP, STEPS, RATE = 1e-3, 1.0, 300, 0.1
SEED = 5
#: Words whose features a task remembers.
CACHE_WORDS = 500_000

#: Group terms by kind; terms of one kind are swapped for each other.
IDENTITY = (
    ("men", "women"), ("man", "woman"), ("male", "female"), ("boys", "girls"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("black", "white", "asian", "latino", "african", "arab"),
    ("gay", "straight", "lesbian", "bisexual"), ("transgender", "cisgender"),
    ("immigrants", "refugees", "natives", "foreigners"), ("young", "old", "elderly"),
    ("deaf", "blind", "disabled"),
    ("männer", "frauen"), ("muslime", "christen", "juden"), ("ausländer", "flüchtlinge"),
    ("hommes", "femmes"), ("musulmans", "chrétiens", "juifs"), ("immigrés", "réfugiés"),
    ("hombres", "mujeres"), ("musulmanes", "cristianos", "judíos"), ("inmigrantes", "refugiados"),
)
_WORD = re.compile(r"[^\W\d_]+")


def word_features(word: str) -> list[str]:
    return ["=" + word] + [word[:n] for n in PREFIXES if len(word) > n]


def swaps() -> dict[str, str]:
    """Each group term's swap: the next of its kind."""
    return {term: kind[(k + 1) % len(kind)] for kind in IDENTITY for k, term in enumerate(kind)}


def features(words: set[str], of=word_features) -> list[str]:
    """Features of a text with these distinct words: ``feature`` once, ``feature#n`` if n or more
    of the words have it."""
    counts = Counter(f for w in words for f in of(w))
    return [f if n == 1 else f"{f}#{n}" for f, c in counts.items() for n in OFTEN if n <= c]


@dataclass
class Model:
    weights: dict[str, float] = field(default_factory=dict)
    bias: float = 0.0
    known: dict[str, tuple[str, ...]] = field(default_factory=dict, repr=False)

    def __post_init__(self):
        self.stems = {f.partition("#")[0] for f in self.weights}

    def _of(self, word: str) -> tuple[str, ...]:
        found = self.known.get(word)
        if found is None:
            found = tuple(f for f in word_features(word) if f in self.stems)
            if len(self.known) < CACHE_WORDS:
                self.known[word] = found
        return found

    def score(self, text: str) -> float:
        counts = Counter(f for w in set(_WORD.findall(text.lower())) for f in self._of(w))
        margin = self.bias
        for f, c in counts.items():
            margin += self.weights.get(f, 0.0)
            for n in OFTEN[1:]:
                if n <= c:
                    margin += self.weights.get(f"{f}#{n}", 0.0)
        return 1 / (1 + math.exp(-max(-60.0, min(60.0, margin))))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, target: str) -> DataFrame:
    """(text, label) of the sampled labelled rows outside the held-out fold."""
    # clashing columns of either table do not matter: both are cut to what is used
    marked = labels.where(F.col("doc_id").isNotNull() & F.col(target).isNotNull()).groupBy("doc_id").agg(
        F.max(target).alias("label"))
    open_rows = marked.where(~held_out(F.col("doc_id")))
    n = open_rows.count()
    share = 1_000_000 if n <= TRAIN_ROWS else int(TRAIN_ROWS / n * 1_000_000)
    drawn = open_rows.where(F.pmod(F.xxhash64(F.lit(SEED), "doc_id"), F.lit(1_000_000)) < share)
    # about TRAIN_ROWS pairs of numbers, whatever the corpus size; an id that many rows repeat may
    # still bring many texts, of which the sample is cut
    rows = docs.select("doc_id", text_or_empty().alias("text")).join(F.broadcast(drawn), "doc_id").select(
        "text", F.col("label").cast("int").alias("label"), F.xxhash64(F.lit(SEED), "doc_id", "text").alias("draw"))
    rows = written(rows, "toxic-rows")
    return sample(rows, "draw", rows.count(), TRAIN_ROWS).select("text", "label")


def feature_counts(train: DataFrame) -> DataFrame:
    """(feature, toxic, clean): training texts of either label that have the feature."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: tuple[Counter, Counter] = (Counter(), Counter())

        def flush() -> Iterator[pa.RecordBatch]:
            names = sorted(counts[0].keys() | counts[1].keys())
            for low in range(0, len(names), 50_000):
                part = names[low:low + 50_000]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(part, pa.string()), pa.array([counts[1][f] for f in part], pa.int64()),
                     pa.array([counts[0][f] for f in part], pa.int64())], names=["feature", "toxic", "clean"])
            for c in counts:
                c.clear()

        for batch in batches:
            for text, label in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                counts[label != 0].update(features(set(_WORD.findall(text.as_py().lower()))))
                if len(counts[0]) + len(counts[1]) > 400_000:
                    yield from flush()
        yield from flush()

    return train.mapInArrow(run, "feature string, toxic long, clean long").groupBy("feature").agg(
        F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def selected(train: DataFrame, n_toxic: int, n_clean: int) -> list[str]:
    """The features that tell the classes apart: at most FEATURES names reach the driver."""
    a, b = F.col("toxic") + 0.5, F.col("clean") + 0.5
    odds = F.log(a / (F.lit(n_toxic + 1.0) - a)) - F.log(b / (F.lit(n_clean + 1.0) - b))
    spread = F.sqrt(1 / a + 1 / b + 1 / (F.lit(n_toxic + 1.0) - a) + 1 / (F.lit(n_clean + 1.0) - b))
    z = F.abs(odds / spread)
    rows = (feature_counts(train).where((F.col("toxic") + F.col("clean") >= MIN_DOCS) & (z >= MIN_Z))
            .orderBy(z.desc(), "feature").limit(FEATURES).select("feature").collect())
    return [r[0] for r in rows]


def encoded(train: DataFrame, names: list[str]) -> tuple:
    """Training texts as sparse rows: label, feature numbers, and those after the swap of group
    terms (null if the text names no group).  Only these numbers reach the driver."""
    number, swap = {f: k for k, f in enumerate(names)}, swaps()
    stems = {f.partition("#")[0] for f in names}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def of(word: str) -> list[str]:
            return [f for f in word_features(word) if f in stems]

        def numbers(words: set[str]) -> list[int]:
            return sorted(number[f] for f in features(words, of) if f in number)

        for batch in batches:
            own, other = [], []
            for text in batch.column(0):
                words = set(_WORD.findall(text.as_py().lower()))
                own.append(numbers(words))
                other.append(numbers({swap.get(w, w) for w in words}) if words & swap.keys() else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(1), pa.array(own, pa.list_(pa.int32())), pa.array(other, pa.list_(pa.int32()))],
                names=["label", "own", "swapped"])

    rows = train.mapInArrow(run, "label int, own array<int>, swapped array<int>").toArrow()
    return rows["label"].to_numpy(), rows["own"].combine_chunks(), rows["swapped"].combine_chunks()


def fit(labels: np.ndarray, own: pa.ListArray, swapped: pa.ListArray, n: int) -> tuple[np.ndarray, float]:
    """Adam on log loss + L2 + SWAP * mean squared change of the margin under the swap."""
    def sparse(rows: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
        return (np.repeat(np.arange(len(rows), dtype=np.int32), rows.value_lengths().to_numpy()),
                rows.flatten().to_numpy())

    named = swapped.is_valid()
    row, col = sparse(own)
    row_a, col_a = sparse(own.filter(named))
    row_b, col_b = sparse(swapped.filter(named))
    named = np.flatnonzero(named.to_numpy(zero_copy_only=False))
    y = (labels != 0).astype(float)
    w, bias = np.zeros(n), math.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5))
    m, v = np.zeros(n + 1), np.zeros(n + 1)
    for step in range(1, STEPS + 1):
        margin = bias + np.bincount(row, w[col], len(y))
        error = (1 / (1 + np.exp(-np.clip(margin, -60, 60))) - y) / len(y)
        grad = np.bincount(col, error[row], n) + L2 * w / max(1, n) ** 0.5
        if len(named):
            change = (np.bincount(row_a, w[col_a], len(named)) - np.bincount(row_b, w[col_b], len(named))) / len(named)
            grad += SWAP * (np.bincount(col_a, change[row_a], n) - np.bincount(col_b, change[row_b], n))
        whole = np.append(grad, error.sum())
        m, v = 0.9 * m + 0.1 * whole, 0.999 * v + 0.001 * whole**2
        move = RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w, bias = w - move[:-1], bias - move[-1]
    return w, float(bias)


def train_model(docs: DataFrame, labels: DataFrame) -> Model:
    train = written(training_rows(docs, labels, "toxic"), "toxic-train")
    n_toxic, n = train.agg(F.count_if(F.col("label") != 0), F.count("*")).first()
    if not n_toxic or n_toxic == n:
        return Model({}, 60.0 if n_toxic else -60.0)
    names = selected(train, n_toxic, n - n_toxic)
    weights, bias = fit(*encoded(train, names), len(names))
    return Model({f: float(w) for f, w in zip(names, weights, strict=True) if w}, bias)


def with_score(docs: DataFrame, score) -> DataFrame:
    """``docs`` with its columns named c_0, c_1, ... (none clashes) and ``score(text)`` as ``score``;
    the scorer goes to the executors once."""
    shared = docs.sparkSession.sparkContext.broadcast(score)  # a model of bounded size
    at = docs.columns.index("text")
    names = [f"c_{k}" for k in range(len(docs.columns))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            scores = pa.array([own.score(t.as_py() or "") for t in batch.column(at)], pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns, scores], names=[*names, "score"])
        own.known.clear()  # workers outlive the task, and with it the stage

    ddl = ", ".join(f"{n} {f.dataType.simpleString()}" for n, f in zip(names, docs.schema, strict=True))
    return docs.toDF(*names).mapInArrow(run, f"{ddl}, score double")


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row."""
    rows = with_score(docs.select("doc_id", "text"), train_model(docs, labels))
    return rows.select(F.col("c_0").alias("doc_id"), held_out(F.col("c_0")).alias("held_out"), "score",
                       (F.col("score") >= 0.5).cast("int").alias("predicted"))


def clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are not predicted toxic."""
    rows = with_score(docs, train_model(docs, labels)).where(F.col("score") < 0.5)
    return rows.drop("score").toDF(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
