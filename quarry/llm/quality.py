"""Quality classifier from weak labels (operator 2).

1. Overlapping heuristic labellers vote good, bad or abstain on every document.
2. Documents are counted by vote pattern over the whole corpus (at most 3 ** labellers rows), and
   expectation-maximisation estimates the share of good documents and each labeller's accuracies
   (its vote's probabilities given the class) without any true label.
3. The posterior of a document's pattern is its soft label.  A linear scorer is trained on a seeded
   sample of at most ``TRAIN_ROWS`` documents: words, word shapes and word beginnings are hashed into
   ``DIMENSIONS`` weights, a text's margin is the mean over its words.  A word longer than ``PIECE``
   characters counts as its consecutive pieces, so that all of an unbroken text is seen.
4. The scorer scores every whole text; below 0.5 a document is rejected.

Defined results: a null text is an empty text; a text without words scores 0 and is rejected; null
doc_ids and repeated rows are rows like others (a row repeated as a whole is drawn once at most);
extra columns are ignored or carried untouched.
"""

from __future__ import annotations

import math
import operator
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import sample, table, text_or_empty
from quarry.llm.toxicity import with_score

TRAIN_ROWS, DIMENSIONS, STEPS, RATE, L2 = 4_000, 1 << 18, 80, 0.2, 1e-6
EM_ROUNDS, SEED = 200, 3
CACHE_WORDS = 500_000
#: Characters of a word that are hashed as one.
PIECE = 24

#: Frequent function words of the corpus languages.
FUNCTION_WORDS = frozenset((
    "the of and to in a is that for it as was with be by on not he his but at are this have from or had an they "
    "which one you were all we can her has there been if more when will would who so no "
    "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat "
    "daß sie nach wird bei einer um am sind noch wie einem über einen so zum war haben nur oder aber vor zur bis "
    "de la le et les des en un du une que est pour qui dans a par plus pas au sur ne se ce il sont avec ou son lui "
    "el y a los se del las un por con no una su para es al lo como más o pero sus le ha me si sin sobre este "
    "ya entre cuando todo esta ser son dos también fue había era muy").split())
_LETTERS = np.zeros(256, bool)
_LETTERS[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
_SYMBOLS = np.zeros(256, bool)
_SYMBOLS[[ord(c) for c in "#$%&*+/<=>@[\\]^_`{|}~"]] = True


@dataclass
class Facts:
    """What the labellers look at."""
    words: int
    symbols: float      # symbol characters by characters
    bare: float         # words without a letter or digit
    upper: float        # capital letters by ASCII letters
    repeats: float      # words equal to the word before
    distinct: float     # distinct words by words among the first and last of long texts alike
    function: float     # function words
    calls: float        # exclamation marks by words
    length: float       # characters by word


def facts(text: str) -> Facts:
    words = text.split()
    n = max(1, len(words))
    data = np.bincount(np.frombuffer(text.encode(), np.uint8), minlength=256)
    low = text.lower().split()
    upper, lower = int(data[65:91].sum()), int(data[97:123].sum())
    bare = sum(1 for w, c in Counter(words).items() if not any(map(str.isalnum, w)) for _ in range(c))
    chunk = max(1, -(-len(low) // 200))
    distinct = sum(len(set(low[k * 200:(k + 1) * 200])) for k in range(chunk)) / n
    return Facts(len(words), float(data[_SYMBOLS].sum()) / max(1, int(data.sum())), bare / n,
                 upper / max(1, upper + lower), sum(map(operator.eq, low, low[1:])) / n, distinct,
                 sum(map(FUNCTION_WORDS.__contains__, low)) / n, int(data[33]) / n, len(text) / n)


def _band(value: float, good: float, bad: float) -> int:
    """1 on the good side of ``good``, -1 beyond ``bad``, else 0 (abstains)."""
    if good < bad:
        return 1 if value <= good else -1 if value >= bad else 0
    return 1 if value >= good else -1 if value <= bad else 0


#: Each labeller sees one or two facts; they overlap, and none decides alone.
LABELLERS = (
    ("symbols", lambda f: _band(f.symbols, 0.01, 0.05)),
    ("bare_words", lambda f: _band(f.bare, 0.02, 0.15)),
    ("capitals", lambda f: _band(f.upper, 0.2, 0.5)),
    ("calls", lambda f: _band(f.calls, 0.03, 0.3)),
    ("repeats", lambda f: _band(f.repeats, 0.03, 0.2) if f.words >= 8 else 0),
    ("variety", lambda f: _band(f.distinct, 0.45, 0.2) if f.words >= 30 else 0),
    ("function_words", lambda f: _band(f.function, 0.12, 0.03) if f.words >= 20 else 0),
    ("noise", lambda f: _band(f.symbols + f.calls, 0.02, 0.15)),
    ("flow", lambda f: _band(f.function - f.bare - f.repeats, 0.1, -0.05) if f.words >= 20 else 0),
)


def votes(text: str) -> str:
    """One character per labeller: g(ood), b(ad) or -."""
    if not text.strip():
        return "-" * len(LABELLERS)
    f = facts(text)
    return "".join("-gb"[label(f)] for _, label in LABELLERS)


def expectation_maximisation(patterns: dict[str, int]) -> dict[str, float]:
    """Posterior probability of good for every vote pattern.  Most labellers see one kind of flaw and
    vote good on all others, so the start takes two bad votes for a bad document, not a majority."""
    names = sorted(patterns)
    if not names:
        return {}
    count = np.array([patterns[p] for p in names], float)
    seen = np.array([["-gb".index(c) for c in p] for p in names])
    post = np.array([0.9, 0.5, 0.1])[np.minimum((seen == 2).sum(axis=1), 2)]
    for _ in range(EM_ROUNDS):
        odds = math.log((count @ post + 1) / (count @ (1 - post) + 1))
        total = np.full(len(names), odds)
        for k in range(seen.shape[1]):
            in_good = np.bincount(seen[:, k], count * post, 3) + 1.0
            in_bad = np.bincount(seen[:, k], count * (1 - post), 3) + 1.0
            # an abstention says nothing: accuracies are those of the votes given
            ratio = np.log(in_good / in_good[1:].sum()) - np.log(in_bad / in_bad[1:].sum())
            ratio[0] = 0.0
            total += ratio[seen[:, k]]
        new = 1 / (1 + np.exp(-np.clip(total, -60, 60)))
        if np.abs(new - post).max() < 1e-9:
            break
        post = new
    return dict(zip(names, post.tolist(), strict=True))


_RUN = re.compile(r"(.)\1+", re.S)


def pieces(text: str) -> list[str]:
    """The text's words, long ones cut."""
    words = text.split()
    if max(map(len, words), default=0) > PIECE:
        words = [w[k:k + PIECE] for w in words for k in range(0, len(w), PIECE)]
    return words


def hashed(word: str) -> list[int]:
    """The piece's places among the weights: itself, its shape, its beginning and its end."""
    low = word.lower()
    shape = _RUN.sub(r"\1", "".join("x" if c.islower() else "X" if c.isupper() else "9" if c.isdigit() else
                                     "x" if c.isalpha() else c for c in word))
    return [crc32(f.encode()) % (DIMENSIONS - 2) for f in ("w" + low, "s" + shape, "p" + low[:3], "e" + word[-2:])]


#: Places of the two facts that no single word shows.
_REPEAT, _VARIETY = DIMENSIONS - 2, DIMENSIONS - 1


@dataclass
class Scorer:
    weights: np.ndarray
    bias: float
    known: dict[str, float] = field(default_factory=dict, repr=False)

    def _of(self, word: str) -> float:
        value = float(self.weights[hashed(word)].sum())
        if len(self.known) < CACHE_WORDS:
            self.known[word] = value
        return value

    def score(self, text: str) -> float:
        words = pieces(text)
        if not words:
            return 0.0
        known, of = self.known, self._of
        total = sum([known[w] if w in known else of(w) for w in words])
        repeats, variety = shared_facts(words)
        margin = self.bias + total / len(words) + repeats * self.weights[_REPEAT] + variety * self.weights[_VARIETY]
        return 1 / (1 + math.exp(-max(-60.0, min(60.0, margin))))


def shared_facts(words: list[str]) -> tuple[float, float]:
    """Share of words equal to the one before, and of distinct words in stretches of 200."""
    n = len(words)
    return (sum(map(operator.eq, words, words[1:])) / n,
            sum(len(set(words[k:k + 200])) for k in range(0, n, 200)) / n)


def patterns(docs: DataFrame) -> DataFrame:
    """(votes, text, draw) of every row; the texts are pruned where they are not asked for."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = Counter(votes(t.as_py()) for t in batch.column(0))
            yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()),
                                              pa.array(list(counts.values()), pa.int64())], names=["votes", "n"])

    return docs.select(text_or_empty().alias("text")).mapInArrow(run, "votes string, n long").groupBy("votes").agg(
        F.sum("n").alias("n"))


def training_rows(docs: DataFrame, n: int, posterior: dict[str, float]) -> DataFrame:
    """Soft labels and hashed features of the sample: numbers only reach the driver."""
    rows = docs.select(text_or_empty().alias("text"), F.xxhash64(F.lit(SEED), F.col("doc_id"), text_or_empty()).alias("draw"))
    drawn = sample(rows, "draw", n, TRAIN_ROWS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            labels, places, values = [], [], []
            for text in map(pa.StringScalar.as_py, batch.column(0)):
                words = pieces(text)
                if not words:
                    continue
                counts: Counter = Counter()
                for word, c in Counter(words).items():
                    for place in hashed(word):
                        counts[place] += c
                repeats, variety = shared_facts(words)
                labels.append(posterior.get(votes(text), 0.5))
                places.append([*counts, _REPEAT, _VARIETY])
                values.append([c / len(words) for c in counts.values()] + [repeats, variety])
            yield pa.RecordBatch.from_arrays([pa.array(labels, pa.float64()), pa.array(places, pa.list_(pa.int32())),
                                              pa.array(values, pa.list_(pa.float32()))], names=["y", "places", "vals"])

    return drawn.select("text").mapInArrow(run, "y double, places array<int>, vals array<float>")


def fit(rows: pa.Table) -> Scorer:
    """Adam on the soft labels' log loss + L2, over sparse rows."""
    y = rows["y"].to_numpy()
    weights = np.zeros(DIMENSIONS)
    if not len(y):
        return Scorer(weights, 0.0)
    # the order of rows matters only beyond the last digits
    places = rows["places"].combine_chunks()
    row = np.repeat(np.arange(len(y), dtype=np.int32), places.value_lengths().to_numpy())
    col, val = places.flatten().to_numpy(), rows["vals"].combine_chunks().flatten().to_numpy()
    bias = math.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5))
    m, v = np.zeros(DIMENSIONS + 1), np.zeros(DIMENSIONS + 1)
    for step in range(1, STEPS + 1):
        margin = bias + np.bincount(row, weights[col] * val, len(y))
        error = (1 / (1 + np.exp(-np.clip(margin, -60, 60))) - y) / len(y)
        whole = np.append(np.bincount(col, error[row] * val, DIMENSIONS) + L2 * weights, error.sum())
        m, v = 0.9 * m + 0.1 * whole, 0.999 * v + 0.001 * whole**2
        move = RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        weights, bias = weights - move[:-1], bias - move[-1]
    return Scorer(weights.astype(np.float32), float(bias))


def train_scorer(docs: DataFrame) -> Scorer:
    counts = {r[0]: r[1] for r in patterns(docs).collect()}
    posterior = expectation_maximisation(counts)
    return fit(training_rows(docs, sum(counts.values()), posterior).toArrow())


def quality(docs: DataFrame) -> DataFrame:
    """(doc_id, score, predicted) of every row."""
    rows = with_score(docs.select("doc_id", "text"), train_scorer(docs))
    return rows.select(F.col("c_0").alias("doc_id"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def good(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are not rejected."""
    rows = with_score(docs, train_scorer(docs)).where(F.col("score") >= 0.5)
    return rows.drop("score").toDF(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"))
