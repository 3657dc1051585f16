"""Toxicity by multiple-instance learning: a document is a bag of sentences.

A sentence's score is a logistic function of its words and of how they begin; a document's is the noisy-or of its sentences, one minus
the chance that none offends. Only documents have labels, so the likelihood of the documents trains the sentences,
and the sentences then say where the offence is.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import remainder, texts
from .sampling import labelled

#: The training sample: so many ids of each label at most, and texts of at most so many characters.
TRAIN_PER_LABEL, TRAIN_CHARS = 2500, 20_000
#: Features are words and, for word families, their first letters, in so many numbers. Those count that are in
#: MIN_TEXTS training texts at least, the most telling of them.
PREFIXES, MIN_TEXTS, MAX_FEATURES = range(3, 9), 5, 6000
STEPS, RATE, RIDGE = 300, 0.1, 0.05
#: Words whose sum a worker keeps, up to so many letters.
CACHE_WORDS, CACHE_CHARS = 300_000, 40
THRESHOLD, OFFENDS = 0.7, 0.5
SCHEMA = (
    "doc_id long, score double, predicted int, "
    "offending array<struct<start: int, end: int, score: double>>"
)
SENTENCE = re.compile(r"[^.!?\n]+[.!?]*|[.!?]+")
WORD = re.compile(r"[^\W\d_]+")


@dataclass(frozen=True)
class Model:
    """slope and shift calibrate the log odds of a document's noisy-or."""

    bias: float
    weights: dict[str, float]
    slope: float = 1.0
    shift: float = 0.0


def sentences(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in SENTENCE.finditer(text) if not m[0].isspace()]


def words(sentence: str) -> set[str]:
    return set(WORD.findall(sentence.lower()))


def features(word: str) -> list[str]:
    """A word, and its beginnings marked by a star."""
    return [word, *(word[:n] + "*" for n in PREFIXES if n < len(word))]


class WordSums(dict):
    """The sum of the weights of each word's features."""

    def __init__(self, weights: dict[str, float]):
        super().__init__()
        self.weights = weights

    def __missing__(self, word: str) -> float:
        total = math.fsum(self.weights[f] for f in features(word) if f in self.weights)
        if len(word) <= CACHE_CHARS:
            if len(self) >= CACHE_WORDS:
                self.clear()
            self[word] = total
        return total


def softplus(z: float) -> float:
    return z + math.log1p(math.exp(-z)) if z > 0 else math.log1p(math.exp(z))


def fit(sample: list[tuple[str, int]]) -> Model:
    """Trains on (text, label) rows by Adam on the ridge-penalised noisy-or likelihood."""
    bags = [[words(text[a:b]) for a, b in sentences(text)] or [set()] for text, _ in sample]
    y = np.array([int(label) for _, label in sample], bool)
    if not y.any() or y.all():
        share = (y.sum() + 0.5) / (len(y) + 1)
        return Model(-30.0, {}, 0.0, math.log(share / (1 - share)))  # nothing to learn: the same score for all
    counts = [Counter(), Counter()]
    for bag, label in zip(bags, y):
        counts[int(label)].update({f for word in set().union(*bag) for f in features(word)})
    n1, n0 = y.sum(), (~y).sum()
    telling = {}
    for feature in counts[0].keys() | counts[1].keys():
        a, b = counts[1][feature], counts[0][feature]
        if a + b >= MIN_TEXTS:
            p, q = (a + 0.5) / (n1 + 1), (b + 0.5) / (n0 + 1)
            telling[feature] = abs(math.log(p / q)) * math.sqrt(a + b)
    vocabulary = {f: i for i, f in enumerate(sorted(telling, key=lambda f: (-telling[f], f))[:MAX_FEATURES])}
    known: dict[str, list[int]] = {}
    row, column, owner = [], [], []
    for d, bag in enumerate(bags):
        for sentence in bag:
            for word in sentence:
                if (found := known.get(word)) is None:
                    found = known[word] = [vocabulary[f] for f in features(word) if f in vocabulary]
                row += [len(owner)] * len(found)
                column += found
            owner.append(d)
    row, column, owner = np.array(row, np.int32), np.array(column, np.int32), np.array(owner, np.int32)
    theta = np.zeros(len(vocabulary) + 1)
    theta[-1] = -6.0
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    weight = np.where(y, n0 / n1, 1.0) ** 0.5 / len(y)
    for step in range(1, STEPS + 1):
        gradient = loss(theta, row, column, owner, y, weight)[1]
        m, v = 0.9 * m + 0.1 * gradient, 0.999 * v + 0.001 * gradient**2
        theta -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-10)
    z = np.bincount(row, theta[column], len(owner)) + theta[-1]
    slope, shift = calibrate(np.bincount(owner, np.logaddexp(0, z), len(y)), y)
    return Model(float(theta[-1]), {f: float(theta[i]) for f, i in vocabulary.items()}, slope, shift)


def loss(theta: np.ndarray, row: np.ndarray, column: np.ndarray, owner: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, np.ndarray]:
    """The weighted noisy-or loss with its penalty, and its gradient. theta: weights of features and the bias; row and
    column: which sentence has which feature; owner: the document of each sentence."""
    z = np.clip(np.bincount(row, theta[column], len(owner)) + theta[-1], -40, 40)
    quiet = np.bincount(owner, np.logaddexp(0, z), len(y))  # minus the log chance that nothing offends
    bounded = np.clip(quiet, 1e-9, 500)
    total = np.where(y, -np.log(-np.expm1(-bounded)), quiet) @ weight + RIDGE / len(y) / 2 * theta[:-1] @ theta[:-1]
    slope = (np.where(y, -1 / np.expm1(bounded), 1.0) * weight)[owner] / (1 + np.exp(-z))
    gradient = np.append(np.bincount(column, slope[row], len(theta) - 1), slope.sum())
    gradient[:-1] += RIDGE / len(y) * theta[:-1]
    return float(total), gradient


def log_odds(quiet):
    """Of a noisy-or, from minus the log chance that nothing offends."""
    return np.clip(np.log(np.expm1(np.clip(quiet, 1e-9, 12))), -12, 12)


def calibrate(quiet: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Logistic regression of the labels on the log odds, by Newton's method with a small penalty."""
    x = np.stack([log_odds(quiet), np.ones(len(y))], 1)
    theta = np.array([1.0, 0.0])
    for _ in range(30):
        p = 1 / (1 + np.exp(-x @ theta))
        gradient = x.T @ (p - y) + 0.1 * (theta - [1.0, 0.0])
        theta = theta - np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(2), gradient)
    return max(0.1, float(theta[0])), float(theta[1])


def score(model: Model, sums: WordSums, text: str) -> tuple[float, list[tuple[int, int, float]]]:
    """A text's noisy-or score and its offending sentences."""
    quiet, found = 0.0, []
    lowered = text.lower()
    if len(lowered) != len(text):  # lower-casing that changes lengths would move the places
        lowered = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    for start, end in sentences(lowered) or [(0, 0)]:  # an empty text counts as one sentence without words
        z = model.bias + sum(map(sums.__getitem__, sorted(set(WORD.findall(lowered, start, end)))))
        quiet += softplus(z)
        if z > math.log(OFFENDS / (1 - OFFENDS)):
            found.append((start, end, 1 / (1 + math.exp(-z))))
    return float(1 / (1 + np.exp(-(model.slope * log_odds(quiet) + model.shift)))), found


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """Fits on at most TRAIN_PER_LABEL ids of each label. docs: doc_id, text; labels: doc_id, label (0 or 1)."""
    return fit(labelled(docs, labels, TRAIN_PER_LABEL, 2 * TRAIN_PER_LABEL, TRAIN_CHARS))


def toxicity(docs: DataFrame, model: Model, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """SCHEMA of every whole text: its score, whether it reaches the threshold, its offending sentences (code points).

    Null and empty texts count as one sentence without words. Null and repeated ids pass through, equal texts get
    equal scores, an empty table gives an empty one, other columns are ignored. One narrow pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))
        sums = WordSums(model.weights)
        for batch in batches:
            rows = [score(model, sums, text.as_py() or "") for text in batch.column(1)]
            scores = [r[0] for r in rows]
            found = [[{"start": a, "end": b, "score": s} for a, b, s in r[1]] for r in rows]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(scores, pa.float64()), pa.array([int(s >= threshold) for s in scores], pa.int32()), pa.array(found, kind)],
                names=["doc_id", "score", "predicted", "offending"],
            )

    return texts(docs, id_col, text_col).mapInArrow(run, SCHEMA)


def query(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """Learns from the labelled rows whose remainder of the id's crc32 by 3 is not 1, and scores every document."""
    known = labels.select(F.col("doc_id").cast("long"), F.col("toxic").cast("int").alias("label")).where(remainder("doc_id", 3) != 1)
    model = train(texts(documents), known)
    held = F.coalesce(remainder("doc_id", 3) == 1, F.lit(False))
    return toxicity(documents, model).select("doc_id", held.alias("held_out"), "score", "predicted", "offending")
