"""Language identification by string kernels: blended-spectrum presence kernels, Nyström landmarks, kernel ridge.

A text is the set of its byte n-grams of lengths 1 to ORDER after lower-casing, with everything but letters as
blanks. The kernel of two texts is the number of n-grams that both have, over the root of the product of their own
numbers. A few training texts are landmarks: kernel values against them, whitened, are the Nyström features, and a
ridge regression for each language against the rest is solved on these. Scoring is two products of matrices a batch.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keep_rows, remainder, texts
from .sampling import labelled

ORDER = 3
#: The training sample: so many ids of each language, so many in all, texts of at most so many characters.
TRAIN_PER_LANGUAGE, TRAIN_MOST, TRAIN_CHARS = 400, 6000, 20_000
#: n-grams that the kernel sees: in MIN_TEXTS training texts at least, the commonest of them. Landmarks; penalty.
MIN_TEXTS, GRAMS, LANDMARKS, RIDGE = 3, 16_383, 96, 0.01
BATCH, PART = 256, 1 << 20
#: A text of the language predicted for it has at least this share of n-grams, each as often as it comes, that texts of
#: that language have.
LEAST_SEEN = 0.7
UNKNOWN = "und"
LETTER_OR_NUMERAL = re.compile(r"[^\W\d_]")
#: ASCII that is not a letter becomes a blank; bytes of other characters stay.
BLANKS = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256))
SCHEMA = "doc_id long, lang_pred string, score double"


@dataclass
class Model:
    languages: list[str]
    grams: np.ndarray  # codes of the n-grams seen, ascending
    landmarks: np.ndarray  # (n-gram, landmark): presence over the root of the landmark's size
    weights: np.ndarray  # (landmark, language)
    known: np.ndarray  # (n-gram from 1, language): whether training texts of the language have it

    def table(self) -> np.ndarray:
        """The column of each n-gram code, from 1; 0 for those not seen."""
        table = np.zeros((ORDER - 1 << 24) + (1 << 24), np.int16)
        table[self.grams] = np.arange(1, len(self.grams) + 1)
        return table


def has_letter(text: str) -> bool:
    """Whether a character is of a Unicode category for letters; numerals such as fractions and Roman ones are not."""
    return any(m[0].isalpha() for m in LETTER_OR_NUMERAL.finditer(text))


def codes(text: str) -> Iterator[np.ndarray]:
    """The codes of all n-grams of a text, part by part: length - 1 in the high bits, the bytes below."""
    data = np.frombuffer(text.lower().encode("utf-8", "surrogatepass").translate(BLANKS), np.uint8)
    for at in range(0, len(data), PART):
        part = data[at : at + PART + ORDER - 1].astype(np.int32)
        code = part[:PART]
        yield code
        for n in range(1, ORDER):
            code = (code[: len(part) - n] << 8) | part[n : n + len(code)]
            yield code + (n << 24)


def presence(batch: list[str], table: np.ndarray, grams: int) -> np.ndarray:
    """(text, n-gram): 1 where the text has it."""
    out = np.zeros((len(batch), grams + 1), np.float32)
    for i, text in enumerate(batch):
        for code in codes(text):
            out[i, table.take(code)] = 1
    return out[:, 1:]


def seen_share(text: str, table: np.ndarray, known: np.ndarray) -> float:
    """The share of a text's n-grams, each as often as it comes, that are known: one boolean for each column, from 1."""
    seen = total = 0
    for code in codes(text):
        seen += np.count_nonzero(known.take(table.take(code)))
        total += len(code)
    return seen / max(1, total)


def normalised(batch: list[str], table: np.ndarray, grams: int) -> np.ndarray:
    x = presence(batch, table, grams)
    return x / np.maximum(1, np.sqrt(x.sum(1, keepdims=True)))


def fit(sample: list[tuple[str, str]]) -> Model | None:
    """Trains on (text, language) rows; None if no text has a letter."""
    sample = [(text, language) for text, language in sample if has_letter(text)]
    if not sample:
        return None
    languages = sorted({language for _, language in sample})
    counts = [Counter() for _ in languages]
    for text, language in sample:
        counts[languages.index(language)].update(np.unique(np.concatenate(list(codes(text)))).tolist())
    total = sum(counts, Counter())
    seen = [c for c, n in total.items() if n >= min(MIN_TEXTS, len(sample))]
    grams = np.array(sorted(sorted(seen, key=lambda c: (-total[c], c))[:GRAMS]), np.int64)
    known = np.zeros((len(grams) + 1, len(languages)), bool)
    for k, found in enumerate(counts):
        known[1:, k] = [found[c] >= min(MIN_TEXTS, len(sample)) for c in grams.tolist()]
    model = Model(languages, grams, np.zeros((0, 0)), np.zeros((0, 0)), known)
    texts_, table = [text for text, _ in sample], model.table()
    y = np.where(np.array([language for _, language in sample])[:, None] == np.array(languages), 1.0, -1.0)
    chosen: list[int] = []  # landmarks from each language in turn
    by = [np.flatnonzero(y[:, k] > 0).tolist() for k in range(len(languages))]
    for i in range(max(map(len, by))):
        chosen += [rows[i] for rows in by if i < len(rows)]
    landmarks = normalised([texts_[i] for i in chosen[:LANDMARKS]], table, len(grams)).T
    values, vectors = np.linalg.eigh((landmarks.T @ landmarks).astype(np.float64))
    whiten = vectors[:, values > 1e-6] / np.sqrt(values[values > 1e-6])
    kernel = [normalised(texts_[at : at + BATCH], table, len(grams)) @ landmarks for at in range(0, len(texts_), BATCH)]
    z = np.concatenate(kernel).astype(np.float64) @ whiten
    balance = 1 / np.maximum(1, (y > 0).sum(0))[np.argmax(y, 1)]
    balance *= len(y) / balance.sum()
    weights = np.linalg.solve((z * balance[:, None]).T @ z + RIDGE * len(y) * np.eye(z.shape[1]), (z * balance[:, None]).T @ y)
    model.landmarks, model.weights = np.ascontiguousarray(landmarks, np.float32), (whiten @ weights).astype(np.float32)
    return model


def predict(model: Model, batch: list[str], table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The number of the language of each text, and its score from 0 to 1."""
    x = presence(batch, table, len(model.grams))
    size = np.sqrt(np.maximum(1, x.sum(1, keepdims=True)))
    values = (x @ model.landmarks / size) @ model.weights
    best = values.argmax(1)
    return best, np.clip((values[np.arange(len(best)), best] + 1) / 2, 0, 1)


def train(docs: DataFrame, labels: DataFrame) -> Model | None:
    """Fits on a bounded sample. docs: doc_id, text; labels: doc_id, label (the language)."""
    return fit(labelled(docs, labels, TRAIN_PER_LANGUAGE, TRAIN_MOST, TRAIN_CHARS))


def identify(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """SCHEMA of every whole text.

    A null text, a text without letters, and every text if there was nothing to learn from get UNKNOWN and score 0.
    Ties go to the language first by name. Null and repeated ids pass through, an empty table gives an empty one,
    other columns are ignored. Long texts are read in parts, whole. One narrow pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = model.table() if model else None
        for whole in batches:
            for at in range(0, len(whole), BATCH):
                batch = whole.slice(at, BATCH)
                found = [t.as_py() or "" for t in batch.column(1)]
                known = [i for i, t in enumerate(found) if model and has_letter(t)]
                names, scores = [UNKNOWN] * len(found), [0.0] * len(found)
                if known:
                    best, score = predict(model, [found[i] for i in known], table)
                    for i, b, s in zip(known, best, score):
                        names[i], scores[i] = model.languages[b], float(s)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "lang_pred", "score"]
                )

    return texts(docs, id_col, text_col).mapInArrow(run, SCHEMA)


def recognised(docs: DataFrame, model: Model | None, text_col: str = "text") -> DataFrame:
    """The rows of docs in which a learned language is recognised, with all their columns: identify() names a language
    other than UNKNOWN, and at least LEAST_SEEN of the text's n-grams are known of that language. Scores alone do not
    tell a text of another language, as few n-grams of it take part. With nothing learned, no row is recognised."""

    def judge():
        table = model.table() if model else None

        def names(found: list[str]) -> list[bool]:
            out = [False] * len(found)
            asked = [i for i, t in enumerate(found) if model and has_letter(t)]
            for at in range(0, len(asked), BATCH):
                batch = asked[at : at + BATCH]
                for i, best in zip(batch, predict(model, [found[i] for i in batch], table)[0]):
                    out[i] = model.languages[best] != UNKNOWN and seen_share(found[i], table, model.known[:, best]) >= LEAST_SEEN
            return out

        return names

    return keep_rows(docs, judge, text_col)


def learn(documents: DataFrame) -> Model | None:
    """Learns from the documents with a language whose remainder of the id's crc32 by 4 is not 2."""
    known = documents.select(F.col("doc_id").cast("long"), F.col("lang").cast("string").alias("label")).where(remainder("doc_id", 4) != 2)
    return train(texts(documents), known)


def query(documents: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every document, learned as learn() does; identify() states the odd cases.
    A null id is learned from never and is not held out."""
    held = F.coalesce(remainder("doc_id", 4) == 2, F.lit(False))
    return identify(documents, learn(documents)).select("doc_id", held.alias("held_out"), "lang_pred", "score")
