"""Quality classifier: logistic regression on hashed word n-grams, trained by FTRL-proximal.

A word counts with its letters lowered; beside the words stands their shape (case and the symbols around
the letters), and both give unigrams and bigrams.  Bigrams of a word with itself, up to four places
apart, share one feature for each distance.  A score is the sparse dot product of counts, scaled by the
root of their number, with the weights.

Defined results: a null text is empty; an empty text scores by its length feature and the bias alone;
without labels of both classes to learn from every score is the share of class 1, or 0.5; repeated rows
score alike; other columns are ignored; an empty table gives an empty one.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import labelled
from .common import trained_on

BITS, LAGS = 18, 4
#: The bound of the training sample: ids of a class, characters of a text.
PER_CLASS, LONGEST = 4000, 20_000
CACHED = 500_000
_PARTS = re.compile(r"([\W\d_]*)(.*?)([\W\d_]*)", re.DOTALL)


class Words(dict):
    """Word to (word hash, shape hash), packed; bounded."""

    def __missing__(self, raw: bytes) -> int:
        if len(self) >= CACHED:
            self.clear()
        word = raw.decode("utf-8", "replace")
        before, letters, after = _PARTS.fullmatch(word).groups()
        case = "-" if not letters else "U" if len(letters) > 1 and letters.isupper() else "l" if letters.islower() else "T" if letters[1:].islower() or len(letters) == 1 else "m"
        shape = f"{re.sub('[0-9]+', '0', before)[:4]}{case}{re.sub('[0-9]+', '0', after)[:4]}"
        out = zlib.crc32(letters.lower().encode()) << 32 | zlib.crc32(shape.encode())
        if len(raw) <= 64:
            self[raw] = out
        return out


def features(raw: bytes, words: Words) -> np.ndarray:
    """Feature numbers of a text, repeats included."""
    tokens = raw.split()
    n = len(tokens)
    both = np.fromiter(map(words.__getitem__, tokens), np.uint64, n)
    word, shape = both >> np.uint64(32), both & np.uint64(0xFFFFFFFF)
    top = np.uint64(64 - BITS)

    def mixed(x: np.ndarray, salt: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((x + np.uint64(salt)) * np.uint64(0x9E3779B97F4A7C15)) >> top

    with np.errstate(over="ignore"):
        pairs = [x[:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + x[1:] for x in (word, shape)]
    out = [mixed(word, 1 << 33), mixed(shape, 2 << 33), mixed(pairs[0], 3 << 33), mixed(pairs[1], 4 << 33)]
    for lag in range(1, LAGS + 1):
        same = int(np.count_nonzero(word[:-lag] == word[lag:])) if n > lag else 0
        out.append(np.full(same, int(mixed(np.array([lag], np.uint64), 5 << 33)[0]), np.uint64))
    out.append(mixed(np.array([n.bit_length()], np.uint64), 6 << 33))
    return np.concatenate(out).astype(np.int64)


def ftrl(rows: list[tuple[np.ndarray, int]], epochs: int = 3, alpha: float = 0.1, beta: float = 1.0, l1: float = 0.02, l2: float = 1.0, seed: int = 1) -> tuple[np.ndarray, float]:
    """Weights, and the bias, which is regularised like them but kept apart."""
    z, n = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)
    bias = 1 << BITS
    prepared = []
    for found, label in rows:
        at, count = np.unique(found, return_counts=True)
        prepared.append((np.append(at, bias), np.append(count / np.sqrt(len(found)), 1.0), label))
    rng = np.random.default_rng(seed)

    def weights(zs: np.ndarray, ns: np.ndarray) -> np.ndarray:
        return np.where(np.abs(zs) <= l1, 0.0, -(zs - np.sign(zs) * l1) / ((beta + np.sqrt(ns)) / alpha + l2))

    for _ in range(epochs):
        for i in rng.permutation(len(prepared)):
            at, x, label = prepared[i]
            zs, ns = z[at], n[at]
            w = weights(zs, ns)
            g = (1 / (1 + np.exp(-np.clip(w @ x, -30, 30))) - label) * x
            sigma = (np.sqrt(ns + g * g) - np.sqrt(ns)) / alpha
            z[at] = zs + g - sigma * w
            n[at] = ns + g * g
    w = weights(z, n)
    return w[:-1].astype(np.float32), float(w[-1])


class Model:
    """Weights of bounded size, and the odds that the sample's classes have to be moved by."""

    def __init__(self, weights: np.ndarray, bias: float, shift: float):
        self.weights, self.bias, self.shift = weights, bias, shift

    def score(self, raw: bytes, words: Words) -> float:
        found = features(raw, words)
        return float(1 / (1 + np.exp(-np.clip(self.weights[found].sum(dtype=np.float64) / np.sqrt(len(found)) + self.bias + self.shift, -30, 30))))


def fit(rows: list[tuple[str, int]], share: float | None = None) -> Model:
    """``share``: of class 1 among all labels; the sample's own share by default."""
    words = Words()
    ones = sum(y for _, y in rows)
    if not rows or ones in (0, len(rows)):
        p = min(0.999, max(0.001, share if share is not None else ones / len(rows) if rows else 0.5))
        return Model(np.zeros(1 << BITS, np.float32), float(np.log(p / (1 - p))), 0.0)
    weights, bias = ftrl([(features(t.encode(), words), y) for t, y in rows])
    shift = 0.0 if not share or share >= 1 else float(np.log(share / (1 - share)) - np.log(ones / (len(rows) - ones)))
    return Model(weights, bias, shift)


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", per_class: int = PER_CLASS, longest: int = LONGEST) -> Model:
    share = labels.where(trained_on() & F.col(label).isin(0, 1)).agg(F.avg(label)).first()[0]
    return fit(labelled.sample(docs, labels, label, per_class, longest), share)


def score(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, score`` of every row."""
    kind = df.schema[id_col].dataType.simpleString()
    shared = df.sparkSession.sparkContext.broadcast((model.weights, model.bias, model.shift))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, words = Model(*shared.value), _words
        for batch in batches:
            scores = [m.score(x.as_py() or b"", words) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], ["id", "score"])

    out = df.select(df[id_col].alias("id"), df[text_col].cast("string").cast("binary").alias("text")).mapInArrow(run, f"id {kind}, score double")
    return out.withColumnRenamed("id", id_col)


#: Depends on no model, so it serves all tasks of a Python worker.
_words = Words()
