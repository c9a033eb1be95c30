"""Toxic spans by a linear-chain conditional random field.

Tokens are words; the two states are clean and toxic.  Emission scores come from hashed features of a
word (its letters, lowered, and their beginnings), transition scores from the state before.  Documents
carry labels but words do not, so the tokens that training sees are labelled from the sample: in a toxic
document, words one of whose features is much more frequent in toxic documents than in clean ones.

Forward-backward gives each word's probability of being toxic, in steps over all documents of a batch at
once.  With two states a message is one log odds, so a step is a few vector operations.  The
probabilities are summed up to a document's score by a small logistic regression, and words above one
half are reported with their offsets.

Defined results: a null text is empty; an empty text has no words and scores by the bias; without labels
of both classes every score is the share of class 1, or 0.5; repeated rows score alike; other columns
are ignored (``drop_toxic`` passes them through); an empty table gives an empty one.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import labelled
from .common import WORD, trained_on

BITS, BEGINNINGS = 18, (4, 5, 6)
#: The bound of the training sample: ids of a class, characters of a text.
PER_CLASS, LONGEST = 2000, 12_000
#: A feature marks tokens if so many toxic documents have it, and so many times the share of clean ones.
LEAST_DOCS, TIMES = 4, 6.0
CACHED = 300_000
#: Bytes and rows of texts that are scored together; one longer text goes alone.
SLICE, ROWS = 4 << 20, 2048
_EDGE = re.compile(r"^[\W\d_]+|[\W\d_]+$")


def word_features(raw: bytes) -> tuple[int, ...]:
    letters = _EDGE.sub("", raw.decode("utf-8", "replace")).lower()
    if not letters:
        return ()
    keys = [f"w:{letters}", *(f"{n}:{letters[:n]}" for n in BEGINNINGS if len(letters) >= n)]
    return tuple(zlib.crc32(k.encode()) >> (32 - BITS) for k in keys)


class Lattice:
    """Documents of a batch, longest first, step by step: at each step those that still have words."""

    def __init__(self, lengths: np.ndarray):
        order = np.argsort(-lengths, kind="stable")
        rank = np.empty_like(order)
        rank[order] = np.arange(len(order))
        longest = int(lengths.max(initial=0))
        self.active = len(lengths) - np.searchsorted(np.sort(lengths), np.arange(longest), side="right")
        self.offsets = np.concatenate([[0], np.cumsum(self.active)])
        doc = np.repeat(np.arange(len(lengths)), lengths)
        step = np.arange(len(doc)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        self.at = self.offsets[step] + rank[doc]
        self.doc = doc

    def messages(self, emission: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Emissions in step order, and forward and backward log odds; t: scores clean-toxic, toxic-clean, toxic-toxic."""
        e = np.empty_like(emission)
        e[self.at] = emission
        forward, backward = e.copy(), np.zeros_like(e)
        o, n = self.offsets, self.active
        for s in range(1, len(n)):
            a = forward[o[s - 1] : o[s - 1] + n[s]]
            forward[o[s] : o[s + 1]] += np.logaddexp(t[0], t[2] + a) - np.logaddexp(0, t[1] + a)
        for s in range(len(n) - 2, -1, -1):
            u = e[o[s + 1] : o[s + 2]] + backward[o[s + 1] : o[s + 2]]
            backward[o[s] : o[s] + n[s + 1]] = np.logaddexp(t[1], t[2] + u) - np.logaddexp(0, t[0] + u)
        return e, forward, backward

    def marginals(self, emission: np.ndarray, t: np.ndarray) -> np.ndarray:
        """Probability of the toxic state of each word, in the order given."""
        _, forward, backward = self.messages(emission, t)
        return _sigmoid((forward + backward)[self.at])

    def pairs(self, e: np.ndarray, forward: np.ndarray, backward: np.ndarray, t: np.ndarray) -> np.ndarray:
        """Expected numbers of the transitions clean-toxic, toxic-clean, toxic-toxic."""
        o, n = self.offsets, self.active
        if len(n) < 2:
            return np.zeros(3)
        out, own = np.zeros(3), np.zeros(3)
        for s in range(1, len(n)):
            a, u = forward[o[s - 1] : o[s - 1] + n[s]], e[o[s] : o[s + 1]] + backward[o[s] : o[s + 1]]
            top = np.maximum(np.maximum(0, t[0] + u), np.maximum(t[1] + a, t[2] + a + u))
            p = [np.exp(x - top) for x in (t[0] + u, t[1] + a, t[2] + a + u)]
            total = np.exp(-top) + p[0] + p[1] + p[2]
            own[:] = [np.sum(x / total) for x in p]
            out += own
        return out

    def moved(self, labels: np.ndarray) -> np.ndarray:
        y = np.empty_like(labels)
        y[self.at] = labels
        o, n = self.offsets, self.active
        left = np.concatenate([y[o[s - 1] : o[s - 1] + n[s]] for s in range(1, len(n))] or [y[:0]])
        right = y[o[1] :] if len(n) > 1 else y[:0]
        return np.array([np.sum((left == 0) & (right == 1)), np.sum((left == 1) & (right == 0)), np.sum((left == 1) & (right == 1))], float)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


class Model:
    def __init__(self, weights: np.ndarray, bias: float, transitions: np.ndarray, outer: np.ndarray, scale: np.ndarray):
        self.weights, self.bias, self.transitions, self.outer, self.scale = weights, bias, transitions, outer, scale

    def parts(self) -> tuple:
        return self.weights, self.bias, self.transitions, self.outer, self.scale

    def emission(self, raw: bytes) -> float:
        found = word_features(raw)
        return self.bias + float(self.weights[list(found)].sum()) if found else self.bias

    def score(self, lengths: np.ndarray, emission: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Document scores and word marginals of a batch."""
        p = Lattice(lengths).marginals(emission, self.transitions)
        return _sigmoid(summary(lengths, p) / self.scale @ self.outer), p


def summary(lengths: np.ndarray, p: np.ndarray) -> np.ndarray:
    """What a document's score is computed from: sums of marginals, the largest, and one."""
    doc = np.repeat(np.arange(len(lengths)), lengths)
    total = np.bincount(doc, p, len(lengths))
    most = np.zeros(len(lengths))
    np.maximum.at(most, doc, p)
    return np.stack([np.log1p(total), most, np.minimum(total, 1.5), total / np.sqrt(np.maximum(lengths, 1)), np.ones(len(lengths))], axis=1)


class Emissions(dict):
    """Word to emission score; bounded."""

    def __init__(self, model: Model):
        super().__init__()
        self.model = model

    def __missing__(self, raw: bytes) -> float:
        if len(self) >= CACHED:
            self.clear()
        out = self.model.emission(raw)
        if len(raw) <= 64:
            self[raw] = out
        return out


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, steps: int = 25, l2: float = 1e-2) -> np.ndarray:
    """Newton's method; few columns."""
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = _sigmoid(x @ w)
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + l2 * np.eye(len(w))
        w -= np.linalg.solve(h, x.T @ (weight * (p - y)) + l2 * w)
    return w


def fit(rows: list[tuple[str, int]], share: float | None = None, steps: int = 40, rate: float = 0.5, l2: float = 1e-3) -> Model:
    """``share``: of toxic ones among all labels; the sample's own share by default."""
    n, ones = len(rows), sum(y for _, y in rows)
    if not n or ones in (0, n):
        p = min(0.999, max(0.001, share if share is not None else ones / n if n else 0.5))
        return Model(np.zeros(1 << BITS), -5.0, np.zeros(3), np.array([0, 0, 0, 0, np.log(p / (1 - p))]), np.ones(5))
    words: dict[bytes, int] = {}
    of, lengths, y = [], np.zeros(n, np.int64), np.array([y for _, y in rows])
    for i, (text, _) in enumerate(rows):
        at = [words.setdefault(w, len(words)) for w in text.encode().split()]
        of.append(np.array(at, np.int32))
        lengths[i] = len(at)
    # words and their features as flat arrays: one entry for each pair
    per_word, flat = array("i"), array("i")
    for w in words:
        features = word_features(w)
        per_word.append(len(features))
        flat.extend(features)
    many, col = np.frombuffer(per_word, np.int32) if words else np.zeros(0, np.int32), np.frombuffer(flat, np.int32) if flat else np.zeros(0, np.int32)
    row, begin = np.repeat(np.arange(len(words), dtype=np.int32), many), np.cumsum(many) - many
    counts = np.zeros((2, 1 << BITS), np.int32)
    for at, label in zip(of, y, strict=True):
        own = np.unique(at)
        if len(own):
            spread = np.repeat(begin[own], many[own]) + np.arange(many[own].sum()) - np.repeat(np.cumsum(many[own]) - many[own], many[own])
            counts[label, np.unique(col[spread])] += 1
    telling = (counts[1] >= LEAST_DOCS) & (counts[1] / ones >= TIMES * (counts[0] + 0.5) / (n - ones + 1))
    marked = np.bincount(row, telling[col], len(words)) > 0
    token = np.concatenate(of) if of else np.zeros(0, np.int32)
    lattice = Lattice(lengths)
    labels = (marked[token] & (y[lattice.doc] == 1)).astype(np.int64)
    weights, bias, t = np.zeros(1 << BITS), -4.0, np.zeros(3)
    seen_w, seen_b, seen_t = np.full(1 << BITS, 1e-8), 1e-8, np.full(3, 1e-8)
    wanted, moved = np.bincount(token, labels, len(words)), lattice.moved(labels)
    for _ in range(steps):
        emission = (bias + np.bincount(row, weights[col], len(words)))[token]
        e, forward, backward = lattice.messages(emission, t)
        p = _sigmoid((forward + backward)[lattice.at])
        miss = wanted - np.bincount(token, p, len(words))
        gw = np.bincount(col, miss[row], 1 << BITS) - l2 * weights * n
        gb, gt = miss.sum(), moved - lattice.pairs(e, forward, backward, t) - l2 * t * n
        seen_w += gw * gw
        seen_b += gb * gb
        seen_t += gt * gt
        weights += rate * gw / np.sqrt(seen_w)
        bias += rate * gb / np.sqrt(seen_b)
        t = t + rate * gt / np.sqrt(seen_t)
    model = Model(weights.astype(np.float32), float(bias), t, np.zeros(5), np.ones(5))
    cache = Emissions(model)
    p = lattice.marginals(np.array([cache[w] for w in words])[token], t)
    x = summary(lengths, p)
    share = share if share and share < 1 else ones / n
    weight = np.where(y == 1, share / (ones / n), (1 - share) / (1 - ones / n))
    model.scale = np.maximum(np.abs(x).max(axis=0), 1e-9)
    model.outer = _logistic(x / model.scale, y, weight)
    return model


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", per_class: int = PER_CLASS, longest: int = LONGEST) -> Model:
    share = labels.where(trained_on() & F.col(label).isin(0, 1)).agg(F.avg(label)).first()[0]
    return fit(labelled.sample(docs, labels, label, per_class, longest), share)


def score(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", spans: bool = True) -> DataFrame:
    """``id, score, spans`` of every row: spans of toxic words in code points, with their probability."""
    kind = df.schema[id_col].dataType.simpleString()
    shared = df.sparkSession.sparkContext.broadcast(model.parts())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Model(*shared.value)
        cache = Emissions(m)
        for batch in batches:
            for part in _slices(batch, 1):
                yield _scored(part, m, cache, spans)

    rows = df.select(df[id_col].alias("id"), df[text_col].cast("string").cast("binary").alias("text"))
    out = rows.mapInArrow(run, f"id {kind}, score double, spans array<struct<start:int,end:int,p:double>>")
    return out.withColumnRenamed("id", id_col)


def _slices(batch: pa.RecordBatch, at: int) -> Iterator[pa.RecordBatch]:
    """Rows of few bytes of text (in that column), so that a lattice stays small however long texts are."""
    sizes = pc.fill_null(pc.binary_length(batch.column(at)), 0).to_numpy(zero_copy_only=False)
    begin = 0
    while begin < batch.num_rows:
        n = max(1, int(np.searchsorted(np.cumsum(sizes[begin : begin + ROWS]), SLICE, side="right")))
        yield batch.slice(begin, n)
        begin += n


_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("p", pa.float64())]))
_WORD = re.compile(WORD)


def _scored(batch: pa.RecordBatch, m: Model, cache: Emissions, spans: bool) -> pa.RecordBatch:
    parts = []
    for x in batch.column(1):
        words = (x.as_py() or b"").split()
        parts.append(np.fromiter(map(cache.__getitem__, words), np.float64, len(words)))
    lengths = np.array([len(x) for x in parts], np.int64)
    scores, p = m.score(lengths, np.concatenate(parts) if parts else np.zeros(0))
    ends = np.cumsum(lengths)
    told: list[list[dict]] = [[] for _ in parts]
    if spans:
        hits = np.flatnonzero(p >= 0.5)
        docs = np.searchsorted(ends, hits, side="right")
        for d in np.unique(docs):
            of = {int(h - ends[d] + lengths[d]): float(p[h]) for h in hits[docs == d]}
            text = batch.column(1)[int(d)].as_py().decode("utf-8", "replace")
            told[d] = [{"start": w.start(), "end": w.end(), "p": of[i]} for i, w in enumerate(_WORD.finditer(text)) if i in of]
    return pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores), pa.array(told, _SPANS)], ["id", "score", "spans"])


def drop_toxic(df: DataFrame, model: Model, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``df`` whose score stays below the threshold; the score is computed in place, without a join."""
    types = df.schema
    shared = df.sparkSession.sparkContext.broadcast(model.parts())
    at = df.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Model(*shared.value)
        cache = Emissions(m)
        for batch in batches:
            for part in _slices(batch, at):
                texts = part.column(at).cast(pa.binary())
                found = _scored(pa.RecordBatch.from_arrays([texts, texts], ["id", "text"]), m, cache, False)
                yield part.filter(pa.array(found.column(1).to_numpy() < threshold))

    return df.mapInArrow(run, types)
