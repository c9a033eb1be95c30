"""Likeness of predictions and references by matching their tokens' vectors greedily (Zhang et al. 2020).

Each token of one side is matched with its nearest on the other by cosine; precision is the mean over the
prediction's tokens, recall over the reference's, each weighted by inverse document frequency if asked for, and the score
is their harmonic mean.  Any encoder of token lists can be given; a hashed one needs no model.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from demosift.functions import text as T
from demosift.sources.storage import stored

#: Products of two sides' tokens that are held at a time.
PRODUCTS = 1 << 20
#: Rows whose tokens are Python objects at a time, and tokens whose vectors an encoder remembers.
ROWS, REMEMBERED = 64, 20_000
Encoder = Callable[[list[list[str]]], list[np.ndarray]]


def hashed_encoder(width: int = 16) -> Encoder:
    """Vectors from the hexadecimal digits of a token's MD5, moved to be centred; the same token has the same vector."""
    known: dict[str, np.ndarray] = {}

    def vector(token: str) -> np.ndarray:
        if token not in known:
            if len(known) >= REMEMBERED:
                known.clear()
            known[token] = np.array([int(c, 16) - 7.5 for c in hashlib.md5(token.encode()).hexdigest()[:width]])
        return known[token]

    return lambda lists: [np.array([vector(t) for t in tokens]).reshape(len(tokens), width) for tokens in lists]


def _unit(x: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(norm == 0, 1, norm)


def greedy_match(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The largest cosine of every row of ``a`` with one of ``b``, and the other way, in blocks of bounded size."""
    a, b = _unit(a), _unit(b)
    best_a, best_b = np.empty(len(a)), np.full(len(b), -np.inf)
    step = max(1, PRODUCTS // max(1, len(b)))
    for at in range(0, len(a), step):
        product = a[at : at + step] @ b.T
        best_a[at : at + step] = product.max(axis=1)
        best_b = np.maximum(best_b, product.max(axis=0))
    return best_a, best_b


def _harmonic(p: float, r: float) -> float:
    return 2 * p * r / (p + r) if p + r else 0.0


def _mean(values: np.ndarray, weights: list[float]) -> float:
    """Weighted; tokens that all weigh nothing count alike."""
    w = np.asarray(weights)
    return float(values @ w / w.sum()) if w.sum() > 0 else float(values.mean())


def inverse_frequencies(rows: DataFrame, tokens: str = "reference_tokens") -> DataFrame:
    """``token, idf`` over the references: ``ln((n + 1) / (df + 1))``."""
    n = rows.agg(F.count("*").alias("n"))
    df = rows.select(F.explode(F.array_distinct(tokens)).alias("token")).groupBy("token").agg(F.count("*").alias("df"))
    return df.crossJoin(F.broadcast(n)).select("token", F.log((F.col("n") + 1) / (F.col("df") + 1)).alias("idf"))


def _weighted(rows: DataFrame) -> DataFrame:
    """With the weights of both sides' tokens, in their order; a token that no reference has is the rarest."""
    idf = stored(inverse_frequencies(rows), "token-idf")
    rarest = rows.agg(F.log(F.count("*") + 1.0).alias("rarest"))
    out = rows
    for side in ("prediction", "reference"):
        one = rows.select("pair", F.posexplode(f"{side}_tokens").alias("at", "token")).join(idf, "token", "left").crossJoin(F.broadcast(rarest))
        one = one.groupBy("pair").agg(F.array_sort(F.collect_list(F.struct("at", F.coalesce("idf", "rarest").alias("w")))).alias("w"))
        out = out.join(one.select("pair", F.col("w.w").alias(f"{side}_weights")), "pair")
    return out


def scored(df: DataFrame, encoder: Encoder, idf: bool = False, prediction: str = "prediction", reference: str = "reference", tokenize: Callable[[Column | str], Column] = T.bm25_tokens) -> DataFrame:
    """``df`` with ``precision, recall, f1``: null where a side has no token.

    Nothing is shuffled without ``idf``; with it, tokens meet their weight by a join.
    """
    rows = df.select(F.struct(*[F.col(c) for c in df.columns]).alias("row"), F.monotonically_increasing_id().alias("pair"), tokenize(prediction).alias("prediction_tokens"), tokenize(reference).alias("reference_tokens"))
    if idf:
        rows = stored(rows, "token-pairs")
        has = (F.size("prediction_tokens") > 0) & (F.size("reference_tokens") > 0)
        weighted = _weighted(rows.where(has)).select("pair", "prediction_weights", "reference_weights")
        rows = rows.join(weighted, "pair", "left")
    else:
        ones = lambda c: F.transform(c, lambda _: F.lit(1.0))
        rows = rows.withColumns({f"{s}_weights": ones(F.col(f"{s}_tokens")) for s in ("prediction", "reference")})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (whole.slice(at, ROWS) for whole in batches for at in range(0, whole.num_rows, ROWS)):
            out: list[tuple[float | None, float | None, float | None]] = []
            for p, r, wp, wr in zip(*(batch.column(i).to_pylist() for i in range(1, 5)), strict=True):
                if not p or not r:
                    out.append((None, None, None))
                    continue
                best_p, best_r = greedy_match(*encoder([p, r]))
                precision, recall = _mean(best_p, wp), _mean(best_r, wr)
                out.append((precision, recall, _harmonic(precision, recall)))
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array([o[i] for o in out], pa.float64()) for i in range(3)]], ["row", "precision", "recall", "f1"])

    kind = rows.schema["row"].dataType.simpleString()
    found = rows.select("row", "prediction_tokens", "reference_tokens", "prediction_weights", "reference_weights").mapInArrow(run, f"row {kind}, precision double, recall double, f1 double")
    return found.select("row.*", "precision", "recall", "f1")
