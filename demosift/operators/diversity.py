"""Choosing varied examples among the best candidates of a query.

Both choices look at a bounded number of candidates for a query, so a query is one small group.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from demosift.functions import text as T

from .rank import DIGITS

CANDIDATES, PENALTY, SEED = 40, 0.25, 42


def _clusters(x: np.ndarray, k: int, seed: int, tries: int = 10, rounds: int = 300) -> np.ndarray:
    """k-means with spread-out starts; the labels of the best of several tries."""
    rng, best = np.random.default_rng(seed), None
    for _ in range(tries):
        centers = [x[rng.integers(len(x))]]
        while len(centers) < k:
            far = ((x[:, None] - np.array(centers)[None]) ** 2).sum(-1).min(1)
            centers.append(x[rng.choice(len(x), p=far / far.sum()) if far.sum() > 0 else rng.integers(len(x))])
        c = np.array(centers)
        for _ in range(rounds):
            label = ((x[:, None] - c[None]) ** 2).sum(-1).argmin(1)
            moved = np.array([x[label == j].mean(0) if (label == j).any() else c[j] for j in range(k)])
            if np.allclose(moved, c):
                break
            c = moved
        spread = ((x - c[label]) ** 2).sum()
        if best is None or spread < best[0] - 1e-12:
            best = spread, label
    return best[1]


def dense_diversity(candidates: DataFrame, vectors: DataFrame, k: int = 8, seed: int = SEED) -> DataFrame:
    """One row from each of ``k`` clusters of a query's candidates, in order of the clusters.

    ``candidates``: ranked rows of each query (``query_id, row_id, score, rank``).  The best of a cluster is
    taken; clusters that stay empty are made up for by the best rows left.  No more candidates than ``k``
    are all taken as they rank.
    """
    kind, row_kind = (candidates.schema[c].dataType.simpleString() for c in ("query_id", "row_id"))

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rank").reset_index(drop=True)
        if len(pdf) <= k:
            chosen = list(range(len(pdf)))
        else:
            label = _clusters(np.array(pdf["embedding"].tolist(), float), k, seed)
            chosen = [int(np.flatnonzero(label == j)[0]) for j in range(k) if (label == j).any()]
            chosen += [i for i in range(len(pdf)) if i not in chosen][: k - len(chosen)]
        out = pdf.loc[chosen, ["query_id", "row_id", "score"]]
        return out.assign(rank=np.arange(1, len(out) + 1))

    found = candidates.join(vectors.select("row_id", "embedding"), "row_id")
    return found.select("query_id", "row_id", "score", "rank", "embedding").groupBy("query_id").applyInPandas(choose, f"query_id {kind}, row_id {row_kind}, score double, rank int")


def lexical_diversity(candidates: DataFrame, corpus: DataFrame, k: int = 8, text: str = "source_text", penalty: float = PENALTY) -> DataFrame:
    """Greedy choice by relevance less likeness to what is chosen already.

    The best row comes first; then, again and again, the row with the largest score (as a share of the
    best one's) less ``penalty`` times its largest Jaccard likeness to a chosen row.  Values count to ten digits, so
    that noise of summation does not part equal rows; of these the better ranked one is taken.
    """
    kind, row_kind = (candidates.schema[c].dataType.simpleString() for c in ("query_id", "row_id"))

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rank").reset_index(drop=True)
        sets = [set(t) for t in pdf["tokens"]]
        score = pdf["score"].to_numpy()
        top = score[0] if score[0] != 0 else 1.0
        like = lambda a, b: len(sets[a] & sets[b]) / max(1, len(sets[a] | sets[b]))
        chosen, rest = [0], list(range(1, len(pdf)))
        nearest = {i: like(i, 0) for i in rest}
        while rest and len(chosen) < k:
            best = max(rest, key=lambda i: (round(score[i] / top - penalty * nearest[i], DIGITS), -i))
            chosen.append(best)
            rest.remove(best)
            for i in rest:
                nearest[i] = max(nearest[i], like(i, best))
        out = pdf.loc[chosen[:k], ["query_id", "row_id", "score"]]
        return out.assign(rank=np.arange(1, len(out) + 1))

    # only texts of candidates are cut into tokens
    found = candidates.join(corpus.select("row_id", F.col(text).alias("candidate_text")), "row_id")
    found = found.select("query_id", "row_id", "score", "rank", F.array_distinct(T.bm25_tokens("candidate_text")).alias("tokens"))
    return found.groupBy("query_id").applyInPandas(choose, f"query_id {kind}, row_id {row_kind}, score double, rank int")
