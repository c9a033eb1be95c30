"""Greedy matching of token vectors, against loops over tokens."""

import math

import numpy as np
import pytest

from demosift.operators import metrics, semantic

PAIRS = [("m", "the cat sat", "the cat sat"), ("m", "a dog", "the cat sat down"), ("m", "", "x"), ("m", "y", None), ("o", " ", ""), ("m", "the the", "zebra the")]
SCHEMA = "model string, prediction string, reference string"


def by_hand(pairs, idf):
    encode = semantic.hashed_encoder()
    told = [((p or "").lower().split(), (r or "").lower().split()) for _, p, r in pairs]
    some = [(p, r) for p, r in told if p and r]
    weight = lambda t: math.log((len(some) + 1) / (sum(t in r for _, r in some) + 1)) if idf else 1.0
    out = []
    for p, r in told:
        if not p or not r:
            out.append(None)
            continue
        cos = lambda s, t: float(np.dot(*[v / np.linalg.norm(v) for v in (encode([[s]])[0][0], encode([[t]])[0][0])]))
        side = lambda x, y: (lambda best, w: sum(b * v for b, v in zip(best, w)) / sum(w) if sum(w) else sum(best) / len(best))([max(cos(s, t) for t in y) for s in x], [weight(s) for s in x])
        a, b = side(p, r), side(r, p)
        out.append(2 * a * b / (a + b))
    return out


@pytest.mark.parametrize("idf", [False, True])
def test_scores(spark, idf, monkeypatch):
    monkeypatch.setattr(semantic, "PRODUCTS", 3)
    df = spark.createDataFrame(PAIRS, SCHEMA).coalesce(1)
    got = [r.f1 for r in semantic.scored(df, semantic.hashed_encoder(), idf).collect()]
    want = by_hand(PAIRS, idf)
    key = lambda x: -9 if x is None else x
    assert sorted(map(key, got)) == pytest.approx(sorted(map(key, want)))
    assert max(map(key, got)) == pytest.approx(1.0)


def test_experiments_without_a_scored_pair_have_no_value(spark):
    df = semantic.scored(spark.createDataFrame(PAIRS, SCHEMA), semantic.hashed_encoder())
    got = {r.model: r.BERTScore for r in metrics.evaluate(df, ("model",), semantic=df["f1"], which=()).collect()}
    assert got["o"] is None and got["m"] == pytest.approx(100 * np.mean([x for x in by_hand(PAIRS, False) if x is not None]))
    assert semantic.scored(spark.createDataFrame([], SCHEMA), semantic.hashed_encoder(), True).count() == 0


def test_blocks_make_no_difference():
    r = np.random.default_rng(3)
    a, b = r.standard_normal((40, 5)), r.standard_normal((70, 5))
    one = semantic.greedy_match(a, b)
    cos = (a / np.linalg.norm(a, axis=1)[:, None]) @ (b / np.linalg.norm(b, axis=1)[:, None]).T
    assert np.allclose(one[0], cos.max(axis=1)) and np.allclose(one[1], cos.max(axis=0))


def test_few_rows_are_objects_at_a_time(spark, monkeypatch):
    """However many rows a batch has, and with a memory of fewer tokens than a text has."""
    rows = [(i, f"a{i} b c d", "a1 b c e" if i % 3 else "") for i in range(20)]
    df = spark.createDataFrame(rows, "i int, prediction string, reference string").coalesce(1)
    got = lambda: sorted(map(tuple, semantic.scored(df, semantic.hashed_encoder(), idf=True).select("i", "precision", "recall", "f1").collect()))
    want = got()
    assert max(10, semantic.ROWS) <= 1000
    monkeypatch.setattr(semantic, "ROWS", 3)
    monkeypatch.setattr(semantic, "REMEMBERED", 2)
    assert got() == want
