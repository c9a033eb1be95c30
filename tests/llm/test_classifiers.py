import zlib

import duckdb
import numpy as np
import pytest

from demosift.llm import quality, registry, toxicity

LABELS = "doc_id long, quality int, toxic int"


def truth(column):
    return dict(duckdb.sql(f"select doc_id, {column} from '/root/testdata/sf0.1/labels.parquet'").fetchall())


def held_out(i):
    return zlib.crc32(str(i).encode()) % 5 == 0


def auc(pairs):
    order = sorted(pairs)
    ranks = [n for n, (_, y) in enumerate(order) if y]
    ones = len(ranks)
    return (sum(ranks) - ones * (ones - 1) / 2) / ones / (len(order) - ones)


@pytest.mark.parametrize(("query", "column", "least", "at"), [("op10_quality", "quality", 0.99, 0.3), ("op8_toxicity", "toxic", 0.92, 0.5)])
def test_held_out_accuracy(spark, query, column, least, at):
    rows = registry.QUERIES[query](spark, "/root/testdata/sf0.1").collect()
    assert len(rows) == 10_000 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= at) and r.held_out == held_out(r.doc_id) for r in rows)
    labels = truth(column)
    held = [(r.score, labels[r.doc_id], r.predicted) for r in rows if r.held_out and r.doc_id in labels]
    assert auc([h[:2] for h in held]) > least
    clean = [h for h in held if h[1] == (column == "quality")]
    assert np.mean([h[2] == h[1] for h in clean]) > 0.9
    assert np.mean([h[2] == h[1] for h in held]) > 0.97


def test_scores_do_not_depend_on_held_out_labels(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    turned = labels.selectExpr("doc_id", *[f"CASE WHEN crc32(CAST(doc_id AS STRING)) % 5 = 0 THEN 1 - {c} ELSE {c} END AS {c}" for c in ("quality", "toxic")])
    for m in (quality, toxicity):
        a, b = (sorted(m.score(docs.limit(50), m.train(docs, x)).select("doc_id", "score").collect()) for x in (labels, turned))
        assert a == b


def test_marginals_match_enumeration():
    rng = np.random.default_rng(0)
    lengths = np.array([3, 0, 5, 1])
    emission, t = rng.standard_normal(9), rng.standard_normal(3)
    lattice = toxicity.Lattice(lengths)
    got = lattice.marginals(emission, t)
    expected_pairs = np.zeros(3)
    want = []
    for n, e in zip(lengths, np.split(emission, np.cumsum(lengths)[:-1]), strict=True):
        total, ones, pairs = 0.0, np.zeros(n), np.zeros(3)
        for code in range(2**n if n else 0):
            y = [code >> i & 1 for i in range(n)]
            moves = np.array([sum((a, b) == m for a, b in zip(y, y[1:], strict=False)) for m in ((0, 1), (1, 0), (1, 1))])
            p = np.exp(np.dot(y, e) + moves @ t)
            total += p
            ones += p * np.array(y)
            pairs += p * moves
        if n:
            want += (ones / total).tolist()
            expected_pairs += pairs / total
    assert np.allclose(got, want)
    assert np.allclose(lattice.pairs(*lattice.messages(emission, t), t), expected_pairs)


def test_spans_point_at_words(spark, documents):
    model = toxicity.fit([(f"you are an idiot w{i}", 1) for i in range(20)] + [(f"you are an honest w{i}", 0) for i in range(40)])
    rows = toxicity.score(documents([(1, "é😀 an idiot, here"), (2, None), (3, ""), (4, "an honest one")]).selectExpr("*", "1 AS id", "2 AS score"), model).collect()
    found = {r.doc_id: r for r in rows}
    assert [(s.start, s.end) for s in found[1].spans] == [(6, 12)] and found[1].score > 0.5
    assert found[2].score == found[3].score < 0.5 and found[4].score < 0.5 and not found[4].spans
    kept = toxicity.drop_toxic(documents([(1, "an idiot here"), (2, None), (3, "fine")]), model)
    assert sorted(r.doc_id for r in kept.collect()) == [2, 3]


@pytest.mark.parametrize("m", [quality, toxicity])
def test_edge_cases(spark, documents, m):
    docs = documents([(None, "a b"), (1, None), (2, ""), (2, ""), (3, "x " * 100_000), (4, "�\u0000 #")]).selectExpr("*", "1 AS id", "2 AS score")
    none = spark.createDataFrame([], LABELS)
    one = spark.createDataFrame([(1, 1, 1), (2, 1, 1), (None, 0, 0), (3, None, None)], LABELS)
    for labels in (none, one):
        rows = m.score(docs, m.train(docs, labels)).collect()
        assert len(rows) == 6 and len({r.score for r in rows}) == 1 and 0 <= rows[0].score <= 1
    model = m.fit([("good words here", 1), ("### bad", 0)] * 10)
    rows = m.score(docs, model).collect()
    assert len(rows) == 6 and all(0 <= r.score <= 1 for r in rows) and len({r.score for r in rows if r.doc_id in (1, 2)}) == 1
    assert m.score(docs.limit(0), model).count() == 0


def test_rows_without_id_are_held_out(spark, documents):
    from demosift.llm.common import trained_on

    df = documents([(None, "a"), (1, "b"), (2, "c")])
    assert {r.doc_id: r.held for r in df.select("doc_id", (~trained_on()).alias("held")).collect()}[None] is True


def test_texts_are_scored_in_slices_of_bounded_size(monkeypatch):
    import pyarrow as pa

    texts = ["w " * n for n in (1, 50, 3000, 2, 2, 2)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(6)), pa.array([t.encode() for t in texts])], ["id", "text"])
    monkeypatch.setattr(toxicity, "SLICE", 110)
    assert [p.num_rows for p in toxicity._slices(batch, 1)] == [2, 1, 3]
