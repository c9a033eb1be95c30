import numpy as np

from demosift.llm import ann, registry

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, query_ids, k=5):
    good = {i: np.array(v, float) for i, v in rows if i is not None and v and None not in v and np.isfinite(np.array(v, float)).all() and np.any(v)}
    out = []
    for q in query_ids:
        if q not in good:
            continue
        x = good[q]
        cosine = lambda v: (v * x).sum() / (np.sqrt((v * v).sum()) * np.sqrt((x * x).sum()))
        best = sorted((-cosine(v), i) for i, v in good.items() if i != q and len(v) == len(x))[:k]
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    return out


def test_recall_against_brute_force(spark):
    data = "/root/testdata/sf0.1"
    table = spark.read.parquet(f"{data}/embeddings.parquet")
    rows = [(r.vec_id, list(r.embedding)) for r in table.collect()]
    want = brute(rows, [i for i, _ in rows if i % 50 == 0])
    got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in registry.op9_ann(spark, data).collect()}
    assert len(got) == len(want)
    hits = sum(got[q, n][0] == i for q, n, i, _ in want)
    assert hits / len(want) >= 0.99
    assert all(abs(got[q, n][1] - s) < 1e-12 for q, n, i, s in want if got[q, n][0] == i)


def test_estimates_keep_their_bounds():
    rng = np.random.default_rng(2)
    x = rng.standard_normal((2000, 48))
    x /= np.linalg.norm(x, axis=1)[:, None]
    turn = ann.rotation(48)
    codes = ann.Codes(x, turn)
    estimate, error = codes.estimate_block(x[:50] @ turn)
    miss = np.abs(estimate - x[:50] @ x.T)
    assert (miss <= error[None, :] + 1e-5).mean() > 0.999
    assert np.allclose(codes.estimate(x[0] @ turn)[0], estimate[0], atol=1e-5)


def test_edge_cases(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.standard_normal(8).tolist(), 0) for i in range(1, 200)]
    rows += [(i, [1.0] * 8, 0) for i in range(200, 460)]  # one very common vector
    rows += [(460, None, 0), (461, [], 0), (462, [0.0] * 8, 0), (463, [float("nan")] + [1.0] * 7, 0), (464, [None] + [1.0] * 7, 0), (465, [float("inf")] * 8, 0), (None, [1.0] * 8, 0), (500, [1.0] * 3, 0), (550, [1.0, 2.0, 3.0], 0), (50, rows[49][1], 1)]
    df = spark.createDataFrame(rows, SCHEMA)
    df = df.selectExpr("*", "1 AS id", "2 AS v", "3 AS block")
    got = [tuple(r) for r in ann.nearest(df, df.where("vec_id % 50 = 0")).orderBy("query_id", "rank").collect()]
    floats = [(i, None if v is None else [None if c is None else float(np.float32(c)) for c in v]) for i, v, _ in rows]
    want = brute(floats, sorted({i for i, _ in floats if i is not None and i % 50 == 0}))
    assert [g[:3] for g in got] == [w[:3] for w in want]
    assert all(abs(g[3] - w[3]) < 1e-12 for g, w in zip(got, want, strict=True))
    assert ann.nearest(df.limit(0), df.limit(0)).count() == 0
    assert ann.nearest(df, df.limit(0)).count() == 0
