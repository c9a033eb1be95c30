import numpy as np
import pytest
from pyspark.sql import functions as F

from demosift.operators import bm25, dense, diversity, graph, rank
from demosift.plans.retrieval import Index

TRAIN = [(0, "tuz aççıqdur", "salt is bitter", "en", "phrase", "2"), (1, "qand aqdur", "sugar is white", "en", "phrase", "2"), (2, "kitab", "book", "en", "word", "1")]
SCHEMA = "row_id long, source_text string, target_text string, target_lang string, type string, length string"


@pytest.fixture()
def train(spark):
    return spark.createDataFrame(TRAIN, SCHEMA)


@pytest.fixture()
def asked(spark):
    return spark.createDataFrame([(9, "muz qattıqdur", "phrase", "2")], "query_id long, text string, type string, length string")


def ranked(df, digits=6):
    return [(r.row_id, round(r.score, digits)) for r in df.orderBy("query_id", "rank").collect()]


@pytest.mark.parametrize(("texts", "query", "scores"), [
    (["a b c", "a a d", "a e", "f g h i"], "a b b z", [1.859348, 0.235361, 0.193826, 0]),
    (["a x", "a y", "a z"], "a x", [0.484986, -0.025840, -0.025840]),
])
def test_bm25_scores(spark, texts, query, scores):
    corpus = spark.createDataFrame(list(enumerate(texts)), "row_id long, source_text string")
    queries = spark.createDataFrame([(0, query)], "query_id long, text string")
    got = dict(ranked(bm25.similarity(corpus, queries, len(texts))))
    assert got == {i: s for i, s in enumerate(scores)}


def test_zero_scores_rank_before_negative_ones(spark):
    # four terms in three of four rows make the mean idf, and so the floor, negative
    corpus = spark.createDataFrame(list(enumerate(["a b c d", "q", "a b c d", "a b c d"])), "row_id long, source_text string")
    queries = spark.createDataFrame([(0, "a"), (1, "nothing")], "query_id long, text string")
    got = bm25.similarity(corpus, queries, 2)
    assert [(r.query_id, r.row_id) for r in got.orderBy("query_id", "rank").collect()] == [(0, 1), (0, 3), (1, 3), (1, 2)]


def test_graph_edges(spark, train, asked):
    edges, idf = graph.build(train)
    assert edges.count() == 27 and idf.count() == 23
    weights = {r.feature: round(r.weight, 6) for r in graph.query_features(asked, idf).join(idf, "feature").collect()}
    assert weights == {"suffix3:dur": 1.545218, "suffix4:qdur": 1.158914, "type:phrase": 1.287682, "length:2": 1.030146}
    start = {r.feature: round(r.mass, 6) for r in graph.restart(edges, graph.query_features(asked, idf)).collect()}
    assert start == {"suffix3:dur": 0.307692, "suffix4:qdur": 0.230769, "type:phrase": 0.256410, "length:2": 0.205128}
    assert [round(r[0], 9) for r in edges.groupBy("row_id").agg(F.sum("p_f_given_s")).select("sum(p_f_given_s)").collect()] == [1.0] * 3


@pytest.mark.parametrize("array_edges", [0, 10**6])
def test_page_rank(spark, train, asked, array_edges):
    edges, idf = graph.build(train)
    features = graph.query_features(asked, idf)
    for steps, want in ((1, {0: 0.5, 1: 0.5}), (8, {0: 0.495510, 1: 0.504490})):
        got = graph.ppr_scores(edges, features, steps, array_edges=array_edges).collect()
        assert {r.row_id: round(r.score, 6) for r in got if r.score > 1e-12} == want
    unknown = graph.query_features(spark.createDataFrame([(1, "zzz")], "query_id long, text string"), idf).where("feature like 'token%'")
    assert graph.ppr_scores(edges, unknown, array_edges=array_edges).count() == 0


def test_graph_strategies(spark, train, asked):
    index = Index(train, asked, "graph")
    assert ranked(index.retrieve("graph_common", 3)) == [(0, 0.130130), (1, 0.128238), (2, 0.0)]
    assert ranked(index.retrieve("graph_ppr", 3)) == [(1, 0.504490), (0, 0.495510), (2, 0.0)]
    assert [r.type for r in index.examples("graph_common", 2).collect()] == ["phrase", "phrase"]
    with pytest.raises(ValueError, match="no strategy"):
        index.retrieve("nope", 1)
    with pytest.raises(ValueError, match="backend graph"):
        Index(train, asked, "bm25").retrieve("graph_ppr", 1)


def test_blends(spark):
    corpus = spark.createDataFrame([(0, "alma qızıl", "word"), (1, "su aq", "word")], "row_id long, source_text string, type string")
    queries = spark.createDataFrame([(0, "alma qızıl", "word")], "query_id long, text string, type string")
    vectors = spark.createDataFrame([(0, [0.9, 0.0]), (1, [0.1, 0.0])], "row_id long, embedding array<float>")
    asked = spark.createDataFrame([(0, [1.0, 0.0])], "query_id long, embedding array<float>")
    index = Index(corpus, queries, "graph", vectors, asked)
    assert ranked(index.retrieve("hybrid_graph", 2)) == [(0, 1.0), (1, 0.0)]
    # in two rows every term of one of them has an idf of zero
    assert ranked(index.retrieve("graph_ppr_bm25_dense", 2)) == [(0, 0.85), (1, 0.0)]


def test_normalisation(spark):
    rows = [(0, 0, 2.0), (0, 1, 4.0), (1, 0, 3.0), (1, 1, 3.0), (2, 0, -1.0)]
    df = spark.createDataFrame(rows, "query_id long, row_id long, score double")
    assert sorted((r.query_id, r.row_id, r.score) for r in rank.normalize(df).collect()) == [(0, 0, 0.0), (0, 1, 1.0), (1, 0, 0.0), (1, 1, 0.0), (2, 0, 0.0)]
    assert {(r.query_id, r.row_id): r.score for r in rank.normalize(df, 3).collect()}[0, 0] == 0.5
    assert rank.normalize(df.limit(0)).count() == 0


def test_dense_similarity_and_diversity(spark):
    rng = np.random.default_rng(0)
    x = rng.standard_normal((60, 6))
    x /= np.linalg.norm(x, axis=1)[:, None]
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "row_id long, embedding array<double>").repartition(3)
    asked = vectors.where("row_id < 4").withColumnRenamed("row_id", "query_id")
    got = [(r.query_id, r.row_id) for r in dense.similarity(vectors, asked, 3).orderBy("query_id", "rank").collect()]
    assert got == [(q, int(i)) for q in range(4) for i in np.argsort(-(x @ x[q]))[:3]]
    few = dense.similarity(vectors, asked, 4)
    assert [r.row_id for r in diversity.dense_diversity(few, vectors, 8).where("query_id = 0").orderBy("rank").collect()] == [r.row_id for r in few.where("query_id = 0").orderBy("rank").collect()]
    many = diversity.dense_diversity(dense.similarity(vectors, asked, 40), vectors, 8)
    assert many.groupBy("query_id").count().where("count <> 8").count() == 0
    assert many.select("query_id", "row_id").distinct().count() == 32


def test_lexical_diversity(spark):
    corpus = spark.createDataFrame([(0, "a b c"), (1, "a b c"), (2, "x y"), (3, "a q")], "row_id long, source_text string")
    candidates = spark.createDataFrame([(0, 0, 1.0, 1), (0, 1, 0.9, 2), (0, 2, 0.8, 3), (0, 3, 0.7, 4)], "query_id long, row_id long, score double, rank int")
    # 0.9 - 0.25 < 0.8, then 0.9 - 0.25 = 0.65 > 0.7 - 0.25 / 4
    got = [r.row_id for r in diversity.lexical_diversity(candidates, corpus, 3).orderBy("rank").collect()]
    assert got == [0, 2, 1] if 0.65 > 0.7 - 0.0625 else [0, 2, 3]


def test_unranked_strategies(spark, train, asked):
    index = Index(train, asked, "bm25", static=train)
    assert index.retrieve("zero", 5).count() == 0
    assert [r.row_id for r in index.retrieve("static", 2).orderBy("rank").collect()] == [0, 1]
    assert index.retrieve("random", 5).count() == 3
    assert index.examples("similarity", 2).count() == 2 and index.examples("diversity", 2).count() == 2


def test_counting_features_stores_no_edges(spark, monkeypatch):
    texts = ["a b a b", "abcd abcd x", None, "", "abcd"]
    rows = spark.createDataFrame([(i, t, "word") for i, t in enumerate(texts)], "row_id long, source_text string, type string")
    want = sorted(map(tuple, graph.build(rows)[1].collect()))
    monkeypatch.setattr(graph, "stored", lambda *_: 1 / 0)
    assert sorted(map(tuple, graph.feature_counts(rows).collect())) == want
