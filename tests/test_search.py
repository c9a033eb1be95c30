"""The pruned search against all pairs."""

import random

import pytest
from pyspark.sql import Observation

from demosift.operators import bm25, rank, search
from demosift.plans import queries
from demosift.plans.retrieval import Index

DATA = "/root/testdata/sf0.001"


def frames(spark, seed, rows, terms, negative):
    r = random.Random(seed)
    postings = []
    for row in range(rows):
        for term in {min(int(r.expovariate(4) * terms), terms - 1) for _ in range(r.randrange(1, 12))}:
            # few values, so that many rows tie
            weight = r.choice([0.5, 1.0, 1.0, 2.0, r.random()]) / (1 + 20 / (term + 1))
            postings.append((row, f"t{term}", -weight if negative and term % 3 == 0 else weight))
    asked = [(q, f"t{t}", r.choice([1.0, 2.0])) for q in range(12) for t in sorted(r.sample(range(terms), r.randrange(1, 9)))]
    asked.append((99, "unseen", 1.0))
    return spark.createDataFrame(postings, "row_id long, term string, weight double"), spark.createDataFrame(asked, "query_id long, term string, weight double")


def ranked(df):
    return sorted((r.query_id, r["rank"], r.row_id, round(r.score, 9)) for r in df.collect())


@pytest.mark.parametrize(("seed", "negative"), [(1, False), (2, True), (3, True)])
def test_same_rows_as_all_pairs(spark, seed, negative):
    postings, asked = frames(spark, seed, 400, 40, negative)
    rows, ids = spark.range(400).withColumnRenamed("id", "row_id"), asked.select("query_id").distinct()
    index = search.Index.of(postings)
    everything = search.matched(index, asked)
    for k, share in ((1, 0.8), (5, 0.5), (30, 1.0)):
        found = rank.top_k(rank.complete(search.best(index, asked, k, share), ids, rows, k), k)
        want = rank.top_k(rank.complete(everything, ids, rows, k), k)
        assert ranked(found) == ranked(want)
        assert {n for _, n in [(q, max(r[1] for r in ranked(found) if r[0] == q)) for q in {r[0] for r in ranked(found)}]} == {k}


def test_fewer_pairs_are_scored_than_match(spark):
    c, q = queries.corpus(spark, DATA), queries.asked(spark, DATA)
    index = search.Index.of(bm25.postings(c, terms=bm25.terms_of(q)))
    asked, seen = bm25.asked_terms(q), Observation("bm25")
    search.best(index, asked, 8, seen=seen)
    assert 0 < seen.get["scored"] < search.matched(index, asked).count()


def test_absent_rows_are_found_below_rows_that_all_match(spark, monkeypatch):
    monkeypatch.setattr(rank, "RANGE", 8)
    rows = spark.range(300).withColumnRenamed("id", "row_id")
    # the first query's negative scores take all but three rows, the second's only the largest ids; the third has none
    taken = [(1, i, -1.0) for i in range(300) if i not in (3, 77, 78)] + [(2, i, -2.0) for i in range(200, 300)]
    scores = spark.createDataFrame(taken, "query_id long, row_id long, score double")
    ids = spark.createDataFrame([(1,), (2,), (3,)], "query_id long")
    got = rank.top_k(rank.complete(scores, ids, rows, 4), 4)
    by = {q: [r.row_id for r in sorted(got.where(f"query_id = {q}").collect(), key=lambda r: r["rank"])] for q in (1, 2, 3)}
    assert by == {1: [78, 77, 3, 299], 2: [199, 198, 197, 196], 3: [299, 298, 297, 296]}
    # no more rows than the ranges that are looked into
    assert rank.complete(scores, ids, rows, 4).count() <= len(taken) + 3 * 4 * 8


def test_cosine_of_features(spark):
    index = Index(queries.typed(queries.corpus(spark, DATA)), queries.asked(spark, DATA), "graph")
    want = rank.top_k(rank.complete(index.common_scores, index.queries, index.corpus, 8), 8)
    assert ranked(index.ranked("graph_common", 8)) == ranked(want)


def test_equal_sums_tie_in_any_order(spark):
    r = random.Random(5)
    weights = [r.random() for _ in range(10)]
    rows = [(row, f"t{i}", w) for row in range(50) for i, w in enumerate(r.sample(weights, 10))]
    index = search.Index.of(spark.createDataFrame(rows, "row_id long, term string, weight double"))
    asked = spark.createDataFrame([(1, f"t{i}", 1.0) for i in range(10)], "query_id long, term string, weight double")
    assert search.matched(index, asked).select("score").distinct().count() == 1
    assert search.best(index, asked, 5).select("score").distinct().count() == 1


def test_rows_scored_where_they_are_and_by_joins_agree(spark, monkeypatch):
    """Copies tie, absent rows count as zero, a null text has no token; no posting is made for a small table of queries."""
    texts = ["a b c", "b b d", "a b c", "q", "q", None, "", "a a a e", "b c d e"] * 5
    corpus = spark.createDataFrame(list(enumerate(texts)), "row_id long, source_text string").repartition(4)
    queries = spark.createDataFrame([(0, "a b b"), (1, "zzz"), (2, ""), (3, "e c q q")], "query_id long, text string")
    rows = lambda df: sorted((r.query_id, r.row_id, round(r.score, 9)) for r in df.collect())
    top = lambda: sorted((r.query_id, r["rank"], r.row_id, round(r.score, 9)) for r in bm25.similarity(corpus, queries, 12).collect())
    monkeypatch.setattr(bm25, "ASKED_CELLS", -1)
    pairs, best = rows(bm25.matched(corpus, queries)), top()
    monkeypatch.setattr(bm25, "ASKED_CELLS", 8_000_000)
    monkeypatch.setattr(bm25, "BLOCK_CELLS", 20)
    monkeypatch.setattr(bm25, "postings", lambda *_, **__: 1 / 0)
    assert rows(bm25.matched(corpus, queries)) == pairs and top() == best and len(best) == 48
