import hashlib
import random

import numpy as np
import pytest

from demosift.llm import registry, substring_dedup
from demosift.llm.fm_index import FMIndex, intervals


def brute(docs, window=20):
    """docs: rows of (id, text); rows of an id count in order."""
    words = {i: (t or "").encode().split() for i, t in docs}
    seen, out = {}, {}
    for i in sorted(words, key=lambda x: (x is not None, x)):
        for j in range(len(words[i]) - window + 1):
            seen.setdefault(tuple(words[i][j : j + window]), (i, j))
    for i, ws in words.items():
        gone = [False] * len(ws)
        for j in range(len(ws) - window + 1):
            if seen[tuple(ws[j : j + window])] != (i, j):
                gone[j : j + window] = [True] * window
        kept = b" ".join(w for w, g in zip(ws, gone, strict=True) if not g)
        out[i] = (len(ws), sum(gone), hashlib.sha256(kept).hexdigest())
    return out


def test_sql_matches_brute_force():
    import duckdb

    con = duckdb.connect()
    con.sql("create view documents as from '/root/testdata/sf0.001/documents.parquet'")
    docs = con.sql("select doc_id, text from documents").fetchall()
    assert {r[0]: r[1:] for r in con.sql(substring_dedup.ORACLE_SQL).fetchall()} == brute(docs)


def test_query_matches_brute_force(spark):
    data = "/root/testdata/sf0.01"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{data}/documents.parquet").collect()]
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in registry.op2_substring_dedup(spark, data).collect()}
    assert got == brute(docs)
    assert sum(r[1] for r in got.values()) > 1000


@pytest.mark.parametrize(("window", "gram", "hot", "shard"), [(20, 6, 2000, 400_000), (5, 2, 3, 200), (4, 4, 1, 50), (7, 1, 10**9, 10**9)])
def test_any_cut_finds_the_same(spark, documents, window, gram, hot, shard):
    rng = random.Random(window)
    phrase = [f"p{i}" for i in range(30)]
    docs = []
    for i in range(60):
        ws = [rng.choice("abcdefgh") for _ in range(rng.randrange(0, 60))]
        if i % 3:
            a = rng.randrange(10)
            ws[5:5] = phrase[a : a + rng.randrange(5, 20)]
        docs.append((i * 7 - 20, " ".join(ws)))
    docs += [(1000, docs[5][1]), (1001, "z " * 300), (1002, "z " * 40), (1003, None), (1004, "")]
    rng.shuffle(docs)
    got = substring_dedup.substring_dedup(documents(docs), window=window, gram=gram, hot=hot, shard_words=shard)
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in got.collect()} == brute(docs, window)


def test_repeated_and_null_ids(spark, documents):
    text = " ".join(f"w{i}" for i in range(25))
    df = documents([(None, text), (3, text), (3, text), (4, "short"), (5, f"x {text} y")]).selectExpr("*", "1 AS id", "2 AS key", "3 AS h")
    got = sorted((-1 if r.doc_id is None else r.doc_id, r.n_words, r.n_removed) for r in substring_dedup.substring_dedup(df).collect())
    assert got == [(-1, 25, 0), (3, 25, 25), (3, 25, 25), (4, 1, 0), (5, 27, 25)]
    alone = documents([(3, text), (3, text)])
    assert [r.n_removed for r in substring_dedup.substring_dedup(alone).collect()] == [0, 0]
    assert substring_dedup.substring_dedup(df.limit(0)).count() == 0


def test_text_of_every_document(spark, documents):
    text = " ".join(f"w{i}" for i in range(25))
    df = documents([(None, "no\tcopy"), (1, text), (1, "own  words"), (2, f"x {text} y"), (3, None)])
    got = {(r.doc_id, r.n_words): r.text for r in substring_dedup.substring_dedup(df).collect()}
    assert got == {(None, 2): "no copy", (1, 25): text, (1, 2): "own words", (2, 27): "x y", (3, 0): ""}
    for r in substring_dedup.substring_dedup(df).collect():
        assert hashlib.sha256(r.text.encode()).hexdigest() == r.kept_sha256
    assert sum(r.text is None for r in substring_dedup.substring_dedup(df, texts=False).collect()) == 3


def test_matching_statistics():
    rng = random.Random(4)
    texts = [[bytes([rng.choice(b"abc")]) for _ in range(rng.randrange(1, 60))] for _ in range(30)]
    patterns = [[bytes([rng.choice(b"abcd")]) for _ in range(rng.randrange(0, 50))] for _ in range(20)]
    for window in (1, 2, 3, 7, 12):
        lengths, lo, hi = FMIndex(texts, window).statistics(patterns)
        grams = [{}] * (window + 1)
        for n in range(1, window + 1):
            grams[n] = {}
            for t in texts:
                for i in range(len(t) - n + 1):
                    grams[n][tuple(t[i : i + n])] = grams[n].get(tuple(t[i : i + n]), 0) + 1
        at = 0
        for p in patterns:
            for i in range(len(p)):
                want = max([0, *(n for n in range(1, window + 1) if i + n <= len(p) and tuple(p[i : i + n]) in grams[n])])
                assert lengths[at] == want
                if want:
                    assert hi[at] - lo[at] == grams[want][tuple(p[i : i + want])]
                at += 1


def test_located_occurrences():
    rng = random.Random(6)
    texts = [[bytes([rng.choice(b"abc")]) for _ in range(rng.randrange(1, 40))] for _ in range(25)]
    for window in (1, 2, 5, 20):
        index = FMIndex(texts, window)
        lengths, lo, hi = index.statistics(texts)
        at = 0
        for t in texts:
            for i in range(len(t)):
                n = min(window, len(t) - i)
                assert lengths[at] == n
                found = set(index.locate(np.arange(lo[at], hi[at])).tolist())
                want = {int(index.starts[k]) + j for k, u in enumerate(texts) for j in range(len(u) - n + 1) if u[j : j + n] == t[i : i + n]}
                assert found == want
                at += 1


def test_word_hashes_follow_words():
    texts = [b" a  bb a", b"", b"bb", b"\x0b a\tbb\r\n", b"abb", "é è".encode()]
    h, begins = substring_dedup.word_hashes(np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])]))
    words = [w for t in texts for w in t.split()]
    assert np.diff(begins).tolist() == [len(t.split()) for t in texts]
    of = {}
    assert all(of.setdefault(w, x) == x for w, x in zip(words, h.tolist(), strict=True)) and len(set(of.values())) == len(set(words))


def test_keys_that_very_many_share(spark, documents, monkeypatch):
    text = " ".join(f"w{i}" for i in range(30))
    docs = [(i, f"x{i} {text} y{i}") for i in range(80)] + [(None, text)] * 30
    want = sorted((r.doc_id or -1, r.n_removed) for r in substring_dedup.substring_dedup(documents(docs)).collect())
    monkeypatch.setattr(substring_dedup, "SAMPLED", 2)
    assert sorted((r.doc_id or -1, r.n_removed) for r in substring_dedup.substring_dedup(documents(docs)).collect()) == want
    assert [n for _, n in want].count(30) == 80


def test_intervals():
    assert intervals(np.array([0, 3, 3, 1, 0, 0, 3, 0, 0]), 3) == [(1, 5), (6, 9)]
