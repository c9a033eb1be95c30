"""Stages of the pipeline row by row: tokens, repeated and null ids."""

import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import sentencepiece

import corpus_pipeline
from demosift.llm import mixing, simhash


def test_pipeline_ends_in_tokens(spark, documents, sf_dir):
    texts = {1: "Some words, naïve ones", 2: "", 3: "x  y\n" * 300}
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    got = corpus_pipeline.tokenize(spark, documents([*texts.items(), (None, None)]), sf_dir).collect()
    assert sorted(r.doc_id or 0 for r in got) == [0, 1, 2, 3]
    for r in got:
        text = texts.get(r.doc_id, "")
        assert r.ids == library.encode(text) and r.n_tokens == len(r.ids) == len(r.begins) == len(r.ends)
        assert hashlib.sha256(",".join(map(str, r.ids)).encode()).hexdigest() == r.ids_sha256
        spans = np.array([r.begins, r.ends], "<i8").T
        assert hashlib.sha256(np.ascontiguousarray(spans).tobytes()).hexdigest() == r.spans_sha256
        assert all(0 <= a <= b <= len(text.encode()) for a, b in zip(r.begins, r.ends, strict=True))


def test_mix_decides_for_each_row(spark, documents, sf_dir):
    rng = random.Random(5)
    rows = [(rng.choice((None, i, i % 7)), f"t{i} " + "w " * rng.randrange(30), rng.choice("aaab")) for i in range(300)]
    docs = documents(rows).selectExpr("*", "1 AS n", "2 AS row", "3 AS copies")
    got = corpus_pipeline.mix_sources(spark, docs, sf_dir)
    assert got.columns == docs.columns
    copies = Counter(r.text for r in got.collect())
    numbered = docs.selectExpr("int(substr(text, 2, instr(text, ' ') - 2)) AS at", "doc_id", "text", "source")
    want = {rows[r["at"]][1]: r.copies for r in mixing.mix(numbered, row_col="at").collect()}
    # rows of one key and size are alike
    alike = lambda of: sorted((str(i), s, t.count(" "), of[t]) for i, t, s in rows)
    assert alike(copies) == alike(want)
    sizes = {s: sum(len(t.split()) for _, t, x in rows if x == s) for s in "ab"}
    shares = mixing.targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long"))
    for source, target in shares.select("source", "target").collect():
        assert abs(sum(len(t.split()) * copies[t] for _, t, s in rows if s == source) - target) <= 31


def test_near_dedup_keeps_texts_that_share_an_id(spark, documents):
    a, b, c = (" ".join(f"{x}{i}" for i in range(40)) for x in "abc")
    rows = [(5, a), (5, b), (5, b.upper()), (7, b), (7, c), (2, c), (9, a), (None, a), (None, "d")]
    df = documents(rows).selectExpr("*", "1 AS id", "2 AS fp", "3 AS first", "4 AS row")
    kept = simhash.near_dedup(df)
    assert kept.columns == df.columns
    assert sorted((r.doc_id or 0, r.text.lower()) for r in kept.collect()) == [(0, a), (0, "d"), (2, c), (5, a), (5, b)]
    assert simhash.near_dedup(df.limit(0)).count() == 0
