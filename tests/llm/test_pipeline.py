import hashlib
from collections import Counter

import public_tokenizers
import sentencepiece

import corpus_pipeline
from demosift.llm import mixing, toxicity
from demosift.llm.common import stored

from .test_near_dedup import brute_near
from .test_secrets import base


def test_stages_against_brute_force(spark):
    sf_dir = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = lambda df: sorted(map(tuple, df.collect()))
    before = rows(docs)
    stages = dict(corpus_pipeline.STAGES)
    frame = stored(stages["toxicity"](spark, docs, sf_dir), "test")
    scores = {r.doc_id: r.score for r in toxicity.score(docs, toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))).collect()}
    assert rows(frame) == [r for r in before if scores[r[0]] < 0.5] != before
    before = rows(frame)
    frame = stored(stages["simhash_near_dedup"](spark, frame, sf_dir), "test")
    found = brute_near({r[0]: r[1] for r in before})
    assert rows(frame) == [r for r in before if found[r[0]] == r[0]] != before
    before = rows(frame)
    frame = stored(stages["secret_scans"](spark, frame, sf_dir), "test")
    after = rows(frame)
    assert [r[0] for r in after] == [r[0] for r in before]
    for old, new in zip(before, after, strict=True):
        assert "[SECRET]" in new[1] if base(old[1]) else old == new or "[SECRET]" in new[1]
        assert not base(new[1]) and new[4] == (len(new[1]) if old != new else old[4])
    before = after
    taken = {r.doc_id: r.copies for r in mixing.mix(frame).collect()}
    frame = stored(stages["mixing"](spark, frame, sf_dir), "test")
    after = rows(frame)
    assert Counter(r[0] for r in after) == Counter({i: n for i, n in taken.items() if n})
    assert set(after) <= set(before) and frame.columns == docs.columns
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    want = sorted((r[0], hashlib.sha256(",".join(map(str, library.encode(r[1]))).encode()).hexdigest()) for r in after)
    last = stages["sentencepiece"](spark, frame, sf_dir).collect()
    assert sorted((r.doc_id, r.ids_sha256) for r in last) == want
    assert sorted(map(tuple, corpus_pipeline.run(spark, sf_dir).collect())) == sorted(map(tuple, last))


def test_edge_cases(spark, documents, sf_dir):
    rows = [(None, None, None), (1, None), (2, ""), (3, "a b c"), (3, "a b c"), (4, "A B C", None), (5, "password=abcdefgh x")]
    for docs in (documents(rows), documents(rows).limit(0), documents(rows).selectExpr("*", "1 AS id", "2 AS fp", "3 AS copies"), documents(rows).selectExpr("doc_id", "text", "CAST(NULL AS STRING) AS lang", "CAST(NULL AS STRING) AS source", "CAST(NULL AS BIGINT) AS n_chars")):
        columns = docs.columns
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = stored(stage(spark, docs, sf_dir), "test")
            assert docs.columns == columns
        assert corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).count() == docs.count()
