import hashlib
import random

import public_tokenizers
import pytest
import sentencepiece

from demosift.llm import registry
from demosift.llm import sentencepiece_codec as sc

HARD = ["", "  ", " a", "a  b ", "▁x▁", "日本語テキスト😀\u0000x", "\n\n", "a\tb\r\n", "<s>hello</s><0x41>", "é" * 3000, "x" * 2000, "𝒳 ﻿ ‍", " " * 300 + "y"]


@pytest.fixture(scope="module")
def both():
    path = public_tokenizers.path("piece_bpe_32k.model")
    return sc.Codec(sc.read_model(path)), sentencepiece.SentencePieceProcessor(model_file=path)


def test_matches_the_library(both, texts):
    own, library = both
    for t in [*texts.values(), *HARD]:
        ids, begins, ends = own.encode(t)
        want = library.encode(t)
        assert ids.tolist() == want
        assert own.decode(want) == library.decode(want)
        pieces = library.encode(t, return_type="proto").pieces
        assert list(zip(begins.tolist(), ends.tolist(), strict=True)) == [(p.begin, p.end) for p in pieces]


def test_decodes_any_ids(both):
    own, library = both
    rng = random.Random(1)
    for _ in range(500):
        ids = [rng.choice([rng.randrange(32000), rng.randrange(260)]) for _ in range(rng.randrange(1, 12))]
        assert own.decode(ids) == library.decode(ids)


@pytest.mark.parametrize("rule", ["nmt_nfkc", "nfkc", "nmt_nfkc_cf", "nfkc_cf"])
def test_normalises_through_a_compiled_map(both, rule, texts):
    library = sentencepiece.SentencePieceNormalizer(rule_name=rule, add_dummy_prefix=True, escape_whitespaces=True, remove_extra_whitespaces=True)
    own = sc.Codec(sc.read_model(public_tokenizers.path("piece_bpe_32k.model")))
    for number, value in sc._fields(library.serialized_model_proto()):
        if number == 3:
            own.model.charmap = sc.CharMap(dict(sc._fields(value))[2])
    own.model.remove_extra = True
    for t in [*list(texts.values())[:20], *HARD, "  ﬁ Ａ① ㍿ ﷺ Straße​ x ", "é ｶﾞ ½   z"]:
        if "\0" in t:
            continue
        got, origin = own.normalise(t)
        assert got == library.Normalize(t)
        raw = t.encode()
        assert len(origin) == len(got.encode()) + 1 and all(a <= b for a, b in zip(origin, origin[1:], strict=False))
        assert origin[-1] <= len(raw)


def test_query_and_edge_cases(spark, sf_dir, texts, documents, both):
    got = {r.doc_id: r for r in registry.op1_sentencepiece(spark, sf_dir).collect()}
    hexed = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for i, t in texts.items():
        want = both[1].encode(t)
        assert (got[i].n_tokens, got[i].ids_sha256, got[i].decoded_sha256) == (len(want), hexed(",".join(map(str, want))), hexed(both[1].decode(want)))
    df = documents([(1, None), (None, "a b"), (2, "héllo"), (2, "héllo")]).selectExpr("*", "1 AS id", "2 AS ids")
    model = registry.tokenizer_model()
    rows = sc.encode(df, model).collect()
    assert sorted((r.doc_id or 0, r.decoded) for r in rows) == [(0, "a b"), (1, ""), (2, "héllo"), (2, "héllo")]
    assert all(r.begins[0] == 0 and r.ends[-1] == len(r.decoded.encode()) for r in rows if r.ids)
    back = sc.decode(sc.encode(df, model), model)
    assert sorted(r.decoded for r in back.collect()) == ["", "a b", "héllo", "héllo"]
    assert sc.encode(df.limit(0), model).count() == 0
