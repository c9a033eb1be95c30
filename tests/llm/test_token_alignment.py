import hashlib
import os
from collections import Counter

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from demosift.llm import registry, token_alignment

HARD = ["", "a", " ", "  two  spaces ", "tab\tand\nlines\r\n", "naïve café 日本語 ✓ 🙂 é", "<|endoftext|> <s> </s>", "a▁b", "x" * 5000, "=" * 700, "it's we'll I'd", "0x41 <0x41>", "\x00\x01\x1f", " nbsp　wide", "ﬁ ﬂ Ⅷ"]


@pytest.fixture(scope="module")
def tools():
    with open(public_tokenizers.path("byte_bpe_50k.json"), "rb") as f:
        return f.read(), public_tokenizers.PATTERN, registry.tokenizer_model()


def plain(texts):
    """Token by token, with the tokenizers' own libraries."""
    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    letters = token_alignment.byte_letters()
    b = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    spell_a = lambda i: bytes(letters[c] for c in a.id_to_token(i))
    spell_b = lambda i: bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()
    docs, counts = [], Counter()
    for t in texts:
        whole = (" " + (t or "")).encode()
        sides = []
        for ids, spell in ((a.encode(" " + (t or ""), add_special_tokens=False).ids, spell_a), (b.encode(t or ""), spell_b)):
            at, out = 0, []
            for i in ids:
                out.append((i, at, at := at + len(spell(i))))
            sides.append((out, b"".join(map(spell, ids))))
        if not t or any(s[1] != whole for s in sides):
            docs.append(([], [], [], []))
            continue
        x, y = sides[0][0], sides[1][0]
        ends = sorted({e for _, _, e in x} & {e for _, _, e in y})
        groups, links, begin, j = [], [], 0, 0
        for end in ends:
            groups.append([[i for i, s, e in side if begin <= s and e <= end] for side in (x, y)] if len(whole) < 400 else None)
            begin = end
        for i, s, e in x:
            while y[j][2] <= s:
                j += 1
            k = j
            while k < len(y) and y[k][1] < e:
                links.append((i, y[k][0]))
                k += 1
        if groups and groups[0] is None:
            cuts, groups, i, j = ends, [], 0, 0
            for end in cuts:
                one = [[], []]
                while i < len(x) and x[i][2] <= end:
                    one[0].append(x[i][0])
                    i += 1
                while j < len(y) and y[j][2] <= end:
                    one[1].append(y[j][0])
                    j += 1
                groups.append(one)
        counts.update(links)
        docs.append((x, y, groups, links))
    best = {}
    for (_, b_id), n in counts.items():
        best[b_id] = max(best.get(b_id, 0), n)
    out = []
    for x, y, groups, links in docs:
        line = ";".join("|".join(",".join(map(str, side)) for side in g) for g in groups)
        out.append((len(x), len(y), len(groups), len(links), sum(counts[p] == best[p[1]] for p in links), sum(counts[p] for p in links), hashlib.sha256(line.encode()).hexdigest() if x else ""))
    return out


def rows(df):
    return [tuple(r)[1:] for r in sorted(df.collect(), key=lambda r: (r[0] is not None, r[0]))]


def test_whole_table_against_plain_alignment(spark, sf_dir, texts):
    got = registry.QUERIES["op12_token_alignment"](spark, sf_dir)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert rows(got) == plain([texts[i] for i in sorted(texts)])


def test_hard_texts_in_small_chunks(spark, documents, tools, monkeypatch):
    monkeypatch.setattr(token_alignment, "CHUNK", 1)
    docs = HARD + HARD[5:9]
    assert rows(token_alignment.token_alignment(documents(docs), *tools)) == plain(docs)
    marked = rows(token_alignment.token_alignment(documents(["a▁b"]), *tools))
    assert marked == [(0, 0, 0, 0, 0, 0, "")]


def test_edge_cases(spark, documents, tools):
    docs = documents([(None, "one two"), (None, "one two"), (1, None), (2, ""), (3, "one two"), (3, "one two")])
    got = rows(token_alignment.token_alignment(docs, *tools))
    assert sorted(got) == sorted(plain(["one two", "one two", None, "", "one two", "one two"]))
    assert rows(token_alignment.token_alignment(docs.limit(0), *tools)) == []
    extra = docs.selectExpr("*", "1 AS id", "2 AS chunk", "3 AS pair", "4 AS places")
    assert rows(token_alignment.token_alignment(extra, *tools)) == got


def test_links_are_overlaps():
    r = np.random.default_rng(2)
    for _ in range(50):
        cut = lambda: np.diff(np.unique(np.concatenate([[0, 60], r.integers(1, 60, r.integers(0, 40))])))
        a, b = cut(), cut()
        found = token_alignment.align(a, b)
        ea, eb = np.cumsum(a), np.cumsum(b)
        want = [(i, j) for i in range(len(a)) for j in range(len(b)) if ea[i] - a[i] < eb[j] and eb[j] - b[j] < ea[i]]
        assert list(zip(found.link_a.tolist(), found.link_b.tolist(), strict=True)) == want
        assert found.cuts.tolist() == sorted(set(ea.tolist()) & set(eb.tolist()))
