import hashlib
import random

import numpy as np

from demosift.llm import registry, suffix_array, suffix_dedup


def brute(docs, window=100):
    """Documents (id, bytes) in order: removed intervals, from every window in a dictionary."""
    seen, out = set(), []
    for i, raw in docs:
        cut = np.zeros(len(raw), bool)
        for a in range(len(raw) - window + 1):
            w = raw[a : a + window]
            if w in seen:
                cut[a : a + window] = True
            seen.add(w)
        kept = bytes(np.frombuffer(raw, np.uint8)[~cut])
        runs = int(cut[:1].sum() + (cut[1:] & ~cut[:-1]).sum())
        out.append((i, len(raw), int(cut.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return out


def rows(df):
    return sorted(tuple(r)[:5] for r in df.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect())


def naive(groups, window):
    found = {}
    for k, g in enumerate(groups):
        at = 0
        for s in g:
            for i in range(len(s) - window + 1):
                found.setdefault((k, s[i : i + window]), []).append((k, at + i))
            at += len(s)
    return sorted(v for v in found.values() if len(v) > 1)


def test_suffixes_are_sorted_and_windows_found():
    r = random.Random(1)
    for _ in range(150):
        letters = r.choice([b"a", b"ab", b"abc", bytes(range(256))])
        groups = [[bytes(r.choice(letters) for _ in range(r.randrange(1, r.choice([3, 10, 60])))) for _ in range(r.randrange(1, 5))] for _ in range(r.randrange(1, 6))]
        text, group, starts, _ = suffix_array.laid_out(groups)
        symbols, ends = text.tolist(), np.flatnonzero(text == suffix_array.END)
        suffix = lambda i: symbols[i : ends[np.searchsorted(ends, i)] + 1]
        assert suffix_array.suffix_array(text, group).tolist() == sorted(range(len(symbols)), key=lambda i: (symbols[i], group[i], suffix(i)))
        window = r.choice([1, 2, 3, 7])
        places, classes, starts, sizes = suffix_array.equal_windows(groups, window)
        own = np.searchsorted(starts, places, side="right") - 1
        first = np.concatenate([np.cumsum([0, *map(len, g)])[:-1] for g in groups])
        of = np.repeat(np.arange(len(groups)), list(map(len, groups)))
        got = {}
        for p, c, o in zip(places.tolist(), classes.tolist(), own.tolist(), strict=True):
            got.setdefault(c, []).append((int(of[o]), int(first[o] + p - starts[o])))
        assert sorted(sorted(v) for v in got.values()) == naive(groups, window)


def test_long_repetitions_are_sorted():
    for s in (b"a" * 3000, b"ab" * 1500, b"abcabcabd" * 200):
        text, group, *_ = suffix_array.laid_out([[s]])
        raw = text.tolist()
        assert suffix_array.suffix_array(text, group).tolist() == sorted(range(len(raw)), key=lambda i: raw[i:])


def test_whole_table_against_brute_force(spark, sf_dir, texts):
    got = registry.QUERIES["op11_suffix_dedup"](spark, sf_dir)
    assert got.columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    want = brute([(i, (texts[i] or "").encode()) for i in sorted(texts)])
    assert rows(got) == want
    assert sum(w[2] for w in want) > 10_000


def test_repetitions_inside_and_between_texts(spark, documents, monkeypatch):
    # slices shorter than the texts, so that windows of long ones lie in several pieces
    monkeypatch.setattr(suffix_dedup, "SLICE", 700)
    r = random.Random(4)
    word = lambda: "".join(r.choice("etaoinß") for _ in range(r.randrange(1, 9)))
    passage = " ".join(word() for _ in range(60))
    docs = ["a" * 450, "ab" * 300, passage, "", None, passage[:99], "x" + passage[:100], passage[40:150] * 3]
    docs += [" ".join(word() for _ in range(20)) + passage[r.randrange(80) : r.randrange(120, 330)] + word() for _ in range(60)]
    docs += [" ".join(word() for _ in range(3000)) + passage, "ab" * 40 + "a" * 120]
    got = suffix_dedup.suffix_dedup(documents(docs))
    want = brute([(i, (t or "").encode()) for i, t in enumerate(docs)])
    assert rows(got) == want
    # keys with many segments are cut into windows
    assert rows(suffix_dedup.suffix_dedup(documents(docs), hot=3, shard_bytes=2000)) == want
    for row in got.collect():
        raw = (docs[row.doc_id] or "").encode()
        keep = np.ones(len(raw), bool)
        for s in row.spans:
            keep[s.a : s.b] = False
        assert bytes(np.frombuffer(raw, np.uint8)[keep]) == row.kept and len(row.spans) == row.n_spans


def test_edge_cases(spark, documents):
    one, two = "q" * 30 + "abcdefghij" * 12, "abcdefghij" * 12
    # repeated rows are one document, repeated ids are ordered by their texts
    found = rows(suffix_dedup.suffix_dedup(documents([(5, one), (5, one), (6, two)])))
    want = brute([(5, one.encode()), (6, two.encode())])
    assert found == [want[0], want[0], want[1]]
    found = suffix_dedup.suffix_dedup(documents([(None, two), (1, two), (None, None), (2, two), (2, one)])).collect()
    assert {r.doc_id: r.n_removed for r in found if r.n_bytes == 120}[1] == 120
    assert {(r.doc_id, r.n_removed) for r in found if r.n_bytes == 0} == {(None, 0)}
    assert rows(suffix_dedup.suffix_dedup(documents([]))) == []
    docs = documents([(5, one), (6, two)])
    extra = docs.selectExpr("*", "1 AS id", "2 AS g", "3 AS key", "4 AS r", "5 AS body")
    assert rows(suffix_dedup.suffix_dedup(extra)) == rows(suffix_dedup.suffix_dedup(docs))


def test_only_segments_with_a_recurring_window_are_sorted(monkeypatch):
    """A gram that many segments share between different bytes gives nothing to sort."""
    draw = np.random.default_rng(3)
    noise = lambda n: draw.integers(0, 256, n, np.uint8).tobytes()
    gram, whole = b"a gram of many segments" * 2, noise(120)
    contents = [noise(60) + gram + noise(60) for _ in range(50)] + [whole + b"x", b"y" + whole, b"z" * 150]
    keys, places = np.array([7] * 52 + [8], np.int64), np.arange(53) << 31
    sorted_ones, plain = [], suffix_dedup.equal_windows
    monkeypatch.setattr(suffix_dedup, "equal_windows", lambda groups, window: sorted_ones.extend(x for g in groups for x in g) or plain(groups, window))
    got = suffix_dedup.repeated(keys, contents, places, 100)
    assert got == [[]] * 51 + [[(1, 121)], [(1, 150)]]
    assert sorted(sorted_ones) == sorted(contents[50:])
