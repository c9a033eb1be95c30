"""Near copies against all pairs of shingle sets."""

import random
from collections import defaultdict
from itertools import combinations

import numpy as np

from demosift.llm import near_dedup


def sets(texts):
    out = {}
    for i, t in texts.items():
        words = "".join(c.lower() if c < "\x80" else c for c in t or "").encode().split()
        out[i] = {tuple(words[j : j + 5]) for j in range(max(1, len(words) - 4))} if words else set()
    return out


def brute_pairs(texts, least=0.8):
    """All pairs of documents that share shingles to this degree; wordless ones are pairs."""
    found, lists, shared = sets(texts), defaultdict(list), defaultdict(int)
    for i in sorted(found):
        for g in found[i] or {()}:
            lists[g].append(i)
    for ids in lists.values():
        for pair in combinations(ids, 2):
            shared[pair] += 1
    return [(a, b) for (a, b), n in shared.items() if n >= least * max(1, len(found[a]) + len(found[b]) - n if found[a] else 1)]


def brute_near(texts):
    """Each document's component: its smallest id."""
    of = {i: i for i in texts}

    def root(i):
        while of[i] != i:
            i = of[i]
        return i

    for a, b in brute_pairs(texts):
        a, b = sorted((root(a), root(b)))
        of[b] = a
    return {i: root(i) for i in texts}


def kept(df, **options):
    return sorted(r.doc_id for r in near_dedup.near_dedup(df, **options).collect())


def test_recall_of_a_whole_table(spark):
    for sf in ("sf0.001", "sf0.01"):
        docs = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet")
        texts = {r.doc_id: r.text for r in docs.collect()}
        stay, linked, different = set(kept(docs)), brute_near(texts), 0
        words = sets(texts)
        pairs = [(a, b) for a, b in brute_pairs(texts) if words[a] != words[b]]
        caught = sum(not (a in stay and b in stay) for a, b in pairs)
        assert caught >= 0.9 * len(pairs)
        # clean documents stay
        assert stay >= {i for i in linked if linked[i] == i}
        different += len(pairs)
    assert different >= 10


def test_copies_with_few_changes_and_a_passage_in_all_texts(spark, documents):
    r = random.Random(8)
    word = lambda: "".join(r.choice("etaoinshrdlu") for _ in range(r.randrange(3, 9)))
    passage = " ".join(word() for _ in range(25))
    base = [word() for _ in range(200)]
    texts = [" ".join(base)]
    for _ in range(30):
        copy = list(base)
        copy[r.randrange(200)] = word()
        texts.append(" ".join(copy))
    texts += [" ".join([word() for _ in range(30)]) + " " + passage + " " + " ".join(word() for _ in range(30)) for _ in range(60)]
    for hot in (near_dedup.HOT, 5):
        assert kept(documents(texts), hot=hot) == [0, *range(31, 91)]


def test_long_sets_are_compared_in_fractions():
    r = random.Random(2)
    words = [str(r.random()) for _ in range(20_000)]
    told = lambda w: near_dedup.described(near_dedup.shingles(" ".join(w).encode()))[2:]
    p, a = told(words)
    q, b = told(words[: 17_000])
    assert p > 0 and len(a) <= 2 * 4 * near_dedup.MOST
    assert abs(near_dedup.likeness(p, a, q, b) - 0.85) < 0.06
    assert near_dedup.likeness(p, a, *told(words[:300])) < 0.1


def test_edge_cases(spark, documents):
    rows = [(None, "a b"), (None, "a b"), (1, None), (2, ""), (3, "a b"), (4, "A  B"), (5, "a c"), (5, "a b"), (5, "a c")]
    got = sorted(((r.doc_id, r.text) for r in near_dedup.near_dedup(documents(rows)).collect()), key=str)
    assert got == sorted([(None, "a b"), (None, "a b"), (1, None), (3, "a b"), (5, "a c")], key=str)
    assert kept(documents(rows).limit(0)) == []
    extra = documents(rows).selectExpr("*", "1 AS id", "2 AS g", "3 AS n", "4 AS s")
    assert kept(extra.where("doc_id IS NOT NULL")) == [1, 3, 5] and near_dedup.near_dedup(extra).columns == extra.columns


def test_no_link_is_lost_behind_earlier_candidates(spark, documents):
    """Texts that lie near in bits but are not alike come first, and each later copy is alike to one text alone."""
    r = random.Random(4)
    word = lambda: "".join(r.choice("etaoinshrdlu") for _ in range(7))
    base = [word() for _ in range(200)]

    def edited(n):
        copy = list(base)
        for at in range(r.randrange(20), 200, 200 // n):
            copy[at] = word()
        return " ".join(copy)

    texts = [edited(8) for _ in range(40)] + [" ".join(base)] + [edited(4) for _ in range(40)]
    near = brute_near(dict(enumerate(texts)))
    assert kept(documents(texts)) == sorted(set(near.values())) == list(range(41))


def test_bits_of_a_table_never_hide_a_link():
    r = np.random.default_rng(5)
    for _ in range(200):
        a = np.unique(r.integers(0, 2**32, 300, np.uint32))
        b = np.unique(np.concatenate([a[: r.integers(200, 301)], r.integers(0, 2**32, r.integers(0, 60), np.uint32)]))
        alike = near_dedup.likeness(0, a.tobytes(), 0, b.tobytes()) >= 0.8
        tables = np.frombuffer(near_dedup.occupied(a.tobytes()) + near_dedup.occupied(b.tobytes()), np.uint64).reshape(2, -1)
        found = list(near_dedup.near_apart(np.zeros(2, np.uint64), np.arange(2), 20, np.array([len(a), len(b)]), np.zeros(2, np.int64), tables, 0.8))
        assert found or not alike
