import random

import pytest
import xxhash

from demosift.llm import registry, simhash
from demosift.llm.components import components


def brute_print(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    grams = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hs = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(prints):
    """prints: id -> fingerprint."""
    ids = sorted(prints)
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for n, i in enumerate(ids):
        for j in ids[:n]:
            if (prints[i] ^ prints[j]).bit_count() <= 3:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_query_matches_brute_force(spark, sf_dir, texts):
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in registry.op3_simhash(spark, sf_dir).collect()}
    prints = {i: brute_print(t) for i, t in texts.items()}
    comps = brute_components(prints)
    assert got == {i: (f"{prints[i]:016x}", comps[i]) for i in texts}


@pytest.mark.parametrize("hot", [4, 4096])
def test_links_connect_all_close_values(spark, hot):
    rng = random.Random(3)
    values = {rng.getrandbits(64) for _ in range(20)}
    for v in list(values)[:6]:
        for _ in range(40):
            for _ in range(rng.randrange(1, 4)):
                v ^= 1 << rng.randrange(64)
            values.add(v)
    signed = [v - 2**64 if v >> 63 else v for v in sorted(values)]
    df = spark.createDataFrame([(v,) for v in signed], "fp long")
    got = {(r.node): r.root for r in components(simhash.links(df, hot=hot)).collect()}
    want = brute_components({v: v % 2**64 for v in signed})
    groups = lambda m: {frozenset(k for k in m if m[k] == r) for r in set(m.values())}
    assert groups(got) == {g for g in groups(want) if len(g) > 1}


def test_edge_cases(spark, documents):
    df = documents([(5, None), (3, ""), (9, " \t\n"), (1, "a b"), (2, "A B"), (7, "x " * 50_000), (None, "a b"), (1, "a b")]).selectExpr("*", "1 AS fp", "2 AS component")
    got = sorted((r.doc_id or -1, r.component) for r in simhash.near_components(df).collect())
    assert got == [(-1, 1), (1, 1), (1, 1), (2, 1), (3, 3), (5, 3), (7, 7), (9, 3)]
    kept = simhash.near_dedup(df)
    assert kept.columns == df.columns
    assert sorted(r.doc_id or -1 for r in kept.collect()) == [-1, 1, 3, 7]
    assert simhash.near_components(df.limit(0)).count() == 0
    assert simhash.near_dedup(df.limit(0)).count() == 0


def test_components_of_a_long_path_and_a_star(spark):
    path = [(i, i + 1) for i in range(300)] + [(1000, 1000 + i) for i in range(1, 300)] + [(5, 5), (None, 2)]
    got = {r.node: r.root for r in components(spark.createDataFrame(path, "a long, b long")).collect()}
    assert len(set(got.values())) == 2 and len(got) == 601
    assert len({got[i] for i in range(301)}) == 1
