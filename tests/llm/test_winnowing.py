import hashlib

import xxhash

from demosift.llm import registry, winnowing


def signed(x):
    return x - 2**64 if x >> 63 else x


def word_hash(w):
    return xxhash.xxh64_intdigest(w.encode(), 42)


def rotated(x, by):
    return (x << by | x >> 64 - by) % 2**64


def gram_hash(hs, k):
    """Each word's hash, rotated by how many words of the gram follow."""
    out = 0
    for h in [*hs, *[0] * (k - len(hs))]:
        out = rotated(out, 1) ^ h
    return signed(out)


def brute(text, k=winnowing.K, window=winnowing.WINDOW):
    hs = [word_hash(w.decode()) for w in (text or "").encode().split()]
    if not hs:
        return []
    grams = [gram_hash(hs[i : i + k], k) >> 30 for i in range(max(1, len(hs) - k + 1))]
    kept = []
    for i in range(max(1, len(grams) - window + 1)):
        part = grams[i : i + window]
        at = max(j for j, g in enumerate(part) if g == min(part))
        if (part[at], i + at) not in kept:
            kept.append((part[at], i + at))
    return kept


def jaccard(a, b):
    a, b = {h for h, _ in a}, {h for h, _ in b}
    return len(a & b) / len(a | b) if a | b else 1.0


def expected(docs):
    order = sorted(docs, reverse=True)
    out = {}
    for n, i in enumerate(order):
        text, after = docs[i] or "", docs[order[(n + 1) % len(order)]] or ""
        third = len(text) // 3
        edited = text[: len(text) - third] + after[:third]
        own, changed = brute(text), brute(edited)
        write = lambda f: ",".join(f"{h}@{p}" for h, p in f)
        out[i] = (len(text), hashlib.sha256(edited.encode()).hexdigest(), write(own), write(changed), jaccard(own, changed), jaccard(own, brute(after)))
    return out


def test_query_matches_brute_force(spark, sf_dir, texts):
    got = {r.doc_id: tuple(r)[1:] for r in registry.op6_winnowing(spark, sf_dir).collect()}
    assert got == expected({i: t[:] for i, t in texts.items()})


def test_edge_cases(spark, documents):
    docs = {10**12: None, -5: "", 3: "a", 4: " \t\n", 7: "é😀 b c d", 8: "a b c d e", 9: "x " * 500, 11: "x " * 500, 12: "a b c d e f g h i j k l m"}
    df = documents(list(docs.items())).selectExpr("*", "1 AS body", "2 AS range", "3 AS guest")
    got = {r.doc_id: tuple(r)[1:] for r in winnowing.edited_likeness(df).collect()}
    assert got == expected(docs)
    one = winnowing.edited_likeness(df.where("doc_id = 12")).collect()
    assert len(one) == 1 and one[0].near_next == 1.0
    assert winnowing.edited_likeness(df.limit(0)).count() == 0
    repeated = documents([(None, "a b"), (None, "c d"), (1, "p q r"), (1, "p q r"), (1, "z")])
    assert winnowing.edited_likeness(repeated).count() == 5


def test_any_width_of_gram(spark, documents):
    text = " ".join(f"w{i * i % 11}" for i in range(60))
    for k in (1, 2, 3, 4, 6, 7, 9):
        (row,) = winnowing.fingerprints(documents([text]), k=k).collect()
        assert list(zip(row.hashes, row.positions, strict=True)) == brute(text, k)


def test_ids_at_the_ends_of_the_range_and_missing_ones(spark, documents):
    docs = {2**63 - 1: "a b c d e f g", -(2**63): "x y z", 0: "p q r s t u v w"}
    got = {r.doc_id: tuple(r)[1:] for r in winnowing.edited_likeness(documents(list(docs.items()))).collect()}
    assert got == expected(docs)
    nameless = documents([*docs.items(), *[(None, f"word{i} " * (i % 9)) for i in range(300)]])
    rows = winnowing.edited_likeness(nameless).collect()
    assert len(rows) == 303 and sum(r.doc_id is None for r in rows) == 300
    dealt, _ = winnowing.with_next(nameless.selectExpr("doc_id AS id", "text AS body"), "id")
    assert dealt.where("id is null").groupBy("range").count().count() > 100


def test_ranges_give_every_row_its_follower(spark):
    ids = [*range(0, 3000, 3), *range(10**9, 10**9 + 500)]
    dealt, order = winnowing.with_next(spark.createDataFrame([(i,) for i in ids], "id long"), "id", rows_per_range=50)
    from pyspark.sql import functions as F

    got = dict(dealt.withColumn("n", F.lead("id").over(order)).where("guest = 0").select("id", "n").collect())
    down = sorted(ids, reverse=True)
    assert got == dict(zip(down, [*down[1:], down[0]], strict=True))
    assert dealt.groupBy("range").count().agg(F.max("count")).first()[0] < 300


def test_shared_passages_leave_a_common_hash(spark, documents):
    passage = " ".join(f"w{i}" for i in range(winnowing.K + winnowing.WINDOW - 1))
    rows = winnowing.fingerprints(documents([f"a b c {passage} d", f"{passage} e f g h i j"])).collect()
    assert set(rows[0].hashes) & set(rows[1].hashes)
