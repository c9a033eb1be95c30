import random
import zlib
from collections import Counter, defaultdict

import duckdb
import pytest

from demosift.llm import mixing, registry, sharding


def test_shards_are_near_equal_and_places_are_gapless(spark, sf_dir, texts):
    rows = registry.op5_sharding(spark, sf_dir).collect()
    assert {r.doc_id: (r.size, r.text_crc32) for r in rows} == {i: (len(t.encode()) + 8, zlib.crc32(t.encode())) for i, t in texts.items()}
    places, sizes, of = defaultdict(list), Counter(), {}
    for r in rows:
        places[r.shard].append(r.slot)
        sizes[r.shard] += r["size"]
        assert of.setdefault(r.virtual_slot, r.shard) == r.shard
    assert set(places) == set(range(24)) and all(sorted(p) == list(range(len(p))) for p in places.values())
    largest = max(r["size"] for r in rows)
    assert max(sizes.values()) - min(sizes.values()) <= largest


def test_rebalancing_moves_little():
    sizes = [100 + i % 37 for i in range(4096)]
    old = sharding.balanced(sizes, 24)
    new = sharding.rebalanced(old, sizes, 25)
    load = Counter()
    for s, b in zip(new, sizes, strict=True):
        load[s] += b
    mean = sum(sizes) / 25
    assert max(load.values()) < 1.03 * mean and min(load.values()) > 0.9 * mean
    assert sum(a != b for a, b in zip(old, new, strict=True)) < 4096 / 25 * 1.3
    assert all(b == 24 for a, b in zip(old, new, strict=True) if a != b)
    assert set(sharding.rebalanced(old, sizes, 20)) == set(range(20))


def test_map_versions(spark, tmp_path):
    at = f"file://{tmp_path}/map"
    sharding.store_map(spark, at, 1, [0, 1, 0], [5, 6, 7])
    sharding.store_map(spark, at, 2, [0, 1, 1], [5, 6, 7])
    assert [(r.virtual_slot, r.shard, r.bytes) for r in sharding.load_map(spark, at).orderBy("virtual_slot").collect()] == [(0, 0, 5), (1, 1, 6), (2, 1, 7)]
    assert sharding.load_map(spark, at, 1).where("shard = 0").count() == 2


def test_the_stored_map_is_edited_and_used(spark, documents, tmp_path):
    at = f"file://{tmp_path}/map"
    df = documents([(i, "x" * (i * 37 % 400)) for i in range(3000)])
    first = {r.doc_id: r.shard for r in sharding.shard(df, shards=4, slots=256, map_path=at).collect()}
    versions = lambda: [r.version for r in spark.read.parquet(at).select("version").distinct().orderBy("version").collect()]
    assert versions() == [1, 2]
    sharding.store_map(spark, at, 3, [3] * 256, [0] * 256)
    third = sharding.shard(df, shards=4, slots=256, map_path=at).collect()
    assert versions() == [1, 2, 3, 4]
    load = Counter()
    for r in third:
        load[r.shard] += r["size"]
    assert set(load) == {0, 1, 2, 3} and max(load.values()) < 1.2 * min(load.values())
    # one more shard: rows come off the others, and nothing else moves
    before = {r.doc_id: r.shard for r in third}
    after = {r.doc_id: r.shard for r in sharding.shard(df, shards=5, slots=256, map_path=at).collect()}
    assert all(after[i] == s or after[i] == 4 for i, s in before.items()) and len(first) == 3000
    with pytest.raises(ValueError, match="256 slots"):
        sharding.shard(df, shards=4, slots=128, map_path=at)


def test_rows_without_id_are_spread(spark, documents):
    df = documents([(None, "same text")] * 4000)
    load = Counter(r.shard for r in sharding.shard(df, shards=8).collect())
    assert len(load) == 8 and max(load.values()) < 1.5 * min(load.values())


def test_sharding_edge_cases(spark, documents):
    df = documents([(None, None), (None, "a"), (1, "é"), (1, "é"), (2, "")]).selectExpr("*", "1 AS id", "2 AS shard")
    rows = sharding.shard(df, shards=3).collect()
    assert sorted((r.doc_id or 0, r.size, r.text_crc32) for r in rows)[0] == (0, 8, 0) and len(rows) == 5
    assert Counter((r.shard, r.place) for r in rows).most_common(1)[0][1] == 1
    assert sharding.shard(df.limit(0), shards=3).count() == 0


def test_mix_matches_sql(spark, sf_dir):
    got = sorted(registry.op7_mixing(spark, sf_dir).collect())
    con = duckdb.connect()
    con.sql(f"create view documents as from '{sf_dir}/documents.parquet'")
    want = sorted(con.sql(mixing.ORACLE_SQL).fetchall())
    assert [tuple(r) for r in got] == want


def shared_out(sizes, weights=(3, 1, 2), share=1.5, cap=2):
    """Cap what exceeds it and share the excess again, until nothing does."""
    order = sorted(sizes, key=lambda n: (n is None, (n or "").encode()))
    of = {n: weights[i % len(weights)] for i, n in enumerate(order)}
    capped, total = set(), share * sum(sizes.values())
    while True:
        rest = [n for n in order if n not in capped]
        left = total - sum(cap * sizes[n] for n in capped)
        out = {n: cap * sizes[n] for n in capped} | {n: left * of[n] / sum(of[m] for m in rest) for n in rest}
        over = {n for n in rest if out[n] > cap * sizes[n]}
        if not over:
            return out
        capped |= over


def test_targets_reshare_what_exceeds_the_cap(spark):
    rng = random.Random(3)
    cases = [{"a": 10, "b": 1000, None: 1000}, {"a": 5}, {"a": 0, "b": 7}, {"é": 3, "z": 3, "A": 3, None: 0}]
    cases += [{f"s{i}": int(rng.expovariate(1 / 500)) for i in range(rng.randrange(2, 40))} for _ in range(4)]
    for sizes in cases:
        got = {r.source: r.target for r in mixing.targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()}
        want = shared_out(sizes)
        assert got.keys() == want.keys() and all(abs(got[n] - want[n]) < 1e-6 * max(1, want[n]) for n in want)


def test_more_sources_than_any_list_holds(spark):
    df = spark.range(120_000).selectExpr("id AS doc_id", "'a b c' AS text", "CAST(id AS string) AS source")
    got = mixing.mix(df).selectExpr("count(*)", "max(taken)", "sum(taken)").first()
    assert got[0] == 120_000 and got[1] <= 6 and got[2] > 0.9 * 1.5 * 360_000


def test_a_column_of_weights_comes_first(spark, documents):
    rows = documents([(i, "w w", "big") for i in range(2000)] + [(-1, "w " * 20_000, "other")])
    df = rows.selectExpr("*", "IF(doc_id % 2 = 0, 1D, IF(doc_id % 3 = 0, NULL, 0.02D)) AS quality")
    got = {r.doc_id: r.taken / r.size for r in mixing.mix(df, weight_col="quality").collect()}
    mean = lambda xs: sum(xs) / len(xs)
    good, poor = ([v for i, v in got.items() if i >= 0 and (i % 2 == 0 or i % 3 == 0) == g] for g in (True, False))
    assert mean(good) >= mean(poor)


def test_mix_meets_targets_and_bounds(spark, documents):
    rows = [(i, "w " * (1 + i * i % 53) + ("### " * (i % 3)), f"s{i % 4}" if i % 5 else None) for i in range(400)] + [(None, None, "s0"), (3, "", "s1"), (3, "", "s1")]
    df = documents(rows).selectExpr("*", "1 AS size", "2 AS key", "3 AS id")
    rows = mixing.mix(df).collect()
    assert len(rows) == 403 and all(0 <= r.taken <= 2 * r.size for r in rows)
    taken, target = Counter(), {}
    for r in rows:
        taken[r.source_size] += r.taken
        target[r.source_size] = r.target
    assert len(target) == 5 and all(abs(t - taken[n]) < 1 for n, t in target.items())
    assert sorted(map(tuple, rows), key=str) == sorted(map(tuple, mixing.mix(df.repartition(7)).collect()), key=str)
    assert mixing.mix(df.limit(0)).count() == 0
