import random
import zlib

import duckdb
import pytest

from demosift.llm import registry, sessions

EVENTS = "user long, s long, b long, h long"


def brute(events, gap):
    """Sessions rebuilt from nothing after every batch."""
    out = {}
    for user in {e[0] for e in events}:
        own = sorted((e for e in events if e[0] == user), key=lambda e: e[1])
        standing = {}
        for batch in sorted({e[2] for e in own}):
            chains = []
            for e in (e for e in own if e[2] <= batch):
                if chains and e[1] - chains[-1][-1][1] <= gap:
                    chains[-1].append(e)
                else:
                    chains.append([e])
            for c in chains:
                new = sum(e[2] == batch for e in c)
                if new:
                    start, end = c[0][1], c[-1][1]
                    gone = [s for s in standing if start <= s <= end]
                    for s in gone:
                        out[standing.pop(s)][5:] = [batch, start]
                    key = (user, batch, start)
                    out[key] = [end, len(c), new, len(gone), sum(e[3] or 0 for e in c), None, None]
                    standing[start] = key
    return sorted((*k, *v) for k, v in out.items())


def found(df, **options):
    return sorted(map(tuple, sessions.session_versions(df, **options).collect()), key=lambda r: tuple(x if x is not None else -1 for x in r))


def same(spark, events, **options):
    want = sorted(brute(events, options.get("gap", 600)), key=lambda r: tuple(x if x is not None else -1 for x in r))
    assert found(spark.createDataFrame(events, EVENTS), **options) == want


def made(seed, users, n, span, slot, late):
    r = random.Random(seed)
    events = []
    for _ in range(n):
        s = r.randrange(-span // 4, span)
        events.append((r.randrange(users), s, s // slot + r.choice((0, 0, 0, 1, late)), r.randrange(1000)))
    return events + r.choices(events, k=n // 5)


def test_random_events_in_small_blocks(spark):
    for seed, span, gap in ((1, 4000, 60), (2, 900, 25), (3, 12000, 30)):
        same(spark, made(seed, 3, 250, span, 30, 3), gap=gap, slot=30, late=3, block=4)


def test_one_user_with_long_chains_over_many_blocks(spark):
    # events every ten seconds, without a break for forty blocks, then breaks
    events = [(7, s, s // 30 + (3 if s % 70 == 0 else 0), s % 11) for s in range(0, 4800, 10)]
    events += [(7, s, s // 30, 1) for s in range(5000, 9000, 170)]
    same(spark, events, gap=45, slot=30, late=3, block=4)


def test_no_event_is_gathered_with_its_users_whole_history(spark):
    df = spark.createDataFrame([(1, s, s // 30, 1) for s in range(0, 9000, 3)], EVENTS)
    rows = sessions._united(df, 30, 3, 4)
    assert rows.groupBy("user", "block").count().agg({"count": "max"}).first()[0] <= 4 * 30


def test_edge_cases(spark):
    assert found(spark.createDataFrame([], EVENTS)) == []
    rows = [(None, 1, 0, 1), (1, None, 0, 1), (1, 5, None, 1), (1, 5, 0, None), (1, 5, 0, None), (1, 5, 0, 4)]
    df = spark.createDataFrame(rows, EVENTS)
    assert found(df) == [(1, 0, 5, 5, 3, 3, 0, 4, None, None)]
    assert found(df.selectExpr("*", "1 AS n", "2 AS block", "'x' AS e", "3 AS batch")) == found(df)
    with pytest.raises(Exception, match="within 3 slots"):
        found(spark.createDataFrame([(1, 0, 4, 1)], EVENTS))
    with pytest.raises(ValueError):
        found(df, gap=900, slot=30, block=30)


def test_turns_are_dealt_by_checksums(spark):
    turns = [(17, 2), (None, 1), (3, None), (-9, -1), (17, 2)]
    got = sorted(map(tuple, sessions.conversation_events(spark.createDataFrame(turns, "conv_id long, turn long")).collect()))
    want = []
    for conv, turn in turns:
        if conv is not None and turn is not None:
            c, h = (zlib.crc32(x.encode()) for x in (str(conv), f"{conv}:{turn}"))
            s, g = c // 2 % 7200 + 300 * turn + h % 600, h // 600
            want.append((2 * (conv // 8) + c % 2, s, s // 900 + (g % 4 if g % 5 == 0 else 0), h))
    assert got == sorted(want)


def test_query_and_sql(spark, sf_dir):
    got = registry.QUERIES["op13_sessions"](spark, sf_dir)
    with duckdb.connect() as db:
        db.sql(f"CREATE VIEW conversations AS SELECT * FROM '{sf_dir}/conversations.parquet'")
        want = db.sql(registry.ORACLES["op13_sessions"])
        assert sorted(got.columns) == sorted(want.columns)
        assert sorted(map(str, map(tuple, got.select(want.columns).collect()))) == sorted(map(str, want.fetchall()))
