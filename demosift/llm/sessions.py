"""Sessions of events that arrive late, batch by batch, with retractions.

An event has a user, a second, a batch it arrives in, and a value.  After each batch, a user's events so far form
sessions: neighbours in time at most ``gap`` apart share one.  A session that holds an event of the batch is a new
version; it retracts the standing sessions that it contains.

Time is cut into blocks of ``block`` slots and a user's blocks are worked on apart, so that no user's history is one
task's.  An event arrives at most ``late`` slots after its own; all that lies further back than that before a block
has arrived when the block's first batch does, and only the last chain of it can still grow.  That chain crosses
into the block as one node with its extent, count, sum and last batch; where it runs through whole blocks it is put
together by pointer jumping.  Inside a block, union-find: the events of a batch are activated and united with
their active predecessor and successor within the gap; roots carry extents, counts, sums and standing versions.

A session's standing version is named by the last batch among its events and by its start: each later batch
with an event in it would have made another.

Defined results: rows without user, second or batch are no events; a null value counts as zero; repeated rows are
repeated events, added up before anything moves, so that a block holds no more rows than it has seconds and batches;
other columns are ignored; an empty table gives an empty one; an event later than ``late`` slots, or earlier than
its own, is an error.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import partitions, stored

GAP, SLOT, LATE, BLOCK = 600, 900, 3, 32
_NODE = ("user", "block", "s", "e", "b", "n", "h")
_VERSION = ("user", "batch", "start_s", "end_s", "n_events", "n_new", "n_retracted", "h_sum", "retracted_batch", "retracted_start_s")


def conversation_events(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn") -> DataFrame:
    """``user, s, b, h`` of the turns of conversations, dealt by checksums; rows without either number are none."""
    rows = turns.select(turns[conv_col].cast("long").alias("conv"), turns[turn_col].cast("long").alias("turn")).where("conv IS NOT NULL AND turn IS NOT NULL")
    text = F.col("conv").cast("string")
    rows = rows.select("conv", "turn", F.crc32(text).alias("c"), F.crc32(F.concat(text, F.lit(":"), F.col("turn").cast("string"))).alias("h"))
    user = F.expr("2 * ((conv - pmod(conv, 8)) div 8) + c % 2")
    rows = rows.select(user.alias("user"), F.expr("(c div 2) % 7200 + 300 * turn + h % 600").alias("s"), "h", F.expr("h div 600").alias("g"))
    late = F.when(F.col("g") % 5 == 0, F.col("g") % 4).otherwise(F.lit(0))
    return rows.select("user", "s", (_div(F.col("s"), SLOT) + late).alias("b"), "h")


def _div(x: Column, by: int) -> Column:
    """Whole part of a quotient, rounded down."""
    return ((x - F.pmod(x, F.lit(by))) / F.lit(by)).cast("long")


def _united(events: DataFrame, slot: int, late: int, block: int) -> DataFrame:
    """Equal seconds and batches of a user as one row, with the block it belongs to."""
    known = events.select("user", F.col("s").cast("long").alias("s"), F.col("b").cast("long").alias("b"), F.coalesce(F.col("h").cast("long"), F.lit(0)).alias("h"))
    known = known.where("user IS NOT NULL AND s IS NOT NULL AND b IS NOT NULL")
    rows = known.groupBy("user", "s", "b").agg(F.count("*").alias("n"), F.sum("h").alias("h"))
    own = _div(F.col("s"), slot)
    fits = (F.col("b") >= own) & (F.col("b") <= own + late)
    rows = rows.withColumn("block", F.when(fits, _div(own + late, block)).otherwise(F.raise_error(F.lit(f"an event does not arrive within {late} slots"))))
    return rows.select("user", "block", "s", F.col("s").alias("e"), "b", "n", "h")


def _chains(rows: DataFrame, gap: int) -> DataFrame:
    """For each user and block: first second, whether the block is one chain, and its last chain."""
    at = Window.partitionBy("user", "block").orderBy("s")
    cut = F.coalesce((F.col("s") - F.lag("s").over(at) > gap).cast("int"), F.lit(0))
    numbered = rows.withColumn("cut", cut).withColumn("chain", F.sum("cut").over(at))
    one = numbered.groupBy("user", "block", "chain").agg(F.min("s").alias("s"), F.max("s").alias("e"), F.max("b").alias("b"), F.sum("n").alias("n"), F.sum("h").alias("h"))
    found = one.groupBy("user", "block").agg(F.min("s").alias("first"), F.count("*").alias("chains"), F.max_by(F.struct("s", "e", "b", "n", "h"), "chain").alias("last"))
    return found.select("user", "block", "first", (F.col("chains") == 1).alias("whole"), "last.*")


def _carried(rows: DataFrame, gap: int) -> DataFrame:
    """``user, block, s, e, b, n, h``: the last chain of all blocks up to this one.

    A block that is one chain and joins the one before passes on what that carries.  Such blocks point back, and
    each round doubles how far; a run of any length takes as many rounds as its length has bits.
    """
    own = stored(_chains(rows, gap), "session-chains")
    # never sent out whole, however few they are
    before = own.select("user", (F.col("block") + 1).alias("block"), F.col("e").alias("before")).hint("merge")
    joined = F.col("whole") & F.coalesce(F.col("first") - F.col("before") <= gap, F.lit(False))
    names = ["user", "block", "s", "e", "b", "n", "h", "to"]
    state = own.join(before, ["user", "block"], "left").withColumn("to", F.when(joined, F.col("block") - 1)).select(names)
    state = stored(state, "session-carry")
    while not (waiting := state.where("to IS NOT NULL")).isEmpty():
        ends = state.select("user", F.col("block").alias("to"), *[F.col(c).alias(f"_{c}") for c in ("s", "b", "n", "h", "to")]).hint("merge")
        moved = waiting.join(ends, ["user", "to"]).select("user", "block", F.col("_s").alias("s"), "e", F.greatest("b", "_b").alias("b"), (F.col("n") + F.col("_n")).alias("n"), (F.col("h") + F.col("_h")).alias("h"), F.col("_to").alias("to"))
        state = stored(state.where("to IS NULL").unionByName(moved), "session-carry")
    return state.drop("to")


class _Sessions:
    """Union-find over the nodes of one user's block, in order of time."""

    def __init__(self, gap: int, s: list[int], e: list[int], b: list[int], n: list[int], h: list[int]):
        self.gap, self.s, self.e, self.b, self.n, self.h = gap, s, e, b, n, h
        self.parent, self.new = list(range(len(s))), list(n)
        self.standing: list[list[tuple[int, int]]] = [[] for _ in s]
        self.active: list[int] = []

    def root(self, i: int) -> int:
        parent = self.parent
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    def unite(self, left: int, right: int) -> None:
        """``right`` starts after ``left``, and close enough to what ``left`` reaches so far."""
        a, c = self.root(left), self.root(right)
        if a == c or self.s[c] - self.e[a] > self.gap:
            return
        if len(self.standing[a]) < len(self.standing[c]):
            keep, gone = c, a
        else:
            keep, gone = a, c
        self.parent[gone] = keep
        self.s[keep], self.e[keep] = min(self.s[a], self.s[c]), max(self.e[a], self.e[c])
        self.b[keep] = max(self.b[a], self.b[c])
        for x in (self.n, self.new, self.h):
            x[keep] += x[gone]
        self.standing[keep] += self.standing[gone]
        self.standing[gone] = []

    def activate(self, i: int) -> None:
        at = bisect_left(self.active, i)
        if at:
            self.unite(self.active[at - 1], i)
        if at < len(self.active):
            self.unite(i, self.active[at])
        self.active.insert(at, i)

    def stand(self, nodes: list[int]) -> Iterator[tuple[int, list[tuple[int, int]]]]:
        """Each root of these nodes with what it retracts; it stands from now on."""
        for r in {self.root(i) for i in nodes}:
            gone = self.standing[r]
            self.standing[r] = [(self.b[r], self.s[r])]
            yield r, gone
            self.new[r] = 0


def block_versions(first_batch: int, gap: int, s: list[int], e: list[int], b: list[int], n: list[int], h: list[int]) -> tuple[list[tuple], list[tuple]]:
    """Versions that one block of one user makes, and what they retract.

    Nodes are sorted by their start; those of batches before ``first_batch`` stand already.  Versions are (batch,
    start, end, events, new ones, retracted sessions, sum), retractions (batch and start of what goes, and of what
    it goes for).
    """
    found = _Sessions(gap, list(s), list(e), list(b), list(n), list(h))
    order = sorted(range(len(s)), key=lambda i: (b[i], i))
    at = 0
    while at < len(order) and b[order[at]] < first_batch:
        found.activate(order[at])
        at += 1
    for _ in found.stand(order[:at]):
        pass
    versions, retracted = [], []
    while at < len(order):
        batch, begin = b[order[at]], at
        while at < len(order) and b[order[at]] == batch:
            found.activate(order[at])
            at += 1
        for r, gone in found.stand(order[begin:at]):
            versions.append((batch, found.s[r], found.e[r], found.n[r], found.new[r], len(gone), found.h[r]))
            retracted += [(*old, batch, found.s[r]) for old in gone]
    return versions, retracted


def session_versions(events: DataFrame, gap: int = GAP, slot: int = SLOT, late: int = LATE, block: int = BLOCK) -> DataFrame:
    """Every version of every session: ``user, batch, start_s, end_s, n_events, n_new, n_retracted, h_sum,
    retracted_batch, retracted_start_s``; the last two name the version that retracts it, null if none does.

    ``events`` has ``user, s`` (second), ``b`` (batch: the second's slot or up to ``late`` more) and ``h``.
    """
    if gap >= block * slot:
        raise ValueError("a block is longer than the gap")
    kind = events.schema["user"].dataType.simpleString()
    rows = stored(_united(events, slot, late, block), "session-events")
    # to the block of its batch an event goes as well, where that comes first
    batch_block = _div(F.col("b"), block)
    nodes = rows.withColumn("block", F.explode(F.array_distinct(F.array("block", batch_block)))).select(*_NODE)
    edge = ((F.col("block") + 1) * block - late) * slot
    left = _carried(rows, gap).where(edge - F.col("e") <= gap).select("user", (F.col("block") + 1).alias("block"), *_NODE[2:])
    dealt = nodes.unionByName(left).repartition(partitions(events.sparkSession), "user", "block").sortWithinPartitions("user", "block", "s", "e")

    def worked(part: pa.Table) -> pa.RecordBatch:
        users, blocks = part.column("user"), part.column("block").to_numpy()
        s, e, b, n, h = (part.column(c).to_pylist() for c in _NODE[2:])
        who = users.to_pylist()
        same = np.array([x == y for x, y in zip(who[1:], who[:-1], strict=True)], bool) & (blocks[1:] == blocks[:-1])
        bounds = [0, *(np.flatnonzero(~same) + 1).tolist(), len(who)]
        out: list[tuple] = []
        for i, j in zip(bounds[:-1], bounds[1:], strict=True):
            made, gone = block_versions(int(blocks[i]) * block, gap, s[i:j], e[i:j], b[i:j], n[i:j], h[i:j])
            user, at = who[i], {}
            for x in made:
                at[x[0], x[1]] = len(out)
                out.append((user, *x, None, None))
            for old_b, old_s, new_b, new_s in gone:
                if (known := at.get((old_b, old_s))) is not None:
                    out[known] = (*out[known][:8], new_b, new_s)
                else:
                    out.append((user, old_b, old_s, None, None, None, None, None, new_b, new_s))
        columns = list(zip(*out, strict=True)) if out else [[]] * len(_VERSION)
        return pa.RecordBatch.from_arrays([pa.array(columns[0], users.type), *[pa.array(c, pa.int64()) for c in columns[1:]]], list(_VERSION))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            # a user's block is held until it is whole; it is no longer than its seconds and batches
            user, at = batch.column(0).to_pylist(), batch.column(1).to_numpy()
            first = len(user) - 1
            while first and user[first - 1] == user[-1] and at[first - 1] == at[-1]:
                first -= 1
            held.append(batch.slice(0, first))
            if first or (held[0].num_rows and (held[0].column(0)[-1].as_py() != user[-1] or held[0].column(1)[-1].as_py() != at[-1])):
                table = pa.Table.from_batches(held)
                cut = table.num_rows
                if cut:
                    yield worked(table)
                held = []
            held.append(batch.slice(first))
            held = [x for x in held if x.num_rows]
        if held:
            yield worked(pa.Table.from_batches(held))

    longs = ", ".join(f"{c} bigint" for c in _VERSION[1:])
    found = dealt.mapInArrow(run, f"user {kind}, {longs}")
    # a retraction in a later block meets the version it retracts
    return found.groupBy("user", "batch", "start_s").agg(*[F.max(c).alias(c) for c in _VERSION[3:]]).select(*_VERSION)


#: A checksum is folded over a table of its 256 steps.
ORACLE_SQL = r"""
WITH RECURSIVE t8(i, x, k) AS (SELECT i::BIGINT, i::BIGINT, 0 FROM range(256) r(i) UNION ALL SELECT i, CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END, k + 1 FROM t8 WHERE k < 8),
t AS (SELECT list(x ORDER BY i) AS t FROM t8 WHERE k = 8),
v AS (SELECT conv_id::BIGINT AS conv, turn::BIGINT AS turn, [ord(x)::BIGINT for x in string_split(conv_id::VARCHAR, '')] AS a, [ord(x)::BIGINT for x in string_split(conv_id || ':' || turn, '')] AS b FROM conversations WHERE turn IS NOT NULL AND conv_id IS NOT NULL),
w AS (SELECT conv, turn, xor(list_reduce(list_prepend(4294967295::BIGINT, a), lambda p, q: xor(p >> 8, t[(xor(p, q) & 255) + 1])), 4294967295) AS c,
  xor(list_reduce(list_prepend(4294967295::BIGINT, b), lambda p, q: xor(p >> 8, t[(xor(p, q) & 255) + 1])), 4294967295) AS h FROM v, t),
u AS (SELECT 2 * floor(conv / 8.0)::BIGINT + c % 2 AS user, (c // 2) % 7200 + 300 * turn + h % 600 AS s, h, h // 600 AS g FROM w),
e AS (SELECT user, s, h, floor(s / 900.0)::BIGINT + CASE WHEN g % 5 = 0 THEN g % 4 ELSE 0 END AS b FROM u),
bs AS (SELECT DISTINCT user, b AS batch FROM e),
-- sessions after a batch, and before it
x AS (SELECT bs.user, batch, k, s, h, b, CASE WHEN s - lag(s) OVER w > 600 THEN 1 ELSE 0 END AS cut FROM bs JOIN e ON e.user = bs.user AND e.b <= batch, (SELECT unnest([0, 1]) AS k) WHERE b + k <= batch WINDOW w AS (PARTITION BY bs.user, batch, k ORDER BY s)),
y AS (SELECT *, sum(cut) OVER (PARTITION BY user, batch, k ORDER BY s) AS chain FROM x),
z AS (SELECT user, batch, k, min(s) AS start_s, max(s) AS end_s, max(b) AS last, count(*) AS n_events, count(*) FILTER (WHERE b = batch) AS n_new, sum(h)::BIGINT AS h_sum FROM y GROUP BY user, batch, k, chain),
ver AS (SELECT * FROM z WHERE k = 0 AND n_new > 0),
gone AS (SELECT ver.user, ver.batch, ver.start_s, z.last AS old_batch, z.start_s AS old_start FROM ver JOIN z ON z.k = 1 AND z.user = ver.user AND z.batch = ver.batch AND z.start_s BETWEEN ver.start_s AND ver.end_s)
SELECT ver.user, ver.batch, ver.start_s, end_s, n_events, n_new, (SELECT count(*) FROM gone g WHERE g.user = ver.user AND g.batch = ver.batch AND g.start_s = ver.start_s) AS n_retracted, h_sum, gone.batch AS retracted_batch, gone.start_s AS retracted_start_s
FROM ver LEFT JOIN gone ON gone.user = ver.user AND gone.old_batch = ver.batch AND gone.old_start = ver.start_s
"""
