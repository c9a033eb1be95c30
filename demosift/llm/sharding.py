"""Sharding through fixed virtual slots.

Rows hash into a fixed number of slots by id and text, bytes are summed per slot, and a small
versioned map assigns slots to shards so that bytes come out near equal.  Rebalancing edits that map:
as few slots as possible move, and no row is hashed again.  All row work is DataFrame expressions; only
the slot table, whose size is fixed, reaches the driver.

Defined results: a null text has no bytes (size 8, checksum 0); rows without id are dealt by their place in the
input, so that any number of them is spread; repeated rows share a virtual slot and get places of their own; other
columns are ignored; an empty table gives an empty one.
"""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import scratch, stored

SLOTS, PER_ROW = 4096, 8
#: Rows of a slot are numbered inside cells of this many rows or so.
CELL = 20_000
MOST_CELLS = 64


def slot_of(id_col: str = "id", crc: str = "text_crc32", slots: int = SLOTS) -> Column:
    name = F.coalesce(F.col(id_col).cast("string"), F.concat(F.lit("#"), F.monotonically_increasing_id().cast("string")))
    return F.pmod(F.xxhash64(name, F.col(crc)), F.lit(slots)).cast("int")


def balanced(slot_bytes: list[int], shards: int) -> list[int]:
    """Largest slot first, each to the shard with the fewest bytes."""
    heap = [(0, 0, s) for s in range(shards)]
    out = [0] * len(slot_bytes)
    for slot in sorted(range(len(slot_bytes)), key=lambda i: (-slot_bytes[i], i)):
        size, n, shard = heapq.heappop(heap)
        out[slot] = shard
        heapq.heappush(heap, (size + slot_bytes[slot], n + 1, shard))
    return out


def rebalanced(old: list[int], slot_bytes: list[int], shards: int, slack: float = 0.001) -> list[int]:
    """Edits a map for new sizes or another number of shards, moving slots only off shards above the mean."""
    out, load = list(old), [0] * max(shards, max(old, default=0) + 1)
    for slot, shard in enumerate(out):
        load[shard] += slot_bytes[slot]
    mean = sum(slot_bytes) / shards
    held: list[list[int]] = [[] for _ in load]
    for slot in sorted(range(len(out)), key=lambda i: (slot_bytes[i], -i)):
        held[out[slot]].append(slot)
    heap = [(load[s], s) for s in range(shards)]
    heapq.heapify(heap)
    for shard in sorted(range(len(load)), key=lambda s: -load[s]):
        spare = []
        while held[shard] and (shard >= shards or load[shard] > mean * (1 + slack)):
            slot = held[shard].pop()
            if shard < shards and load[shard] - slot_bytes[slot] < mean * (1 - slack):
                spare.append(slot)
                continue
            while heap[0][0] != load[heap[0][1]]:
                heapq.heappop(heap)
            to = heap[0][1]
            if to == shard or shard < shards and load[to] + slot_bytes[slot] >= load[shard]:
                spare.append(slot)
                continue
            out[slot] = to
            load[to] += slot_bytes[slot]
            load[shard] -= slot_bytes[slot]
            heapq.heappush(heap, (load[to], to))
            if shard < shards:
                heapq.heappush(heap, (load[shard], shard))
        held[shard] += spare
    return out


def _ints(values: list[int]) -> Column:
    """A constant array, folded when the plan is made."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")


def store_map(spark: SparkSession, path: str, version: int, shards: list[int], slot_bytes: list[int]) -> None:
    """Adds one version of the slot map to the table at ``path``."""
    found = spark.range(0, len(shards), 1, 1).select(F.lit(version).alias("version"), F.col("id").cast("int").alias("virtual_slot"), F.get(_ints(shards), F.col("id").cast("int")).cast("int").alias("shard"), F.get(_ints(slot_bytes), F.col("id").cast("int")).alias("bytes"))
    found.drop("version").write.mode("errorifexists").parquet(f"{path}/version={version}")


def known_map(spark: SparkSession, path: str, slots: int) -> tuple[int, list[int]]:
    """Number and shards of the latest version of a stored map; version 0 and no shards if there is none."""
    from pyspark.errors import AnalysisException

    try:
        rows = load_map(spark, path).collect()
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return 0, []
    if len(rows) != slots:
        raise ValueError(f"the stored map has {len(rows)} slots, not {slots}")
    return rows[0].version, [r.shard for r in sorted(rows, key=lambda r: r.virtual_slot)]


def load_map(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """One version of a stored map, the latest if none is named."""
    found = spark.read.parquet(path)
    if version is None:
        version = found.agg(F.max("version")).first()[0]
    return found.where(F.col("version") == version)


def sized(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", slots: int = SLOTS) -> DataFrame:
    text = F.coalesce(df[text_col].cast("string"), F.lit(""))
    rows = df.select(df[id_col].alias("id"), (F.octet_length(text) + PER_ROW).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    return rows.withColumn("virtual_slot", slot_of(slots=slots))


def shard(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = 24, slots: int = SLOTS, map_path: str | None = None) -> DataFrame:
    """``id, size, text_crc32, virtual_slot, shard, place``: the place counts from 0 inside a shard.

    The map at ``map_path`` (by default a new one below the shared folder) is edited: its latest version, or else
    one that deals out slots in turn, is rebalanced for the bytes found, and the edit is stored as the next
    version, which rows are placed by.  No version is ever written twice.
    """
    spark = df.sparkSession
    # stored: what a row without id is dealt by must not change between passes
    rows = stored(sized(df, id_col, text_col, slots), "sizes")
    totals = {r[0]: (r[1], r[2]) for r in rows.groupBy("virtual_slot").agg(F.sum("size"), F.count("*")).collect()}
    sizes, counts = ([totals.get(s, (0, 0))[k] for s in range(slots)] for k in (0, 1))
    path = map_path or scratch(spark, "slot-map")
    version, old = known_map(spark, path, slots)
    if not old:
        version, old = 1, [slot % shards for slot in range(slots)]
        store_map(spark, path, version, old, [0] * slots)
    store_map(spark, path, version + 1, rebalanced(old, sizes, shards), sizes)
    slot_map = load_map(spark, path, version + 1).select("virtual_slot", "shard")
    cells = min(MOST_CELLS, max(1, -(-max(counts) // CELL)))
    rows = rows.withColumn("cell", F.pmod(F.xxhash64("text_crc32", "id"), F.lit(cells)).cast("int"))
    # slots x cells rows at most, and so below any broadcast limit
    found = rows.groupBy("virtual_slot", "cell").count().join(F.broadcast(slot_map), "virtual_slot")
    before = Window.partitionBy("shard").orderBy("virtual_slot", "cell").rowsBetween(Window.unboundedPreceding, -1)
    found = found.select("virtual_slot", "cell", "shard", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("virtual_slot", "cell").orderBy("id", "text_crc32", "size")
    placed = rows.join(found, ["virtual_slot", "cell"])
    return placed.select(F.col("id").alias(id_col), "size", "text_crc32", "virtual_slot", "shard", (F.col("offset") + F.row_number().over(inside) - 1).cast("long").alias("place"))
