"""SimHash near-duplicates with pivot distance tables.

Fingerprints are collapsed to distinct values first, so copies never meet each other.  Distinct values
that differ in at most three bits agree on one of four 16-bit blocks, and, apart from it, on one of
four blocks of the rest: sixteen keys of 28 bits each find every link.  Inside a key, a table of
Hamming distances to fixed pivots discards every pair whose largest difference in a coordinate exceeds
three (triangle inequality), and only survivors are compared bit by bit.  A key with many values is cut
once more by nine bits of what is left, as exactly as before.  Only a spanning forest of each key's
links leaves the task.

Defined results: null and wordless texts have fingerprint zero and are linked like others; texts of
fewer words than a shingle hash as a whole; repeated rows give repeated results; a row without id
never names a component; columns other than the two named are ignored; an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import partitions, stored
from .components import components

SEED, PIVOTS, HOT_KEY = 42, 16, 4096
PIVOT_BITS = np.random.default_rng(7).integers(0, 2**64, PIVOTS, np.uint64)


def fingerprint(text: bytes, width: int = 3) -> int:
    """SimHash of the XXH64 of all word shingles; a tie in a bit gives zero."""
    words = text.lower().split()
    if not words:
        return 0
    whole = b" ".join(words)
    if len(words) <= width:
        return xxhash.xxh64_intdigest(whole, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    begins = np.concatenate([[0], ends[:-width]])
    stops = ends[width - 1 :] - 1
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(whole[a:b], SEED) for a, b in zip(begins.tolist(), stops.tolist(), strict=True)], np.uint64)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 65536):
        block = hashes[at : at + 65536].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(block, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """``id, fp`` (the 64 bits as a long) of every row."""
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.fromiter((fingerprint(x.as_py() or b"", width) for x in batch.column(1)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], ["id", "fp"])

    return df.select(df[id_col].alias("id"), df[text_col].cast("string").cast("binary").alias("text")).mapInArrow(run, f"id {kind}, fp bigint")


def _print_of(width: int) -> Callable[[Column], Column]:
    """The fingerprint as a column."""

    @F.arrow_udf("bigint")
    def run(texts: pa.Array) -> pa.Array:
        return pa.array(np.fromiter((fingerprint(x.as_py(), width) for x in texts), np.uint64, len(texts)).view(np.int64))

    return run


def _split(rest: Column, bits: int, parts: int) -> list[tuple[Column, Column]]:
    """For each of the equal blocks of the lowest bits: the block, and the other bits closed up."""
    n, out = bits // parts, []
    for i in range(parts):
        block = F.shiftrightunsigned(rest, n * i).bitwiseAND(F.lit((1 << n) - 1))
        low = rest.bitwiseAND(F.lit((1 << n * i) - 1))
        above = n * (i + 1)
        high = F.shiftleft(F.shiftrightunsigned(rest, above), n * i) if above < bits else F.lit(0).cast("long")
        out.append((block, high.bitwiseOR(low)))
    return out


def _keys(fp: Column) -> Column:
    """The sixteen (key, rest) of a fingerprint."""
    out = []
    for i, (head, rest) in enumerate(_split(fp, 64, 4)):
        for j, (sub, left) in enumerate(_split(rest, 48, 4)):
            key = F.lit(4 * i + j).cast("long") * (1 << 28) + head * (1 << 12) + sub
            out.append(F.struct(key.alias("key"), left.alias("rest")))
    return F.array(*out)


def pivot_table(values: np.ndarray) -> np.ndarray:
    return np.bitwise_count(values[:, None] ^ PIVOT_BITS[None, :]).astype(np.int8)


def _links(keys: np.ndarray, values: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Links between values of equal keys, keys sorted: enough to connect what is connected."""
    bounds = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1], [True]]))
    sizes = np.diff(bounds)
    table = pivot_table(values)
    left, right = [], []
    small = np.repeat(sizes <= 8, sizes)
    for d in range(1, 8):
        i = np.flatnonzero(small[: len(keys) - d] & (keys[: len(keys) - d] == keys[d:]))
        if not len(i):
            break
        i = i[np.abs(table[i] - table[i + d]).max(axis=1) <= most]
        i = i[np.bitwise_count(values[i] ^ values[i + d]) <= most]
        left.append(values[i])
        right.append(values[i + d])
    for g in np.flatnonzero(sizes > 8):
        a, b = _forest(values[bounds[g] : bounds[g + 1]], table[bounds[g] : bounds[g + 1]], most)
        left.append(a)
        right.append(b)
    return np.concatenate([*left, values[:0]]), np.concatenate([*right, values[:0]])


def _forest(values: np.ndarray, table: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Breadth first: each value is compared with those not reached yet."""
    rest, queue, left, right = np.arange(len(values)), [], [], []
    while len(rest):
        if queue:
            at = queue.pop()
        else:
            at, rest = rest[0], rest[1:]
        near = np.flatnonzero(np.abs(table[rest] - table[at]).max(axis=1, initial=0) <= most)
        near = near[np.bitwise_count(values[rest[near]] ^ values[at]) <= most]
        if len(near):
            reached = rest[near]
            left.append(np.repeat(values[at], len(near)))
            right.append(values[reached])
            queue += reached.tolist()
            rest = np.delete(rest, near)
    return np.concatenate([*left, values[:0]]), np.concatenate([*right, values[:0]])


def links(values: DataFrame, most: int = 3, hot: int = HOT_KEY) -> DataFrame:
    """Pairs ``a, b`` of distinct fingerprints (column ``fp``) that connect all within ``most`` (up to 3) bits."""
    if not 0 <= most <= 3:
        raise ValueError("the sixteen keys are exact up to three differing bits")
    keyed = values.select("fp", F.explode(_keys(F.col("fp"))).alias("k")).select("fp", "k.key", "k.rest")
    counts = keyed.groupBy("key").count()
    keyed = keyed.join(counts.where("count > 1"), "key")
    finer = F.array(*[F.col("key") * 4096 + (k + 1) * 512 + block for k, (block, _) in enumerate(_split(F.col("rest"), 36, 4))])
    dealt = keyed.select("fp", F.explode(F.when(F.col("count") > hot, finer).otherwise(F.array(F.col("key") * 4096))).alias("key"))
    dealt = dealt.repartition(partitions(values.sparkSession), "key").sortWithinPartitions("key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, fps = np.zeros(0, np.int64), np.zeros(0, np.uint64)

        def found(n: int) -> pa.RecordBatch:
            a, b = _links(keys[:n], fps[:n], most)
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

        for batch in batches:
            keys = np.concatenate([keys, batch.column(1).to_numpy()])
            fps = np.concatenate([fps, batch.column(0).to_numpy().view(np.uint64)])
            if len(keys) >= 200_000 and (n := int(np.searchsorted(keys, keys[-1]))):
                yield found(n)
                keys, fps = keys[n:], fps[n:]
        if len(keys):
            yield found(len(keys))

    return dealt.select("fp", "key").mapInArrow(run, "a bigint, b bigint")


def _linked(df: DataFrame, id_col: str, text_col: str, width: int, most: int, hot: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``id, fp`` of all rows, ``fp, first`` of distinct fingerprints, ``fp, root, first`` of those with a link."""
    prints = stored(fingerprints(df, id_col, text_col, width), "fingerprints")
    classes = stored(prints.groupBy("fp").agg(F.min("id").alias("first")), "classes")
    labels = stored(components(links(classes, most, hot)), "roots")
    return prints, classes, labels.join(classes, labels["node"] == classes["fp"]).select("fp", "root", "first")


def near_components(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, most: int = 3, hot: int = HOT_KEY) -> DataFrame:
    """``id, fp, component``: the smallest id that near-duplicate links reach from a row."""
    prints, classes, known = _linked(df, id_col, text_col, width, most, hot)
    least = known.groupBy("root").agg(F.min("first").alias("component"))
    linked = known.join(least, "root").select("fp", "component")
    # stored, so that the last join reads two plain tables and its hot fingerprints can be split
    of = stored(classes.join(linked, "fp", "left").select("fp", F.coalesce("component", "first").alias("component")), "members")
    return prints.join(of, "fp").select(F.col("id").alias(id_col), "fp", "component")


def hexed(fp: str = "fp") -> Column:
    return F.lower(F.lpad(F.hex(F.col(fp)), 16, "0"))


def near_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, most: int = 3) -> DataFrame:
    """The rows of ``df`` that stay: one of each component, the one with the smallest id and then fingerprint.

    Rows without id cannot be chosen or compared by id; they stay.
    """
    _, classes, known = _linked(df, id_col, text_col, width, most, HOT_KEY)
    named = F.when(F.col("first").isNotNull(), F.struct("first", "fp"))
    linked = known.groupBy("root").agg(F.min(named).alias("least")).select("least.first", "least.fp")
    alone = classes.join(known.select("fp"), "fp", "left_anti").select("first", "fp")
    keep = stored(linked.unionByName(alone).where("first IS NOT NULL"), "kept")
    text = F.coalesce(df[text_col].cast("string").cast("binary"), F.lit(b""))
    rows = df.select(F.struct(*[df[c] for c in df.columns]).alias("row"), df[id_col].alias("id"), _print_of(width)(text).alias("print"))
    kept = rows.join(keep, (F.col("id") == F.col("first")) & (F.col("print") == F.col("fp")), "left_semi").dropDuplicates(["id", "print"])
    return kept.select("row.*").unionByName(df.where(F.col(id_col).isNull()))
