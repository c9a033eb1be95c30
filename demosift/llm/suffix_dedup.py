"""Removing byte strings that occurred before, with suffix arrays.

A document's windows of ``WINDOW`` bytes are gathered into segments: runs of windows that share their smallest hashed
gram (their key).  Equal windows have equal keys, so all occurrences of a window meet in the shard of its key.  Keys
that occur once in the corpus hold no repeated window; equal segments are collapsed to one row with the first place
they occur at.  A shard sorts the suffixes of its distinct segments, key by key, by induced sorting; permuted common
prefixes of a window's length or more link the places of equal windows, and all but the earliest one are repeated.

Segments of a shard none of whose windows shares a 64-bit hash with another window have no two equal windows to sort: most
share a key's gram and not a whole window.  A key with very many distinct segments (a line in a third of all texts, each time between other words) has its
segments cut into single windows, which are compared as wholes, by two 64-bit hashes: most of them occur once.
Texts travel compressed.

Defined results: a null text is empty; documents are ordered by id (null first), repeated ids by a hash of their
text; rows equal in id and text are one document and do not remove each other's bytes; texts shorter than a window
lose nothing; texts are cut into slices of bounded bytes, with a window's overlap, however long they are; other
columns are ignored; an empty table gives an empty one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import partitions, stored
from .suffix_array import equal_windows

WINDOW, GRAM = 100, 32
#: Windows of a segment, distinct segments of a key, bytes of a shard, at most or so.
LONGEST, HOT, SHARD = 64, 4000, 1_000_000
#: Bytes of text that are hashed at a time.
SLICE = 1 << 20
#: Of so many documents one is looked at for keys that very many share; such keys are no more than that.
SAMPLED, MOST_HOT = 64, 50_000
_LETTERS = np.random.default_rng(11).integers(0, 2**63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15


def gram_hashes(flat: np.ndarray, gram: int) -> np.ndarray:
    """Mixed polynomial hashes of all grams of bytes, put together from those of half the length."""
    h, n, out, done = _LETTERS[flat], 1, None, 0
    joined = lambda a, b, size: a[: len(b) - size] * np.uint64(pow(_BASE, len(flat) - len(b) + 1, 1 << 64)) + b[size:]
    while n <= gram:
        if gram & n:
            out = h if out is None else joined(out, h, done)
            done += n
        if 2 * n <= gram:
            h = joined(h, h, n)
        n *= 2
    out = out ^ out >> np.uint64(31)
    out *= np.uint64(0xD6E8FEB86659FD93)
    out ^= out >> np.uint64(29)
    return out


def _sliding(x: np.ndarray, wide: int, best: np.ufunc) -> np.ndarray:
    """The best of every ``wide`` neighbours."""
    low, width = x, 1
    while 2 * width <= wide:
        low = best(low[:-width], low[width:])
        width *= 2
    n = len(x) - wide + 1
    return best(low[:n], low[wide - width : wide - width + n])


class Slice:
    """Texts that lie one behind the other: the keys of their windows."""

    def __init__(self, flat: np.ndarray, sizes: np.ndarray, window: int, gram: int):
        self.window, self.wide = window, window - gram + 1
        self.begins = np.cumsum(sizes) - sizes
        n = max(0, len(flat) - window + 1)
        self.grams = gram_hashes(flat, gram) if n else np.zeros(0, np.uint64)
        self.keys = _sliding(self.grams, self.wide, np.minimum) if n else np.zeros(0, np.uint64)
        # windows that end in their text
        change = np.zeros(len(flat) + 1, np.int32)
        long = sizes >= window
        np.add.at(change, self.begins[long], 1)
        np.add.at(change, (self.begins + sizes - window + 1)[long], -1)
        self.whole = np.cumsum(change)[:n] > 0

    def own(self, places: np.ndarray) -> np.ndarray:
        """The text of each place; empty texts have none."""
        return np.searchsorted(self.begins, places, side="right") - 1

    def chosen(self) -> tuple[np.ndarray, np.ndarray]:
        """Text and key of every gram that is the smallest of some window."""
        if not len(self.keys):
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        padded = np.zeros(len(self.grams) + self.wide - 1, np.uint64)
        padded[self.wide - 1 : self.wide - 1 + len(self.keys)] = np.where(self.whole, self.keys, 0)
        found = np.flatnonzero(_sliding(padded, self.wide, np.maximum) == self.grams)
        return self.own(found), self.grams[found]

    def segments(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Text, key, first byte and number of windows of every run of windows with one key."""
        if not self.whole.any():
            return tuple(np.zeros(0, t) for t in (np.int64, np.uint64, np.int64, np.int64))
        border = np.zeros(len(self.keys), bool)
        border[self.begins[self.begins < len(self.keys)]] = True
        border[1:] |= (self.keys[1:] != self.keys[:-1]) | (self.whole[1:] != self.whole[:-1])
        border[0] = True
        starts = np.flatnonzero(border)
        counts = np.diff(np.append(starts, len(self.keys)))
        counts, starts = counts[self.whole[starts]], starts[self.whole[starts]]
        parts = -(-counts // LONGEST)
        inner = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        ends = np.repeat(starts + counts, parts)
        starts = np.repeat(starts, parts) + inner * LONGEST
        own = self.own(starts)
        return own, self.keys[starts], starts - self.begins[own], np.minimum(ends - starts, LONGEST)


def _pieces(texts: pa.Array, window: int) -> Iterator[tuple[list[int], list[int], np.ndarray, np.ndarray]]:
    """Texts in slices of bounded bytes: rows, where each piece begins in its text, all bytes, sizes.

    A text longer than a slice is cut so that each of its windows is in one piece.
    """
    rows: list[int] = []
    begins: list[int] = []
    parts: list[memoryview] = []
    size = 0

    def joined() -> tuple[list[int], list[int], np.ndarray, np.ndarray]:
        return rows, begins, np.frombuffer(b"".join(parts), np.uint8), np.fromiter(map(len, parts), np.int64, len(parts))

    for row, text in enumerate(texts):
        raw = memoryview(text.as_buffer()) if text.is_valid else memoryview(b"")
        for at in range(0, max(1, len(raw) - window + 1), SLICE):
            part = raw[at : at + SLICE + window - 1]
            if parts and size + len(part) > SLICE:
                yield joined()
                rows, begins, parts, size = [], [], [], 0
            rows.append(row)
            begins.append(at)
            parts.append(part)
            size += len(part)
    if parts:
        yield joined()


def _batches(batches: Iterator[pa.RecordBatch], text: int) -> Iterator[pa.RecordBatch]:
    """Rows of about eight slices of text at most, or one row."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
        at = 0
        while at < batch.num_rows:
            n = max(1, int(np.searchsorted(np.cumsum(sizes[at : at + 4096]), 8 * SLICE, side="right")))
            yield batch.slice(at, n)
            at += n


def _packed(rows: DataFrame, kind: str) -> DataFrame:
    """``id, g, r, text`` with every text compressed; null is empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=3).compress
        for batch in _batches(batches, 3):
            texts = pa.array([pack(x.as_buffer() if x.is_valid else b"") for x in batch.column(3)], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], texts], ["id", "g", "r", "text"])

    return rows.select("id", "g", "r", "text").mapInArrow(run, f"id {kind}, g long, r long, text binary")


def _unpacked(batch: pa.RecordBatch, column: int) -> Iterator[tuple[pa.RecordBatch, pa.Array]]:
    """Rows of about eight slices of text at most, or one row, with their texts."""
    unpack = zstandard.ZstdDecompressor().decompress
    begin, held, size = 0, [], 0
    for i, x in enumerate(batch.column(column)):
        raw = unpack(x.as_buffer())
        if held and size + len(raw) > 8 * SLICE:
            yield batch.slice(begin, i - begin), pa.array(held, pa.binary())
            begin, held, size = i, [], 0
        held.append(raw)
        size += len(raw)
    if held:
        yield batch.slice(begin), pa.array(held, pa.binary())


def _keyed(rows: DataFrame, window: int, gram: int) -> DataFrame:
    """``key, r, n``: how often each key's gram occurs in a document; ``r`` is a hash of its id and text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _batches(batches, 1):
            r = batch.column(0).to_numpy()
            for at, _, flat, sizes in _pieces(batch.column(1), window):
                own, keys = Slice(flat, sizes, window, gram).chosen()
                own = np.array(at)[own]
                order = np.lexsort((keys, own))
                own, keys = own[order], keys[order]
                new = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]) | (own[1:] != own[:-1])])) if len(keys) else np.zeros(0, np.int64)
                counts = np.diff(np.append(new, len(keys))).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(keys[new].view(np.int64)), pa.array(r[own[new]]), pa.array(counts)], ["key", "r", "n"])

    return rows.select("r", "text").mapInArrow(run, "key long, r long, n int")


def _shared_keys(rows: DataFrame, window: int, gram: int) -> DataFrame:
    """``key, r`` of keys that occur twice at least.

    Keys that many documents have would gather in one task each.  They show in a sample of rows: what occurs there
    several times is shared for certain and is dealt by document, all else is dealt and sorted by key.
    """
    spark = rows.sparkSession
    keys = _keyed(rows, window, gram)
    sample = stored(_keyed(rows.where(F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(SAMPLED)) == 0), window, gram), "sampled-keys")
    # so many keys can reach the bar, and no more
    bar = max(16, -(-sample.count() // MOST_HOT))
    hot = F.broadcast(stored(sample.groupBy("key").count().where(F.col("count") >= bar).select("key"), "hot-keys"))
    dealt = keys.join(hot.withColumn("hot", F.lit(True)), "key", "left")
    spread = F.when(F.col("hot"), F.col("r")).otherwise(F.col("key"))
    dealt = dealt.withColumn("n", F.when(F.col("hot"), 2).otherwise(F.col("n"))).withColumn("spread", spread)
    dealt = dealt.repartition(partitions(spark), "spread").sortWithinPartitions("key").select("key", "r", "n")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, r, n = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)
        before: int | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            # the last row waits for the one that follows
            key, r, n = (np.concatenate([x, batch.column(i).to_numpy()]) for i, x in enumerate((key, r, n)))
            same = key[1:] == key[:-1]
            found = (n[:-1] > 1) | same
            found[1:] |= same[:-1]
            if len(found):
                found[0] |= key[0] == before
            yield pa.RecordBatch.from_arrays([pa.array(key[:-1][found]), pa.array(r[:-1][found])], ["key", "r"])
            if len(key) > 1:
                before = int(key[-2])
            key, r, n = key[-1:], r[-1:], n[-1:]
        if len(key) and (n[0] > 1 or key[0] == before):
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(r)], ["key", "r"])

    return dealt.mapInArrow(run, "key long, r long")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


_SEGMENT = (("key", pa.int64()), ("at", pa.int32()), ("n", pa.int32()), ("h", pa.int64()), ("content", pa.binary()))


def _recut(rows: DataFrame, kind: str, window: int, gram: int, texts: bool) -> DataFrame:
    """Of documents with the keys that others share: bytes and digest, and if any key is shared, text and segments."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch, raws in _unpacked(whole, 2):
                shared = batch.column(3)
                told: list[list] = [[], [], [], [], [], []]
                some = np.flatnonzero(shared.is_valid().to_numpy(zero_copy_only=False))
                for at, begins, flat, sizes in _pieces(raws.take(pa.array(some)), window):
                    cut = Slice(flat, sizes, window, gram)
                    own, keys, starts, counts = cut.segments()
                    row = some[np.array(at)[own]]
                    keys = keys.view(np.int64)
                    # the keys of any document of the slice: too many is harmless
                    known = np.unique(np.concatenate([shared[i].values.to_numpy() for i in np.unique(row)])) if len(row) else keys[:0]
                    found = np.flatnonzero(np.isin(keys, known))
                    places = cut.begins[own[found]] + starts[found]
                    raw = flat.tobytes()
                    contents = [raw[a:b] for a, b in zip(places.tolist(), (places + counts[found] + window - 1).tolist(), strict=True)]
                    told[0].append(row[found])
                    for column, x in zip(told[1:], (keys[found], starts[found] + np.array(begins)[own[found]], counts[found], [_signed(xxhash.xxh3_64_intdigest(c)) for c in contents], contents), strict=True):
                        column.extend(x)
                per_row = np.bincount(np.concatenate([*told[0], np.zeros(0, np.int64)]).astype(np.int64), minlength=batch.num_rows)
                offsets = pa.array(np.cumsum(np.append(0, per_row)), pa.int32())
                segments = pa.StructArray.from_arrays([pa.array(x, t) for x, (_, t) in zip(told[1:], _SEGMENT, strict=True)], [n for n, _ in _SEGMENT])
                any_found = (per_row > 0).tolist()
                out = [
                    batch.column(0), batch.column(1),
                    pa.array([len(x.as_buffer()) for x in raws], pa.int64()),
                    pa.array([None if f else hashlib.sha256(x.as_buffer()).hexdigest() for x, f in zip(raws, any_found, strict=True)], pa.string()),
                    pa.array([x.as_py() if f or texts else None for x, f in zip(batch.column(2), any_found, strict=True)], pa.binary()),
                    pa.ListArray.from_arrays(offsets, segments),
                ]
                yield pa.RecordBatch.from_arrays(out, ["id", "g", "n_bytes", "sha", "body", "segments"])

    return rows.mapInArrow(run, f"id {kind}, g long, n_bytes long, sha string, body binary, segments array<struct<key:long,at:int,n:int,h:long,content:binary>>")


def _single(rows: DataFrame, kind: str, window: int) -> DataFrame:
    """Segments cut into single windows, keyed by the whole window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, 1024):
                part = batch.slice(begin, 1024)
                n = part.column(3).to_numpy()
                row = np.repeat(np.arange(len(n)), n)
                step = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
                windows = [c[j : j + window] for c, m in zip(part.column(4).to_pylist(), n.tolist(), strict=True) for j in range(m)]
                keys, h = (pa.array([_signed(f(w)) for w in windows], pa.int64()) for f in (xxhash.xxh64_intdigest, xxhash.xxh3_64_intdigest))
                at = pa.array(part.column(2).to_numpy()[row] + step, pa.int32())
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(row)), part.column(1).take(pa.array(row)), keys, at, pa.array(np.ones(len(row), np.int32)), h], ["id", "g", "key", "at", "n", "h"])

    return rows.select("id", "g", "at", "n", "content").mapInArrow(run, f"id {kind}, g long, key long, at int, n int, h long")


def _recurring(contents: list[bytes], window: int) -> np.ndarray:
    """Whether any window of a segment has a hash that another window has: others hold no two equal windows."""
    out = np.zeros(len(contents), bool)
    if not contents:
        return out
    sizes = np.fromiter(map(len, contents), np.int64, len(contents))
    own = np.repeat(np.arange(len(contents)), sizes)
    at = np.flatnonzero(np.cumsum(sizes)[own] - np.arange(len(own)) >= window)
    hashes = gram_hashes(np.frombuffer(b"".join(contents), np.uint8), window)[at]
    ordered = np.sort(hashes)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if len(twice):
        out[own[at[twice[np.minimum(np.searchsorted(twice, hashes), len(twice) - 1)] == hashes]]] = True
    return out


def repeated(keys: np.ndarray, contents: list[bytes], places: np.ndarray, window: int) -> list[list[tuple[int, int]]]:
    """For each distinct segment, byte intervals covered by windows that occur earlier in another place.

    Segments meet those of their key.  ``places`` orders their first bytes: the place of another byte is that plus
    its number.
    """
    # segments without a window that can be repeated are left out
    order = np.flatnonzero(_recurring(contents, window))
    order = order[np.argsort(keys[order], kind="stable")]
    bounds = np.flatnonzero(np.concatenate([[True], keys[order][1:] != keys[order][:-1], [True]])) if len(order) else np.zeros(1, np.int64)
    groups = [[contents[i] for i in order[a:b].tolist()] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
    at, classes, starts, _ = equal_windows(groups, window)
    out: list[list[tuple[int, int]]] = [[] for _ in contents]
    if not len(at):
        return out
    segment = np.searchsorted(starts, at, side="right") - 1
    inside = at - starts[segment]
    own = places[order[segment]] + inside
    first = np.flatnonzero(np.concatenate([[True], classes[1:] != classes[:-1]]))
    earliest = np.repeat(np.minimum.reduceat(own, first), np.diff(np.append(first, len(own))))
    late = np.flatnonzero(own != earliest)
    late = late[np.lexsort((inside[late], segment[late]))]
    segment, inside = segment[late], inside[late]
    new = np.concatenate([[True], (segment[1:] != segment[:-1]) | (inside[1:] > inside[:-1] + window)]) if len(late) else np.zeros(0, bool)
    begins = np.flatnonzero(new)
    for i, j in zip(begins.tolist(), [*(begins[1:] - 1).tolist(), len(late) - 1], strict=False):
        out[order[segment[i]]].append((int(inside[i]), int(inside[j]) + window))
    return out


def _search(rows: DataFrame, window: int) -> DataFrame:
    """Distinct segments' keys, first places and ``spans``, shard by shard."""
    passed = ("key", "h", "first_id", "first_g", "first_at", "times")
    kind = rows.schema["first_id"].dataType.simpleString()

    def run(shard: pa.Table) -> pa.Table:
        ids, gs, ats = (shard.column(c).to_pylist() for c in ("first_id", "first_g", "first_at"))
        order = {x: n for n, x in enumerate(sorted(set(zip(ids, gs, strict=True)), key=lambda x: (x[0] is not None, x)))}
        places = np.array([(order[i, g] << 31) + at for i, g, at in zip(ids, gs, ats, strict=True)], np.int64)
        found = repeated(shard.column("key").to_numpy(), shard.column("content").to_pylist(), places, window)
        spans = pa.array([[{"a": a, "b": b} for a, b in x] for x in found], pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())])))
        return pa.table([*(shard.column(c) for c in passed), spans], [*passed, "spans"])

    return rows.groupBy("shard").applyInArrow(run, f"key long, h long, first_id {kind}, first_g long, first_at int, times long, spans array<struct<a:int,b:int>>")


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Intervals in order, those that touch as one."""
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


_RESULT = "id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<a:int,b:int>>, kept binary"


def _finish(rows: DataFrame, kind: str, texts: bool) -> DataFrame:
    """Of documents with their removed intervals: what is left."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch, raws in _unpacked(whole, 2):
                out: list[list] = [[], [], [], [], []]
                for body, cut in zip(raws, batch.column(3), strict=True):
                    raw = body.as_py()
                    spans = merged([(s["a"], s["b"]) for s in cut.as_py() or []])
                    ends = [0, *[b for _, b in spans]]
                    kept = b"".join([raw[a:b] for a, b in zip(ends, [*[a for a, _ in spans], len(raw)], strict=True)])
                    for x, v in zip(out, (len(raw) - len(kept), len(spans), hashlib.sha256(kept).hexdigest(), [{"a": a, "b": b} for a, b in spans], kept if texts else None), strict=True):
                        x.append(v)
                types = (pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())])), pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *[pa.array(x, t) for x, t in zip(out, types, strict=True)]], ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans", "kept"])

    return rows.select("id", "n_bytes", "body", "cut").mapInArrow(run, _RESULT.format(kind=kind))


def _whole(rows: DataFrame, kind: str) -> DataFrame:
    """Of documents that keep all: their text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch, raws in _unpacked(whole, 6):
                yield pa.RecordBatch.from_arrays([*batch.columns[:6], raws], [*batch.schema.names[:6], "kept"])

    return rows.mapInArrow(run, _RESULT.format(kind=kind))


def suffix_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, gram: int = GRAM, hot: int = HOT, shard_bytes: int = SHARD, texts: bool = True) -> DataFrame:
    """``id, n_bytes, n_removed, n_spans, kept_sha256, spans, kept``: removed byte intervals of every document, and the
    bytes that are left of it (null without ``texts``)."""
    kind = df.schema[id_col].dataType.simpleString()
    rows = df.select(df[id_col].alias("id"), df[text_col].cast("string").cast("binary").alias("text"))
    rows = rows.withColumn("g", F.xxhash64("text")).withColumn("r", F.xxhash64("id", "g"))
    # one list for all rows that repeat a document; documents whose hashes agree share a list, which is harmless
    of = stored(_shared_keys(rows, window, gram).groupBy("r").agg(F.collect_set("key").alias("keys")), "shared-keys")
    marked = _packed(rows, kind).join(of, "r", "left").select("id", "g", "text", "keys")
    docs = stored(_recut(marked, kind, window, gram, texts), "recut")

    place = ["key", "h"]
    told = docs.where("sha IS NULL")
    full = told.select("id", "g", F.explode("segments").alias("s")).select("id", "g", "s.*")
    names = ["id", "g", "key", "at", "n", "h"]
    found = full.select(names)
    # only keys that occur that often can have so many distinct segments; stored, so that the planner sees how few
    often = stored(found.groupBy("key").count().where(F.col("count") > hot).select("key"), "often-keys")
    wide = found.select(*place).join(often, "key", "left_semi").distinct().groupBy("key").count().where(F.col("count") > hot).select("key")
    wide = stored(wide, "wide-keys")
    single = stored(_single(full.join(wide, "key", "left_semi"), kind, window), "single-windows")
    where = F.min(F.struct("id", "g", "at")).alias("first")
    first_at = [F.col(f"first.{c}").alias(f"first_{c}") for c in ("id", "g", "at")]
    twice = single.groupBy(*place).agg(where, F.count("*").alias("times")).where("times > 1").select(*place, *first_at)
    occurrences = found.join(wide, "key", "left_anti")
    distinct = full.join(wide, "key", "left_anti").groupBy(*place).agg(where, F.count("*").alias("times"), F.first("content").alias("content"))
    distinct = distinct.select(*place, *first_at, "times", "content")
    total = occurrences.agg(F.sum(F.col("n") + window - 1)).first()[0] or 0
    shards = max(1, -(-total // (2 * shard_bytes)))
    first = _search(distinct.withColumn("shard", F.pmod(F.xxhash64("key"), F.lit(shards))), window).where("times > 1 OR size(spans) > 0").drop("times")
    none = F.array().cast("array<struct<a:int,b:int>>")
    first = stored(first.unionByName(twice.withColumn("spans", none)), "spans")
    hits = occurrences.unionByName(single).join(first, place)
    same = F.col("id").eqNullSafe(F.col("first_id")) & (F.col("g") == F.col("first_g")) & (F.col("at") == F.col("first_at"))
    all_of_it = F.array(F.struct(F.lit(0).alias("a"), (F.col("n") + window - 1).cast("int").alias("b")))
    cut = F.transform(F.when(same, F.col("spans")).otherwise(all_of_it), lambda s: F.struct((s["a"] + F.col("at")).alias("a"), (s["b"] + F.col("at")).alias("b")))
    hits = hits.select(F.col("id").alias("of"), F.col("g").alias("of_g"), cut.alias("cut")).where(F.size("cut") > 0)
    hits = stored(hits.groupBy("of", "of_g").agg(F.flatten(F.collect_set("cut")).alias("cut")), "cuts")
    changed = told.select("id", "g", "n_bytes", "body").join(hits, F.col("id").eqNullSafe(F.col("of")) & (F.col("g") == F.col("of_g")), "left")
    zero = F.lit(0).cast("long")
    rest = docs.where("sha IS NOT NULL").select("id", "n_bytes", zero.alias("n_removed"), zero.alias("n_spans"), F.col("sha").alias("kept_sha256"), none.alias("spans"), "body")
    rest = _whole(rest, kind) if texts else rest.withColumnRenamed("body", "kept")
    return rest.unionByName(_finish(changed, kind, texts)).withColumnRenamed("id", id_col)


ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
v AS (SELECT doc_id, i, md5(substr(x, 2 * i - 1, 200)) AS g FROM (SELECT doc_id, x, unnest(range(1, length(x) // 2 - 98)) AS i FROM d)),
f AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY g ORDER BY doc_id, i) AS nth FROM v) WHERE nth > 1),
c AS (SELECT doc_id, i, CASE WHEN i - lag(i) OVER w <= 100 THEN 0 ELSE 1 END AS cut FROM f WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
s AS (SELECT doc_id, min(i) AS a, max(i) + 100 AS b FROM (SELECT doc_id, i, sum(cut) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM c) GROUP BY doc_id, k),
p AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 1) AS before FROM s),
k AS (SELECT doc_id, sum(b - a)::BIGINT AS n, count(*) AS spans, string_agg(substr(x, 2 * before - 1, 2 * (a - before)), '' ORDER BY a) || substr(any_value(x), 2 * max(b) - 1) AS kept FROM p JOIN d USING (doc_id) GROUP BY doc_id)
SELECT doc_id, (length(x) // 2)::BIGINT AS n_bytes, coalesce(n, 0)::BIGINT AS n_removed, coalesce(spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(kept, x))) AS kept_sha256 FROM d LEFT JOIN k USING (doc_id)
"""
