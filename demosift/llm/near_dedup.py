"""Near copies by Jaccard likeness of word shingles, found through minima and SimHash, each pair verified.

Texts with the same set of shingles are one class.  Classes that share a minimum of their shingles' hashes (one of
several, under different orders) are candidates: two sets alike by 0.8 miss six minima once in 15,000 times.  Inside a
minimum, pivot distance tables discard pairs whose SimHash fingerprints differ in more than ``BITS`` bits, and what
survives is verified by the sets themselves.  First a class is paired with one or two earlier ones of each minimum, which
settles groups of copies; then with the few of each minimum that lie nearest to its middle; then with every other one of its
minima that these links left in another component.  Before sets are moved, occupied bits of a short table tell exactly of
most of these pairs that they differ in too many shingles.
A minimum that very many classes share (a passage in a third of all texts) is cut by further minima.

Sets are exact up to ``MOST`` shingles; of a larger one the shingles are kept whose hash falls into a fraction of a
power of two, and two sets are compared over the smaller fraction of theirs.

Defined results: null and wordless texts are one class; texts of fewer words than a shingle are one shingle; rows
without id stay; a class keeps its row with the smallest id; ids that repeat with other texts are rows of their own;
other columns pass through; an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import partitions, stored
from .components import components
from .simhash import pivot_table

WIDTH, LIKENESS, BITS, MINIMA = 5, 0.8, 20, 6
#: Bits within which one earlier class of a group is enough, earlier ones that a class is linked to where none is.
NEAR, EARLIER = 12, 2
#: Shingles of a set that is kept whole, classes of a group.
MOST, HOT = 512, 2000
#: Bits that say where a set has shingles.
TABLE = 1024
#: Places in the middle of a group that all others are compared with.
HUBS = 4
#: Pairs that a task holds before it gives them on.
PAIRS = 1 << 20
_ORDERS = np.random.default_rng(13).integers(0, 2**63, 2 * MINIMA, np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(text: bytes, width: int = WIDTH) -> np.ndarray:
    """Distinct hashes of a text's word shingles, sorted."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    whole = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    n = max(1, len(words) - width + 1)
    begins = np.concatenate([[0], ends[:-1]])[:n]
    stops = ends[min(width, len(words)) - 1 :] - 1
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(whole[a:b], 42) for a, b in zip(begins.tolist(), stops.tolist(), strict=True)], np.uint64))


def described(hashes: np.ndarray) -> tuple[int, list[int], int, bytes]:
    """SimHash of a set, its minima, the power of the fraction that is kept, and that fraction, 32 bits each."""
    if not len(hashes):
        return 0, [0] * len(_ORDERS), 0, b""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 65536):
        ones += np.unpackbits(hashes[at : at + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    fp = np.packbits(2 * ones > len(hashes), bitorder="little").view(np.int64)[0]
    minima = [int((hashes * o).min().view(np.int64)) for o in _ORDERS]
    power = min(12, max(0, int(np.ceil(np.log2(len(hashes) / MOST)))))
    # the lowest bits choose the fraction, the highest name the shingle
    part = hashes[hashes & np.uint64((1 << power) - 1) == 0]
    return int(fp), minima, power, np.unique((part >> np.uint64(32)).astype(np.uint32) & np.uint32(0xFFFFF000) | (part & np.uint64(0xFFF)).astype(np.uint32)).tobytes()


def likeness(p: int, a: bytes, q: int, b: bytes) -> float:
    """Jaccard likeness of two sets, over the smaller of their fractions."""
    x, y = np.frombuffer(a, np.uint32), np.frombuffer(b, np.uint32)
    mask = np.uint32((1 << max(p, q)) - 1)
    if p != q:
        x, y = x[x & mask == 0], y[y & mask == 0]
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both / max(1, len(x) + len(y) - both) if len(x) + len(y) else 1.0


def _described(rows: DataFrame, kind: str, width: int) -> DataFrame:
    """``id, g, s, fp, minima, power, part, size, occupied`` of every row; ``s`` is a hash of its set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(2)), 0).to_numpy(zero_copy_only=False))
            at = 0
            while at < batch.num_rows:
                # a few megabytes of text at a time
                n = max(1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + (4 << 20), side="right")) - at)
                part = batch.slice(at, n)
                at += n
                sets = [shingles(t.as_py() or b"", width) for t in part.column(2)]
                told = [(xxhash.xxh3_64_intdigest(h.tobytes()), *described(h)) for h in sets]
                s, fp, minima, power, kept = zip(*told, strict=True)
                size, table = [len(k) // 4 for k in kept], [occupied(k) for k in kept]
                columns = [pa.array(np.array(s, np.uint64).view(np.int64)), pa.array(fp, pa.int64()), pa.array(minima, pa.list_(pa.int64())), pa.array(power, pa.int32()), pa.array(kept, pa.binary()), pa.array(size, pa.int32()), pa.array(table, pa.binary())]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *columns], ["id", "g", "s", "fp", "minima", "power", "part", "size", "occupied"])

    return rows.select("id", "g", "text").mapInArrow(run, f"id {kind}, g long, s long, fp long, minima array<long>, power int, part binary, size int, occupied binary")


def near_earlier(fps: np.ndarray, bits: int) -> list[tuple[int, int]]:
    """For every place an earlier one whose fingerprint is within ``NEAR`` bits, or else up to ``EARLIER`` within ``bits``.

    Pivots discard before bits are counted.  In a group of copies the first place settles all others.  These are not all
    pairs: what they leave apart is for ``near_apart``.
    """
    table = pivot_table(fps)
    found: list[tuple[int, int]] = []
    missing = np.ones(len(fps), np.int64)
    for most, wanted in ((min(NEAR, bits), 1), (bits, EARLIER)):
        missing[missing > 0] = wanted
        for a in range(len(fps) - 1):
            later = a + 1 + np.flatnonzero(missing[a + 1 :] > 0)
            if not len(later):
                break
            later = later[np.abs(table[later] - table[a]).max(axis=1) <= most]
            later = later[np.bitwise_count(fps[later] ^ fps[a]) <= most]
            missing[later] -= 1
            found += [(a, b) for b in later.tolist()]
    return found


def occupied(part: bytes) -> bytes:
    """Which of ``TABLE`` bits the shingles of a set fall on.  Sets differ in at least as many shingles as their bits do."""
    bits = np.zeros(TABLE, np.uint8)
    bits[np.frombuffer(part, np.uint32) >> np.uint32(32 - TABLE.bit_length() + 1)] = 1
    return np.packbits(bits).tobytes()


def near_apart(fps: np.ndarray, roots: np.ndarray, bits: int, sizes: np.ndarray, powers: np.ndarray, tables: np.ndarray, least: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of places within ``bits`` whose roots differ and whose sets can be alike by ``least``, in bounded blocks.

    Sets of equal fractions alike by ``least`` differ in at most ``(1 - least) / (1 + least)`` of the sum of their sizes.
    """
    pivots = pivot_table(fps)
    left, right, held = [], [], 0
    for a in range(len(fps) - 1):
        later = a + 1 + np.flatnonzero(roots[a + 1 :] != roots[a])
        later = later[np.abs(pivots[later] - pivots[a]).max(axis=1) <= bits]
        later = later[np.bitwise_count(fps[later] ^ fps[a]) <= bits]
        differ = np.bitwise_count(tables[later] ^ tables[a]).sum(axis=1, dtype=np.int64)
        later = later[(powers[later] != powers[a]) | (differ <= (sizes[later] + sizes[a]) * (1 - least) / (1 + least) + 1e-6)]
        if len(later):
            left.append(np.full(len(later), a))
            right.append(later)
            held += len(later)
        if held > PAIRS:
            yield np.concatenate(left), np.concatenate(right)
            left, right, held = [], [], 0
    if held:
        yield np.concatenate(left), np.concatenate(right)


def near_hubs(fps: np.ndarray, roots: np.ndarray, bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs within ``bits`` whose roots differ, with the few places nearest to the majority of each bit.

    Copies of one text are more alike to it than to each other, so most are settled here and need not meet each other.
    """
    ones = np.zeros(64, np.int64)
    for at in range(0, len(fps), 65536):
        ones += np.unpackbits(fps[at : at + 65536, None].view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    middle = np.packbits(2 * ones > len(fps), bitorder="little").view(np.uint64)[0]
    for hub in np.argsort(np.bitwise_count(fps ^ middle), kind="stable")[:HUBS]:
        other = np.flatnonzero((roots != roots[hub]) & (np.bitwise_count(fps ^ fps[hub]) <= bits))
        yield np.minimum(other, hub), np.maximum(other, hub)


def _candidates(classes: DataFrame, bits: int, hot: int, least: float, choice: str) -> DataFrame:
    """``a, b``: numbers of classes that share a minimum and have near fingerprints.

    ``choice``: the few of ``near_earlier``, the ``hubs``, or all pairs whose ``root`` differs that can be alike by ``least`` (``apart``).
    """
    columns = ["n", "fp", "root", *(["power", "size", "occupied"] if choice == "apart" else [])]
    dealt = classes.select(*columns, "minima", F.posexplode(F.slice("minima", 1, MINIMA)).alias("i", "value"))
    dealt = dealt.select(*columns, "minima", F.xxhash64("i", "value").alias("key"))
    # of one root, nothing is apart
    roots = F.min("root") < F.max("root") if choice != "earlier" else F.lit(True)
    counts = stored(dealt.groupBy("key").agg(F.count("*").alias("count"), roots.alias("open")).where("count > 1 AND open").drop("open"), "shared-minima")
    dealt = dealt.join(counts, "key")
    further = dealt.where(F.col("count") > hot).select(*columns, "key", F.posexplode(F.slice("minima", MINIMA + 1, MINIMA)).alias("i", "value"))
    further = further.select(*columns, F.xxhash64("key", "i", "value").alias("key"))
    dealt = dealt.where(F.col("count") <= hot).select(*columns, "key").unionByName(further)
    dealt = dealt.repartition(partitions(classes.sparkSession), "key").sortWithinPartitions("key", "n")

    def found(n: np.ndarray, fps: np.ndarray, roots: np.ndarray, *sets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        if choice == "earlier":
            places = np.array(near_earlier(fps, bits), np.int64).reshape(-1, 2)
            chosen = iter([(places[:, 0], places[:, 1])])
        else:
            chosen = near_hubs(fps, roots, bits) if choice == "hubs" else near_apart(fps, roots, bits, *sets, least)
        yield from ((n[a], n[b]) for a, b in chosen)

    def pairs(keys: np.ndarray, *columns: np.ndarray) -> Iterator[pa.RecordBatch]:
        bounds = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1], [True]]))
        left, right, held = [], [], 0
        for i, j in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            for a, b in found(*[c[i:j] for c in columns]) if j - i > 1 else ():
                left.append(a)
                right.append(b)
                held += len(a)
                if held > PAIRS:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(left)), pa.array(np.concatenate(right))], ["a", "b"])
                    left, right, held = [], [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(left)), pa.array(np.concatenate(right))], ["a", "b"])

    def arrays(batch: pa.RecordBatch) -> list[np.ndarray]:
        key, n, fp, root, *sets = batch.columns
        out = [key.to_numpy(), n.to_numpy(), fp.to_numpy().view(np.uint64), root.to_numpy()]
        if sets:
            tables = np.frombuffer(b"".join(sets[2].to_pylist()), np.uint64).reshape(batch.num_rows, -1)
            out += [sets[1].to_numpy().astype(np.int64), sets[0].to_numpy(), tables]
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            more = arrays(batch)
            held = [np.concatenate(x) for x in zip(held, more, strict=True)] if held else more
            cut = int(np.searchsorted(held[0], held[0][-1]))
            if cut:
                yield from pairs(*[x[:cut] for x in held])
                held = [x[cut:] for x in held]
        if held:
            yield from pairs(*held)

    return dealt.select("key", *columns).mapInArrow(run, "a long, b long").distinct()


def _verified(pairs: DataFrame, classes: DataFrame, least: float) -> DataFrame:
    """The pairs whose sets are alike enough."""
    sets = lambda side: classes.select(F.col("n").alias(side), F.col("power").alias(f"power_{side}"), F.col("part").alias(f"part_{side}"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, _, p, x, q, y = (c.to_pylist() for c in batch.columns)
            keep = pa.array([likeness(*t) >= least for t in zip(p, x, q, y, strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], ["a", "b"])

    both = pairs.join(sets("a"), "a").join(sets("b"), "b").select("a", "b", "power_a", "part_a", "power_b", "part_b")
    return both.mapInArrow(run, "a long, b long")


def near_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, least: float = LIKENESS, bits: int = BITS, hot: int = HOT) -> DataFrame:
    """The rows of ``df`` that stay: of each component of near copies the one with the smallest id.

    ``least``: Jaccard likeness of a link; ``bits``: differing bits of a candidate's fingerprints, far above what sets
    alike by 0.8 have (ten on average).
    """
    kind = df.schema[id_col].dataType.simpleString()
    text = F.coalesce(df[text_col].cast("string").cast("binary"), F.lit(b""))
    named = df.select(df[id_col].alias("id"), text.alias("text"), F.xxhash64(text).alias("g")).where("id IS NOT NULL")
    told = stored(_described(named, kind, width), "described")
    one = told.groupBy("s", "fp").agg(F.min(F.struct("id", "g")).alias("first"))
    # of each class one row's set; numbered by their place once stored
    first = one.select(F.col("first.id").alias("id"), F.col("first.g").alias("g"))
    whole = told.join(first, ["id", "g"], "left_semi").dropDuplicates(["id", "g"])
    classes = stored(whole.withColumn("n", F.monotonically_increasing_id()), "classes")
    links, rooted = None, classes.withColumn("root", F.col("n"))
    # few pairs first; what their links leave apart is compared with all of its groups
    for choice in ("earlier", "hubs", "apart"):
        if links is not None:
            roots = components(links).withColumnRenamed("node", "n")
            rooted = stored(classes.drop("id", "g", "s", "part").join(roots, "n", "left").withColumn("root", F.coalesce("root", "n")), "rooted")
        found = stored(_verified(stored(_candidates(rooted, bits, hot, least, choice), choice), classes, least), "links")
        links = found if links is None else links.unionByName(found)
    labels = components(links).join(classes.select(F.col("n").alias("node"), "id", "g"), "node")
    least_of = labels.groupBy("root").agg(F.min(F.struct("id", "g")).alias("least")).select("least.*")
    gone = stored(labels.select("id", "g").join(least_of, ["id", "g"], "left_anti"), "near-copies")
    keep = stored(classes.select("id", "g").join(gone, ["id", "g"], "left_anti"), "kept")
    rows = df.select(F.struct(*[df[c] for c in df.columns]).alias("row"), df[id_col].alias("id"), F.xxhash64(text).alias("g"))
    kept = rows.join(keep, ["id", "g"], "left_semi").dropDuplicates(["id", "g"])
    return kept.select("row.*").unionByName(df.where(F.col(id_col).isNull()))
