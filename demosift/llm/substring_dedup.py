"""Removing passages that occurred before, with an FM-index per shard.

A document's windows of ``WINDOW`` words are gathered into segments: runs of windows that share their
smallest hashed gram (their key).  Equal windows have equal keys, so all occurrences of a window meet in
the shard of its key, whatever the number of shards.  Segments whose key occurs once in the corpus
hold no repeated window and are dropped after counting keys; equal segments are collapsed to one row with
the first place they occur at.  A shard indexes its distinct segments and streams them through the index:
backward search over the wavelet matrix gives matching statistics, the occurrences of matches as long as a
window are located from sampled places, and a window whose earliest occurrence is not its own is
repeated.  Intervals are reported from the statistics of these.

A key with very many distinct segments (a line in a third of all texts, each time between other words)
is cut into single windows, whose keys are hashes of the whole window, before it is dealt to shards.

Defined results: a null text has no words; documents are ordered by id (null first), repeated ids by a
hash of their words; rows repeated word for word are one document and do not remove each other's words;
documents shorter than a window lose nothing; other columns are ignored; an empty table gives an empty one.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored
from .fm_index import FMIndex, intervals

WINDOW, GRAM = 20, 8
#: Windows of a segment, distinct segments of a key, words of a shard, at most or so.
LONGEST, HOT, SHARD = 64, 2000, 150_000
#: Bytes of text whose words are hashed at a time; intervals that are located at a time.
SLICE, LOCATED = 1 << 20, 1 << 16
#: Of so many documents one is looked at for keys that very many share; such keys are no more than that.
SAMPLED, MOST_HOT = 64, 50_000
_ODD = np.random.default_rng(5).integers(0, 2**63, 64, np.uint64) * np.uint64(2) + np.uint64(1)


_SPACES = np.zeros(256, bool)
_SPACES[[9, 10, 11, 12, 13, 32]] = True
#: Powers of an odd number and of its inverse, as long as any slice of texts so far.
_BASE, _powers = 0x9E3779B97F4A7C15, [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_tables(n: int) -> list[np.ndarray]:
    if len(_powers[0]) < n:
        size = 1 << max(16, int(n).bit_length())
        for i, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[i] = np.multiply.accumulate(steps)
    return _powers


def word_hashes(flat: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of texts that lie one behind the other, and how many come before each text.

    A word's polynomial is the difference of two prefix sums over bytes, moved to the power zero.
    """
    if not len(flat):
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    letter, cut = ~_SPACES[flat], np.zeros(len(flat) + 1, bool)
    cut[offsets] = True
    begins = np.flatnonzero(letter & np.concatenate([[True], ~letter[:-1]]) | letter & cut[:-1])
    ends = np.flatnonzero(letter & np.concatenate([~letter[1:], [True]]) | letter & cut[1:]) + 1
    h, i = np.zeros(len(begins), np.uint64), 0
    # so many words at a time that their bytes stay few, however long a text is
    while i < len(begins):
        a, j = begins[i], max(i + 1, int(np.searchsorted(ends, begins[i] + SLICE, side="right")))
        part, at = flat[a : ends[j - 1]], begins[i:j] - a
        up, down = _power_tables(len(part))
        with np.errstate(over="ignore"):
            sums = np.zeros(len(part) + 1, np.uint64)
            np.cumsum((part.astype(np.uint64) + np.uint64(1)) * up[: len(part)], out=sums[1:])
            h[i:j] = (sums[ends[i:j] - a] - sums[at]) * down[at]
        i = j
    with np.errstate(over="ignore"):
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(29)
    return h, np.searchsorted(begins, offsets)


def _grams(h: np.ndarray, gram: int) -> np.ndarray:
    """A mixed rolling hash of every gram of words."""
    m = len(h) - gram + 1
    g = h[:m] * _ODD[0]
    for j in range(1, gram):
        g += h[j : j + m] * _ODD[j]
    g ^= g >> np.uint64(31)
    g *= np.uint64(0x9E3779B97F4A7C15)
    g ^= g >> np.uint64(29)
    return g


def keys_of(h: np.ndarray, window: int = WINDOW, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys of a document, and how often the gram of each occurs in it, from its words' hashes.

    A gram can occur twice in one segment, where a text repeats itself, so grams are counted, not segments.
    """
    if len(h) < window:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    g = _grams(h, gram)
    keys = np.unique(_cut(g, len(h), window, gram)[0])
    g.sort()
    return keys, np.searchsorted(g, keys, side="right") - np.searchsorted(g, keys)


def segments(h: np.ndarray, window: int = WINDOW, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys, first words and numbers of windows of a document's segments."""
    if len(h) < window:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return _cut(_grams(h, gram), len(h), window, gram)


def _cut(g: np.ndarray, n: int, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    low, width, wide = g, 1, window - gram + 1
    while 2 * width <= wide:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    keys = np.minimum(low[: n - window + 1], low[wide - width : wide - width + n - window + 1])
    starts = np.concatenate([[0], np.flatnonzero(keys[1:] != keys[:-1]) + 1])
    counts = np.diff(np.append(starts, len(keys)))
    if counts.max() > LONGEST:
        parts = -(-counts // LONGEST)
        inner = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        ends = np.repeat(starts + counts, parts)
        starts = np.repeat(starts, parts) + inner * LONGEST
        counts = np.minimum(ends - starts, LONGEST)
    return keys[starts], starts, counts


def _slices(batch: pa.RecordBatch, rows: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Rows of about ``SLICE`` bytes of text (column 1), their words' hashes and where each text's begin."""
    sizes = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False)
    at = 0
    while at < batch.num_rows:
        n = max(1, int(np.searchsorted(np.cumsum(sizes[at : at + rows]), SLICE, side="right")))
        part = batch.slice(at, n)
        flat = np.frombuffer(b"".join([x.as_py() or b"" for x in part.column(1)]), np.uint8)
        yield part, *word_hashes(flat, np.concatenate([[0], np.cumsum(sizes[at : at + n])]))
        at += n


def _digest(content: bytes) -> tuple[int, int]:
    a = xxhash.xxh3_128_intdigest(content)
    sign = lambda x: x - (1 << 64) if x >> 63 else x
    return sign(a >> 64), sign(a & (1 << 64) - 1)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _keyed(rows: DataFrame, kind: str, window: int, gram: int) -> DataFrame:
    """``key, id, g, n``: how often each key occurs in a document; ``g`` is a hash of its text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, h, begins in _slices(batch, 1024):
                found = [keys_of(h[a:b], window, gram) for a, b in itertools.pairwise(begins.tolist())]
                at = pa.array(np.repeat(np.arange(len(found)), [len(k) for k, _ in found]))
                keys, counts = (np.concatenate(x) for x in zip(*found, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), part.column(0).take(at), part.column(2).take(at), pa.array(counts.astype(np.int32))], ["key", "id", "g", "n"])

    return rows.select("id", "text", "g").mapInArrow(run, f"key long, id {kind}, g long, n int")


def _shared_keys(keys: DataFrame) -> DataFrame:
    """``key, id, g`` of keys that occur twice at least.

    Keys that many documents have would gather in one task each.  They show in a sample of documents by hash:
    what occurs there several times is shared for certain and goes without a shuffle, all else is counted.
    """
    sample = keys.where(F.pmod(F.xxhash64("id", "g"), F.lit(SAMPLED)) == 0)
    size = sample.count()
    # so many keys can reach the bar, and no more
    bar = max(16, -(-size // MOST_HOT))
    hot = F.broadcast(stored(sample.groupBy("key").count().where(F.col("count") >= bar).select("key"), "hot-keys"))
    rest = keys.join(hot, "key", "left_anti")
    shared = rest.groupBy("key").agg(F.sum("n").alias("total")).where("total > 1").select("key")
    found = rest.join(shared, "key", "left_semi").select("key", "id", "g")
    return found.unionByName(keys.join(hot, "key", "left_semi").select("key", "id", "g"))


_SEGMENT = (("key", pa.int64()), ("at", pa.int32()), ("n", pa.int32()), ("h1", pa.int64()), ("h2", pa.int64()))


def _recut(rows: DataFrame, kind: str, window: int, gram: int, texts: bool) -> DataFrame:
    """Of documents with the keys that others share: digests, and if any key is shared, words and segments.

    The words of other documents stand in ``whole``, if texts are wanted.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, h, begins in _slices(batch, 256):
                out: list[list] = [[], [], [], [], []]
                told: list[list] = [[] for _ in _SEGMENT]
                stops = [0]
                for text, shared, first, last in zip(part.column(1), part.column(2), begins[:-1].tolist(), begins[1:].tolist(), strict=True):
                    words = (text.as_py() or b"").split()
                    body = b" ".join(words)
                    if shared.is_valid:
                        keys, starts, counts = segments(h[first:last], window, gram)
                        keys = keys.view(np.int64)
                        found = np.flatnonzero(np.isin(keys, shared.values.to_numpy()))
                        # where each word begins in the body, to take segments out of it
                        places = np.concatenate([[0], np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)])
                        ends = starts + counts + window - 1
                        digests = [_digest(body[x:y]) for x, y in zip(places[starts[found]].tolist(), (places[ends[found]] - 1).tolist(), strict=True)]
                        for column, values in zip(told, (keys[found].tolist(), starts[found].tolist(), counts[found].tolist(), [d[0] for d in digests], [d[1] for d in digests]), strict=True):
                            column += values
                    any_found = len(told[0]) > stops[-1]
                    stops.append(len(told[0]))
                    out[0].append(len(words))
                    out[1].append(_signed(xxhash.xxh3_64_intdigest(body)))
                    out[2].append(None if any_found else hashlib.sha256(body).hexdigest())
                    out[3].append(body if any_found else None)
                    out[4].append(body if texts and not any_found else None)
                cols = [pa.array(x, t) for x, t in zip(out, (pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.binary()), strict=True)]
                rows = pa.StructArray.from_arrays([pa.array(x, t) for x, (_, t) in zip(told, _SEGMENT, strict=True)], [n for n, _ in _SEGMENT])
                yield pa.RecordBatch.from_arrays([part.column(0), *cols, pa.ListArray.from_arrays(pa.array(stops, pa.int32()), rows)], ["id", "words", "h", "kept", "body", "whole", "segments"])

    return rows.mapInArrow(run, f"id {kind}, words long, h long, kept string, body binary, whole binary, segments array<struct<key:long,at:int,n:int,h1:long,h2:long>>")


def _single(rows: DataFrame, kind: str, window: int) -> DataFrame:
    """Segments cut into single windows, keyed by the whole window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, 512):
                part = batch.slice(begin, 512)
                row, out = [], [[], [], [], [], []]
                for i, (at, n, content) in enumerate(zip(part.column(2).to_pylist(), part.column(3).to_pylist(), part.column(4).to_pylist(), strict=True)):
                    words = content.split(b" ")
                    for j in range(n):
                        one = b" ".join(words[j : j + window])
                        h1, h2 = _digest(one)
                        row.append(i)
                        for x, v in zip(out, (_signed(xxhash.xxh64_intdigest(one)), at + j, h1, h2, one), strict=True):
                            x.append(v)
                take = pa.array(row, pa.int64())
                cols = [pa.array(x, t) for x, t in zip(out, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary()), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0).take(take), part.column(1).take(take), *cols, pa.array(np.ones(len(row), np.int32))], ["id", "h", "key", "at", "h1", "h2", "content", "n"])

    return rows.select("id", "h", "at", "n", "content").mapInArrow(run, f"id {kind}, h long, key long, at int, h1 long, h2 long, content binary, n int")


def _contents(docs: DataFrame, window: int) -> DataFrame:
    """The segments of documents, each with its words, cut inside the document's row."""

    def cut(words: Column) -> Column:
        return F.transform(
            "segments",
            lambda s: F.struct(*[s[n].alias(n) for n, _ in _SEGMENT], F.array_join(F.slice(words, s["at"] + 1, s["n"] + window - 1), " ").cast("binary").alias("content")),
        )

    words = F.split(F.col("body").cast("string"), " ")
    return docs.select("id", "h", F.explode(F.transform(F.array(words), cut)[0]).alias("s")).select("id", "h", "s.*")


def repeated(contents: list[bytes], places: np.ndarray, window: int) -> list[list[tuple[int, int]]]:
    """For each distinct segment, word intervals covered by windows that occur earlier in another place.

    All segments are indexed, and then streamed through the index: matching statistics give every word's longest
    match, up to a window, and the interval of its occurrences.  Occurrences of whole windows are located, and
    a window whose earliest one is not its own is repeated.  ``places`` orders the first words: the place of a
    segment's word is its own plus the word's number.
    """
    sequences = [c.split(b" ") for c in contents]
    index = FMIndex(sequences, window)
    lengths, lo, hi = index.statistics(sequences)
    sizes = np.fromiter(map(len, sequences), np.int64, len(sequences))
    base = np.cumsum(sizes) - sizes
    segment = np.repeat(np.arange(len(sizes)), sizes)
    own = places[segment] + np.arange(len(segment)) - base[segment]
    several = np.flatnonzero((lengths >= window) & (hi - lo > 1))
    if len(several):
        begins, which = np.unique(lo[several], return_inverse=True)
        counts = np.zeros(len(begins), np.int64)
        counts[which] = (hi - lo)[several]
        first = np.cumsum(counts) - counts
        at_text = np.full(index.total, np.iinfo(np.int64).max)
        at_text[np.arange(len(segment)) + segment] = own
        earliest = np.full(len(begins), np.iinfo(np.int64).max)
        for a in range(0, len(begins), LOCATED):
            part = slice(a, a + LOCATED)
            rows = np.repeat(begins[part] - (first[part] - first[a]), counts[part]) + np.arange(counts[part].sum())
            earliest[part] = np.minimum.reduceat(at_text[index.locate(rows)], first[part] - first[a])
        alone = earliest[which] == own[several]
        lengths[several[alone]] = 0
    lengths[(lengths >= window) & (hi - lo == 1)] = 0
    return [intervals(lengths[a : a + n], window) for a, n in zip(base.tolist(), sizes.tolist(), strict=True)]


def _search(rows: DataFrame, window: int) -> DataFrame:
    """Distinct segments' keys, first places and ``spans``, shard by shard."""
    passed = ("key", "h1", "h2", "first_id", "first_h", "first_at")
    kind = rows.schema["first_id"].dataType.simpleString()

    def run(shard: pa.Table) -> pa.Table:
        ids, hs, ats = (shard.column(c).to_pylist() for c in ("first_id", "first_h", "first_at"))
        order = {x: n for n, x in enumerate(sorted(set(zip(ids, hs, strict=True)), key=lambda x: (x[0] is not None, x)))}
        places = np.array([(order[i, h] << 31) + at for i, h, at in zip(ids, hs, ats, strict=True)], np.int64)
        found = repeated(shard.column("content").to_pylist(), places, window)
        spans = pa.array([[{"a": a, "b": b} for a, b in x] for x in found], pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())])))
        return pa.table([*(shard.column(c) for c in passed), spans], [*passed, "spans"])

    return rows.groupBy("shard").applyInArrow(run, f"key long, h1 long, h2 long, first_id {kind}, first_h long, first_at int, spans array<struct<a:int,b:int>>")


def _finish(rows: DataFrame, kind: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            removed, kept, texts = [], [], []
            for body, spans in zip(batch.column(2), batch.column(3), strict=True):
                words = body.as_py().split(b" ")
                keep = np.ones(len(words), bool)
                for s in spans.as_py() or []:
                    keep[s["a"] : s["b"]] = False
                text = b" ".join([words[i] for i in np.flatnonzero(keep).tolist()])
                removed.append(int(len(words) - keep.sum()))
                kept.append(hashlib.sha256(text).hexdigest())
                texts.append(text)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(removed, pa.int64()), pa.array(kept, pa.string()), pa.array(texts, pa.binary())], ["id", "words", "removed", "kept", "text"])

    return rows.mapInArrow(run, f"id {kind}, words long, removed long, kept string, text binary")


def substring_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, gram: int = GRAM, hot: int = HOT, shard_words: int = SHARD, texts: bool = True) -> DataFrame:
    """``id, n_words, n_removed, kept_sha256, text``: the kept words of every document, one space between two.

    Without ``texts`` the text is null where no key is shared, and those words are not stored.
    """
    kind = df.schema[id_col].dataType.simpleString()
    rows = df.select(df[id_col].alias("id"), df[text_col].cast("string").cast("binary").alias("text"))
    rows = rows.withColumn("g", F.xxhash64("text"))
    keys = stored(_keyed(rows, kind, window, gram), "keys")
    # one list holds the keys of one text, however many rows repeat it or have no id
    of = _shared_keys(keys).groupBy(F.col("id").alias("of"), F.col("g").alias("of_g")).agg(F.collect_set("key").alias("keys"))
    marked = rows.join(of, F.col("id").eqNullSafe(F.col("of")) & (F.col("g") == F.col("of_g")), "left").select("id", "text", "keys")
    docs = stored(_recut(marked, kind, window, gram, texts), "recut")

    place = ["key", "h1", "h2"]
    told = docs.where("body IS NOT NULL")
    found = told.select("id", "h", F.explode("segments").alias("s")).select("id", "h", "s.*")
    # only keys that occur that often can have so many distinct segments
    # stored, so that the planner sees how few they are and need not deal all segments by key
    often = stored(found.groupBy("key").count().where(F.col("count") > hot).select("key"), "often-keys")
    wide = found.select(*place).join(often, "key", "left_semi").distinct().groupBy("key").count().where(F.col("count") > hot).select("key")
    wide = stored(wide, "wide-keys")
    whole = _contents(told, window)
    single = stored(_single(whole.join(wide, "key", "left_semi"), kind, window), "single-windows")
    names = ["id", "h", "key", "at", "n", "h1", "h2"]
    occurrences = found.join(wide, "key", "left_anti").select(names).unionByName(single.select(names))
    full = whole.join(wide, "key", "left_anti").select(*names, "content").unionByName(single.select(*names, "content"))
    total = occurrences.agg(F.sum(F.col("n") + window - 1)).first()[0] or 0
    shards = max(1, -(-total // shard_words))
    distinct = full.groupBy(*place).agg(F.min(F.struct("id", "h", "at")).alias("first"), F.first("content").alias("content"))
    distinct = distinct.select(*place, F.col("first.id").alias("first_id"), F.col("first.h").alias("first_h"), F.col("first.at").alias("first_at"), "content")
    first = stored(_search(distinct.withColumn("shard", F.pmod(F.xxhash64("key"), F.lit(shards))), window), "spans")
    hits = occurrences.join(first, place)
    same = F.col("id").eqNullSafe(F.col("first_id")) & (F.col("h") == F.col("first_h")) & (F.col("at") == F.col("first_at"))
    whole = F.array(F.struct(F.lit(0).alias("a"), (F.col("n") + window - 1).cast("int").alias("b")))
    cut = F.transform(F.when(same, F.col("spans")).otherwise(whole), lambda s: F.struct((s["a"] + F.col("at")).alias("a"), (s["b"] + F.col("at")).alias("b")))
    hits = hits.select(F.col("id").alias("of"), F.col("h").alias("of_h"), cut.alias("cut")).where(F.size("cut") > 0)
    hits = hits.groupBy("of", "of_h").agg(F.flatten(F.collect_list("cut")).alias("cut"))
    changed = docs.where("body IS NOT NULL").select("id", "h", "words", "body")
    changed = changed.join(hits, F.col("id").eqNullSafe(F.col("of")) & (F.col("h") == F.col("of_h")), "left").select("id", "words", "body", "cut")
    rest = docs.where("body IS NULL").select("id", "words", F.lit(0).cast("long").alias("removed"), "kept", F.col("whole").alias("text"))
    out = rest.unionByName(_finish(changed, kind))
    return out.select(F.col("id").alias(id_col), F.col("words").alias("n_words"), F.col("removed").alias("n_removed"), F.col("kept").alias("kept_sha256"), F.col("text").cast("string").alias("text"))


ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
x AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS word FROM d),
v AS (SELECT doc_id, i, md5(string_agg(word, ' ') OVER f) AS g, count(*) OVER f AS n FROM x
  WINDOW f AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING)),
f AS (SELECT doc_id, i, row_number() OVER (PARTITION BY g ORDER BY doc_id, i) AS nth FROM v WHERE n = 20),
r AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS i FROM f WHERE nth > 1),
k AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS kept, count(*) AS n FROM x ANTI JOIN r USING (doc_id, i) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN k USING (doc_id)
"""
