"""Aligning the tokens of two tokenizers over the same bytes.

Both token sequences of a text cover the same bytes, so each is a row of ends: cumulative sums of token lengths.  Ends
that both have (``intersect1d``) cut the text into groups, ``searchsorted`` labels each token with its group, and the
tokens that overlap a token are a range of the other side, which ``repeat`` expands to links.  Many texts are aligned
at once, one behind the other; where a text ends, both have an end.

How often an id pair is linked is counted over the whole corpus.  A task gathers its texts into chunks of bounded
bytes and adds up a chunk's pairs before anything moves; the chunks' pairs are dealt by pair and a salt and summed, and
then by pair alone.  Counts go back to chunks, never to single texts: a chunk's texts hold their pairs as places
in the chunk's list, so a pair that every text has is one row of each chunk.

Defined results: a null or empty text, and one whose tokens do not spell it, has no tokens, zeros and an empty
digest; special tokens inside texts are plain text; repeated rows and rows without id are rows like others and
count; other columns are ignored; an empty table gives an empty one.
"""

from __future__ import annotations

import hashlib
import itertools
import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import tiktoken
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import sentencepiece_codec
from .common import stored

#: Bytes of text that are aligned at a time, and that share a list of pairs.
SLICE, CHUNK = 1 << 19, 4 << 20
#: Pieces of text whose ids a worker remembers, their length, and parts that a pair's chunks are counted in first.
KEPT, KEPT_LENGTH, SALTS = 300_000, 64, 32
_SHIFT = 24


def byte_letters() -> dict[str, int]:
    """The characters that stand for bytes in a byte-level vocabulary: printable ones for themselves, others above 255."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class ByteTokenizer:
    """A byte-level BPE vocabulary; ids of pieces of text are remembered."""

    def __init__(self, vocabulary: bytes, pattern: str):
        letters = byte_letters()
        model = json.loads(vocabulary)
        special = {x["id"] for x in model.get("added_tokens", [])}
        ranks = {bytes([letters[c] for c in entry]): i for entry, i in model["model"]["vocab"].items() if i not in special}
        self.surface = [b""] * (1 + max(ranks.values(), default=0))
        for content, i in ranks.items():
            self.surface[i] = content
        self.pieces = regex.compile(pattern).findall
        # without special tokens their strings are plain text
        self.ids = tiktoken.Encoding("byte-level", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.known: dict[str, bytes] = {}

    def encode(self, text: str) -> np.ndarray:
        known, out = self.known, []
        if len(known) > KEPT:
            known.clear()
        for piece in self.pieces(text):
            found = known.get(piece)
            if found is None:
                found = np.array(self.ids(piece), np.int32).tobytes()
                if len(piece) <= KEPT_LENGTH:
                    known[piece] = found
            out.append(found)
        return np.frombuffer(b"".join(out), np.int32)


class PieceTokenizer:
    """The codec of piece models, with each piece's bytes: its mark is a space."""

    def __init__(self, blob: bytes):
        c = sentencepiece_codec.codec(blob)
        m = c.model
        spelled = lambda i, p: bytes([int(p[3:5], 16)]) if m.types[i] == sentencepiece_codec.BYTE else p.replace(sentencepiece_codec.SPACE_MARK, " ").encode()
        self.surface = [spelled(i, p) for i, p in enumerate(m.pieces)]
        self.encode_many = lambda texts: [ids for ids, _, _ in c.encode_many(texts)]


@dataclass
class Aligned:
    """Groups and links of token sequences that cover the same bytes."""

    group_a: np.ndarray
    group_b: np.ndarray
    cuts: np.ndarray
    link_a: np.ndarray
    link_b: np.ndarray


def align(lengths_a: np.ndarray, lengths_b: np.ndarray) -> Aligned:
    """Lengths in bytes of two rows of tokens with equal sums; none is zero."""
    ends_a, ends_b = np.cumsum(lengths_a), np.cumsum(lengths_b)
    cuts = np.intersect1d(ends_a, ends_b, assume_unique=True)
    begins_a = ends_a - lengths_a
    first = np.searchsorted(ends_b, begins_a, side="right")
    last = np.searchsorted(ends_b, ends_a, side="left")
    n = last - first + 1
    link_a = np.repeat(np.arange(len(ends_a)), n)
    link_b = np.arange(len(link_a)) - np.repeat(np.cumsum(n) - n - first, n)
    return Aligned(np.searchsorted(cuts, ends_a), np.searchsorted(cuts, ends_b), cuts, link_a, link_b)


class _Lines:
    """Groups as text: every id has a name for inside and for the end of its side."""

    def __init__(self, a: int, b: int):
        self.names = [name for i in range(a) for name in (b"%d," % i, b"%d|" % i)] + [name for i in range(b) for name in (b"%d," % i, b"%d;" % i)]
        self.first_b = 2 * a

    def codes(self, ids_a: np.ndarray, ids_b: np.ndarray, found: Aligned) -> tuple[np.ndarray, np.ndarray]:
        """Names of all tokens, group by group, and where each group's begin."""
        at_a, at_b = (np.searchsorted(g, np.arange(len(found.cuts) + 1)) for g in (found.group_a, found.group_b))
        out = np.empty(len(ids_a) + len(ids_b), np.int64)
        end = lambda g: np.append(g[1:] != g[:-1], True) if len(g) else np.zeros(0, bool)
        out[np.arange(len(ids_a)) + at_b[found.group_a]] = 2 * ids_a.astype(np.int64) + end(found.group_a)
        out[np.arange(len(ids_b)) + at_a[found.group_b + 1]] = self.first_b + 2 * ids_b.astype(np.int64) + end(found.group_b)
        return out, at_a + at_b


_loaded: dict[bytes, tuple[ByteTokenizer, PieceTokenizer, _Lines, np.ndarray, np.ndarray]] = {}


def _tools(vocabulary: bytes, pattern: str, model: bytes) -> tuple[ByteTokenizer, PieceTokenizer, _Lines, np.ndarray, np.ndarray]:
    key = hashlib.sha256(vocabulary + pattern.encode() + model).digest()
    if key not in _loaded:
        a, b = ByteTokenizer(vocabulary, pattern), PieceTokenizer(model)
        sizes = (np.fromiter(map(len, x.surface), np.int64, len(x.surface)) for x in (a, b))
        _loaded[key] = (a, b, _Lines(len(a.surface), len(b.surface)), *sizes)
    return _loaded[key]


_PLAIN = ("n_a", "n_b", "n_groups", "n_links")
_SCHEMA = "chunk bigint, id {kind}, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, places binary, pairs array<bigint>, counts array<bigint>"


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, list[str], int]]:
    """A few rows at a time: ids, texts, bytes."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False)
        at = 0
        while at < batch.num_rows:
            n = max(1, int(np.searchsorted(np.cumsum(sizes[at : at + 1024]), SLICE, side="right")))
            part = batch.slice(at, n)
            yield part.column(0), [t or "" for t in part.column(1).to_pylist()], int(sizes[at : at + n].sum())
            at += n


class _Chunk:
    """Texts of bounded bytes, and the pairs that they link."""

    def __init__(self, tools: tuple):
        self.a, self.b, self.lines, self.size_a, self.size_b = tools
        self.ids: list[pa.Array] = []
        self.rows: list[tuple] = []
        self.held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.bytes = 0

    def add(self, ids: pa.Array, texts: list[str], size: int) -> None:
        tokens = list(zip([self.a.encode(" " + t) if t else np.zeros(0, np.int32) for t in texts], self.b.encode_many(texts), strict=True))
        for i, ((x, y), t) in enumerate(zip(tokens, texts, strict=True)):
            whole = b" " + t.encode()
            if not t or any(b"".join(map(side.surface.__getitem__, k.tolist())) != whole for side, k in ((self.a, x), (self.b, y))):
                tokens[i] = (x[:0], y[:0])
        x, y = (np.concatenate([t[k] for t in tokens]).astype(np.int64) for k in (0, 1))
        stops_a, stops_b = (np.cumsum([0, *[len(t[k]) for t in tokens]]) for k in (0, 1))
        found = align(self.size_a[x], self.size_b[y])
        codes, begins = self.lines.codes(x, y, found)
        groups = np.searchsorted(found.group_a, np.arange(len(found.cuts) + 1))
        group_stops = np.searchsorted(groups, stops_a)
        links = np.searchsorted(found.link_a, stops_a)
        listed, names = codes.tolist(), self.lines.names
        for i in range(len(texts)):
            g0, g1 = group_stops[i], group_stops[i + 1]
            line = b"".join(map(names.__getitem__, listed[begins[g0] : begins[g1]]))[:-1]
            sha = hashlib.sha256(line).hexdigest() if g1 > g0 else ""
            self.rows.append((int(stops_a[i + 1] - stops_a[i]), int(stops_b[i + 1] - stops_b[i]), int(g1 - g0), int(links[i + 1] - links[i]), sha))
        own = np.repeat(np.arange(len(texts)), np.diff(links))
        pair = x[found.link_a] << _SHIFT | y[found.link_b]
        order = np.lexsort((pair, own))
        own, pair = own[order], pair[order]
        new = np.flatnonzero(np.concatenate([[True], (pair[1:] != pair[:-1]) | (own[1:] != own[:-1])])) if len(pair) else np.zeros(0, np.int64)
        counts = np.diff(np.append(new, len(pair)))
        self.held.append((np.bincount(own[new], minlength=len(texts)), pair[new], counts))
        self.ids.append(ids)
        self.bytes += size

    def batch(self, number: int) -> pa.RecordBatch:
        """A row for each text and one, without id, for the chunk's pairs and their counts."""
        per_text, pair, counts = (np.concatenate([h[k] for h in self.held]) for k in range(3))
        pairs, place = np.unique(pair, return_inverse=True)
        totals = np.bincount(place, counts, len(pairs)).astype(np.int64)
        pack = zstandard.ZstdCompressor(level=1).compress
        stops, places = np.cumsum(np.append(0, per_text)), []
        for a, b in itertools.pairwise(stops.tolist()):
            places.append(pack(np.concatenate([np.diff(place[a:b], prepend=0), counts[a:b]]).astype("<i4").tobytes()))
        n, ids = len(places), pa.chunked_array(self.ids).combine_chunks()
        columns = [pa.array(np.full(n + 1, number)), pa.concat_arrays([ids, pa.nulls(1, ids.type)])]
        columns += [pa.array([*[r[k] for r in self.rows], None], t) for k, t in enumerate((pa.int64(),) * 4 + (pa.string(),))]
        columns += [pa.array([*places, None], pa.binary())]
        offsets = pa.array([0] * (n + 1) + [len(pairs)], pa.int32())
        columns += [pa.ListArray.from_arrays(offsets, pa.array(x)) for x in (pairs, totals)]
        return pa.RecordBatch.from_arrays(columns, ["chunk", "id", *_PLAIN, "groups_sha256", "places", "pairs", "counts"])


def _chunked(rows: DataFrame, kind: str, vocabulary: bytes, pattern: str, model: bytes) -> DataFrame:
    shared = rows.sparkSession.sparkContext.broadcast((vocabulary, pattern, model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tools = _tools(*shared.value)
        number = TaskContext.get().partitionId() << 32
        chunk = _Chunk(tools)
        for ids, texts, size in _texts(batches):
            chunk.add(ids, texts, size)
            if chunk.bytes >= CHUNK:
                yield chunk.batch(number)
                number, chunk = number + 1, _Chunk(tools)
        if chunk.rows:
            yield chunk.batch(number)

    return rows.mapInArrow(run, _SCHEMA.format(kind=kind))


def pair_counts(pairs: DataFrame) -> DataFrame:
    """``pair, count, best``: links of each id pair in all chunks, and whether its second id has no higher one."""
    # most rows of a pair meet those of the same salt first
    salted = pairs.groupBy("pair", F.pmod(F.xxhash64("chunk"), F.lit(SALTS)).alias("salt")).agg(F.sum("n").alias("n"))
    counts = stored(salted.groupBy("pair").agg(F.sum("n").alias("count")), "pair-counts")
    second = F.col("pair").bitwiseAND(F.lit((1 << _SHIFT) - 1))
    highest = counts.groupBy(second.alias("b"), F.pmod(F.xxhash64("pair"), F.lit(SALTS)).alias("salt")).agg(F.max("count").alias("most"))
    highest = highest.groupBy("b").agg(F.max("most").alias("most"))
    return counts.join(highest, second == F.col("b")).select("pair", "count", (F.col("count") == F.col("most")).alias("best"))


def token_alignment(df: DataFrame, vocabulary: bytes, pattern: str, model: bytes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256`` of every row.

    ``vocabulary`` and ``pattern`` are those of a byte-level BPE (A), which sees a space before the text; ``model``
    is a piece model (B), which adds it.  ``n_best``: links whose pair is linked most of all pairs with the same B id;
    ``count_sum``: the corpus' links of each link's pair, summed.
    """
    kind = df.schema[id_col].dataType.simpleString()
    rows = df.select(df[id_col].alias("id"), df[text_col].cast("string").alias("text"))
    chunks = stored(_chunked(rows, kind, vocabulary, pattern, model), "aligned-chunks")
    pairs = chunks.where("places IS NULL").select("chunk", F.posexplode(F.arrays_zip("pairs", "counts")).alias("place", "p"))
    pairs = pairs.select("chunk", "place", F.col("p.pairs").alias("pair"), F.col("p.counts").alias("n"))
    counts = stored(pair_counts(pairs), "counted-pairs")
    # back to the chunks; no chunk has more pairs than its bytes make
    told = pairs.join(counts, "pair").select(F.col("chunk").alias("of"), "place", "count", "best")
    texts = chunks.where("places IS NOT NULL").drop("pairs", "counts")
    names = ["id", *_PLAIN, "n_best", "count_sum", "groups_sha256"]

    def summed(texts: pa.Table, told: pa.Table) -> pa.Table:
        place = told.column("place").to_numpy()
        count, best = np.zeros(len(place), np.int64), np.zeros(len(place), np.int64)
        count[place], best[place] = told.column("count").to_numpy(), told.column("best").to_numpy().astype(np.int64)
        unpack, sums, bests = zstandard.ZstdDecompressor().decompress, [], []
        for blob in texts.column("places"):
            at, n = np.frombuffer(unpack(blob.as_py()), "<i4").astype(np.int64).reshape(2, -1)
            at = np.cumsum(at)
            sums.append(int(n @ count[at]))
            bests.append(int(n @ best[at]))
        columns = [*[texts.column(c) for c in ("id", *_PLAIN)], pa.array(bests, pa.int64()), pa.array(sums, pa.int64()), texts.column("groups_sha256")]
        return pa.table(columns, names)

    found = texts.groupBy("chunk").cogroup(told.groupBy("of")).applyInArrow(summed, f"id {kind}, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups_sha256 string")
    return found.withColumnRenamed("id", id_col)
