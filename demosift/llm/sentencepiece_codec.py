"""SentencePiece encoding with source offsets, and decoding.

The model file is read without its library.  Normalisation walks the compiled character map (a
double-array trie over UTF-8) taking the longest match at each position, and records for every
normalised byte the source byte it came from.  BPE then merges the normalised text, and each piece is
projected through that record to the source bytes it covers.

Defined results: a null text counts as empty and gives no pieces; texts of any length are encoded
whole; repeated rows give repeated results; columns other than the two named are ignored, so their
names cannot clash; an empty table gives an empty one.
"""

from __future__ import annotations

import hashlib
import heapq
import re
import struct
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

SPACE_MARK = "▁"
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
#: Chunks of a generation of the cache, of which there are two, and the longest one that is kept.
CACHED_CHUNKS, CACHED_LENGTH = 60_000, 40
#: Characters of the texts that are encoded at a time; one longer text goes alone.
SLICE = 1 << 20


def _fields(buf: bytes) -> Iterator[tuple[int, object]]:
    """Fields of a protocol-buffers message: number and raw value."""
    at = 0

    def varint() -> int:
        nonlocal at
        out = shift = 0
        while True:
            b = buf[at]
            at += 1
            out |= (b & 127) << shift
            shift += 7
            if b < 128:
                return out

    while at < len(buf):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
        elif kind == 1:
            yield tag >> 3, buf[at : at + 8]
            at += 8
        elif kind == 5:
            yield tag >> 3, buf[at : at + 4]
            at += 4
        else:
            n = varint()
            yield tag >> 3, buf[at : at + n]
            at += n


class CharMap:
    """Longest-prefix replacement through a compiled character map; an empty map replaces nothing."""

    def __init__(self, blob: bytes):
        self.units: tuple[int, ...] = ()
        if blob:
            (size,) = struct.unpack_from("<I", blob)
            self.units = struct.unpack_from(f"<{size // 4}I", blob, 4)
            self.texts = blob[4 + size :]

    def longest(self, text: bytes, at: int) -> tuple[bytes, int] | None:
        """Replacement and length of the longest key that starts at this byte."""
        units, found = self.units, None
        if not units:
            return None
        step = lambda u: (u >> 10) << ((u & 512) >> 6)
        node = step(units[0])
        for i in range(at, len(text)):
            node ^= text[i]
            unit = units[node]
            if unit & 0x800000FF != text[i]:
                break
            node ^= step(unit)
            if unit >> 8 & 1:
                found = units[node] & 0x7FFFFFFF, i + 1 - at
        if found is None:
            return None
        return self.texts[found[0] : self.texts.index(b"\0", found[0])], found[1]


class Model:
    def __init__(self, blob: bytes):
        self.pieces: list[str] = []
        self.scores: list[float] = []
        self.types: list[int] = []
        self.dummy_prefix, self.remove_extra, self.escape = True, True, True
        self.suffix_space, self.byte_fallback, self.unk_surface, kind = False, False, " ⁇ ", 1
        charsmap = b""
        for number, value in _fields(blob):
            if number == 1:
                piece, score, of = "", 0.0, NORMAL
                for n, v in _fields(value):
                    if n == 1:
                        piece = v.decode()
                    elif n == 2:
                        (score,) = struct.unpack("<f", v)
                    elif n == 3:
                        of = v
                self.pieces.append(piece)
                self.scores.append(score)
                self.types.append(of)
            elif number == 2:
                for n, v in _fields(value):
                    if n == 3:
                        kind = v
                    elif n == 24:
                        self.suffix_space = bool(v)
                    elif n == 35:
                        self.byte_fallback = bool(v)
                    elif n == 44:
                        self.unk_surface = v.decode()
            elif number == 3:
                for n, v in _fields(value):
                    if n == 2:
                        charsmap = v
                    elif n == 3:
                        self.dummy_prefix = bool(v)
                    elif n == 4:
                        self.remove_extra = bool(v)
                    elif n == 5:
                        self.escape = bool(v)
        if kind != 2:
            raise ValueError("only BPE models are supported")
        self.charmap = CharMap(charsmap)
        self.lengths = [len(p.encode()) for p in self.pieces]
        self.unk = self.types.index(UNKNOWN)
        usable = (NORMAL, USER_DEFINED, UNUSED)
        self.ids = {p: i for i, p in enumerate(self.pieces) if self.types[i] in usable}
        self.user = sorted((p for p, t in zip(self.pieces, self.types, strict=True) if t == USER_DEFINED), key=len, reverse=True)
        self.byte_ids = {int(p[3:5], 16): i for i, p in enumerate(self.pieces) if self.types[i] == BYTE}
        self.mergeable = {p: self.scores[i] for p, i in self.ids.items() if len(p) > 1}
        long = [p for p in self.mergeable if p.strip(SPACE_MARK)]
        #: No piece has a space mark after another character: text can be cut before every run of marks.
        self.cuts = not self.suffix_space and not self.user and not any(SPACE_MARK in p.lstrip(SPACE_MARK) for p in long)
        self.newline_alone = not any("\n" in p for p in self.mergeable)
        self.unused = {p for p, i in self.ids.items() if self.types[i] == UNUSED}
        #: What a piece covers follows from its id and its neighbours, and merges have no exceptions.
        self.plain = self.byte_fallback and not self.user and not self.unused


class Pairs:
    """A hash table from two symbols to the symbol they merge to, looked up for arrays of pairs."""

    def __init__(self, left: np.ndarray, right: np.ndarray, merged: np.ndarray):
        keys = self._key(left, right)
        self.shift = np.uint64(64 - max(4, int(4 * len(keys)).bit_length()))
        size = 1 << (64 - int(self.shift))
        self.keys, self.merged = np.full(size, -1), np.full(size, -1, np.int32)
        todo, at = np.arange(len(keys)), self._slot(keys)
        while len(todo):
            free = self.keys[at] < 0
            slots, first = np.unique(at[free], return_index=True)
            put = np.flatnonzero(free)[first]
            self.keys[slots], self.merged[slots] = keys[todo[put]], merged[todo[put]]
            left_over = np.ones(len(todo), bool)
            left_over[put] = False
            todo, at = todo[left_over], (at[left_over] + 1) % size

    @staticmethod
    def _key(left: np.ndarray, right: np.ndarray) -> np.ndarray:
        return left.astype(np.int64) << 32 | right

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> self.shift).view(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The merged symbol of each pair, or -1."""
        shape = left.shape
        keys = self._key(left, right).ravel()
        at = self._slot(keys)
        there = self.keys[at]
        out = np.where(there == keys, self.merged[at], -1)
        todo = np.flatnonzero((there != keys) & (there >= 0))
        while len(todo):
            at[todo] = (at[todo] + 1) % len(self.keys)
            there = self.keys[at[todo]]
            hit = there == keys[todo]
            out[todo[hit]] = self.merged[at[todo[hit]]]
            todo = todo[~hit & (there >= 0)]
        return out.reshape(shape)


class Merger:
    """Merges many short chunks at once.

    Chunks of like length are the rows of a matrix of symbols.  A step merges the best pair of every row
    (the leftmost of equal ones), so all rows lose one symbol and the matrix stays a rectangle; rows
    without a pair are done.  A symbol is a piece's id, or, for a character without one, the number of
    pieces plus its code point.
    """

    PAD, NEVER = np.int32(0x7FFFFFF0), np.int32(0x7FFFFFF1)

    def __init__(self, model: Model):
        self.count, parts = len(model.pieces), set(model.mergeable)
        self.of_char = np.arange(0x110000, dtype=np.int32) + np.int32(self.count)
        for piece, i in model.ids.items():
            if len(piece) == 1:
                self.of_char[ord(piece)] = i
        symbol = lambda p: int(self.of_char[ord(p)]) if len(p) == 1 else model.ids[p]
        made = []
        for piece in model.mergeable:
            for cut in range(1, len(piece)):
                a, b = piece[:cut], piece[cut:]
                if (len(a) == 1 or a in parts) and (len(b) == 1 or b in parts):
                    made.append((symbol(a), symbol(b), model.ids[piece]))
        left, right, merged = np.array(made, np.int32).reshape(-1, 3).T
        self.pairs = Pairs(left, right, merged)
        scores = np.array(model.scores)
        self.rank = np.append(np.unique(-scores, return_inverse=True)[1].astype(np.int32), self.NEVER)

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        return self.rank[self.pairs.find(left, right)]

    def merge(self, chunks: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Numbers of chunks, their symbols (a matrix), and how many of a row's symbols count."""
        sizes = np.fromiter(map(len, chunks), np.int64, len(chunks))
        symbols = self.of_char[np.frombuffer("".join(chunks).encode("utf-32-le", "surrogatepass"), np.uint32)]
        begins = np.cumsum(sizes) - sizes
        widths = -(-sizes // 4) * 4
        for width in np.unique(widths).tolist():
            own = np.flatnonzero(widths == width)
            column = np.arange(width)
            inside = column < sizes[own, None]
            rows = np.where(inside, symbols[np.minimum(begins[own, None] + column, len(symbols) - 1)], self.PAD)
            yield from self._steps(own, rows, width - sizes[own])

    def _steps(self, own: np.ndarray, rows: np.ndarray, pads: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        ranks = self._ranks(rows[:, :-1], rows[:, 1:]) if rows.shape[1] > 1 else np.zeros((len(rows), 0), np.int32)
        while len(rows):
            n, width = rows.shape
            at = ranks.argmin(axis=1) if width > 1 else np.zeros(n, np.int64)
            going = ranks[np.arange(n), at] < self.NEVER if width > 1 else np.zeros(n, bool)
            if not going.all():
                done = ~going
                yield own[done], rows[done], width - pads[done]
                own, rows, ranks, pads, at = own[going], rows[going], ranks[going], pads[going], at[going]
                n = len(rows)
            if not n:
                return
            line = np.arange(n)
            rows[line, at] = self.pairs.find(rows[line, at], rows[line, at + 1])
            keep = np.ones((n, width), bool)
            keep[line, at + 1] = False
            rows = rows[keep].reshape(n, width - 1)
            keep = np.ones((n, width - 1), bool)
            keep[line, at] = False
            ranks = ranks[keep].reshape(n, width - 2)
            # the pairs on both sides of the merged one are new
            after, before = np.flatnonzero(at < width - 2), np.flatnonzero(at > 0)
            if len(after):
                ranks[after, at[after]] = self._ranks(rows[after, at[after]], rows[after, at[after] + 1])
            if len(before):
                ranks[before, at[before] - 1] = self._ranks(rows[before, at[before] - 1], rows[before, at[before]])


class Codec:
    """Encodes and decodes; keeps a bounded cache of the pieces of short chunks.

    Pieces are those of a chunk as 32-bit ids.  Where what they cover does not follow from the ids, a
    second table of the same size holds the normalised bytes of each.
    """

    def __init__(self, blob: bytes):
        self.model = m = Model(blob)
        mark, line = re.escape(SPACE_MARK), "\n" if m.newline_alone else ""
        self.chunk = re.compile(f"{mark}*[^{mark}{line}]+|{mark}+|\n" if m.cuts else r"(?s).+")
        self.cache: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.covers: dict[str, bytes] = {}
        self.surface = [self._surface(i) for i in range(len(m.pieces))]
        self.names = list(map(str, range(len(m.pieces))))
        self.merger = Merger(m) if m.plain else None
        # bytes of each piece in the normalised text and, without a map and with marks for spaces only, in the source
        self.lengths = np.array([1 if t == BYTE else n for t, n in zip(m.types, m.lengths, strict=True)], np.int64)
        self.source_lengths = self.lengths - 2 * np.array([p.count(SPACE_MARK) for p in m.pieces])
        self.byte = np.full(len(m.pieces), -1, np.int16)
        for value, i in m.byte_ids.items():
            self.byte[i] = value
        self.escapes_only = m.plain and not m.charmap.units and not m.remove_extra and m.escape and not m.suffix_space

    # ------------------------------------------------------------------ normalisation
    def normalise(self, text: str) -> tuple[str, np.ndarray]:
        """Normalised text, and the source byte of each of its bytes and of its end."""
        m, raw = self.model, text.encode("utf-8", "surrogatepass")
        if not raw:
            return "", np.zeros(1, np.int64)
        mark = SPACE_MARK if m.escape else " "
        out: list[str] = []
        origin: list[int] = []
        at, end = 0, len(raw)

        def put(piece: str, source: int) -> None:
            out.append(piece)
            origin.extend([source] * len(piece.encode()))

        if m.remove_extra:
            while at < end:
                piece, n = self._prefix(raw, at)
                if piece != b" ":
                    break
                at += n
        if at >= end:
            return "", np.zeros(1, np.int64)
        if m.dummy_prefix and not m.suffix_space:
            put(mark, at)
        space = m.remove_extra
        while at < end:
            piece, n = self._prefix(raw, at)
            if space:
                piece = piece.lstrip(b" ")
            if piece:
                for c in piece.decode():
                    put(mark if c == " " else c, at)
                space = piece.endswith(b" ")
            at += n
            if not m.remove_extra:
                space = False
        if m.remove_extra:
            while out and out[-1] == mark:
                out.pop()
                at = origin[len(origin) - len(mark.encode())]
                del origin[len(origin) - len(mark.encode()) :]
        if m.dummy_prefix and m.suffix_space:
            put(mark, at)
        return "".join(out), np.array([*origin, at], np.int64)

    def _prefix(self, raw: bytes, at: int) -> tuple[bytes, int]:
        for u in self.model.user:
            if raw.startswith(b := u.encode(), at):
                return b, len(b)
        if (found := self.model.charmap.longest(raw, at)) is not None:
            return found
        n = 1 if raw[at] < 0x80 else 2 if raw[at] < 0xE0 else 3 if raw[at] < 0xF0 else 4
        return raw[at : at + n], n

    # ------------------------------------------------------------------ merging
    def _merge(self, chunk: str) -> list[str]:
        m = self.model
        if not m.user:
            out = self._heap(list(chunk), [False] * len(chunk))
        else:
            symbols, frozen, at = [], [], 0
            while at < len(chunk):
                u = next((u for u in m.user if chunk.startswith(u, at)), None)
                symbols.append(u or chunk[at])
                frozen.append(u is not None)
                at += len(symbols[-1])
            out = self._heap(symbols, frozen)
        return out if not m.unused else [x for p in out for x in self._split_unused(p)]

    def _heap(self, s: list[str], frozen: list[bool]) -> list[str]:
        score, n = self.model.mergeable.get, len(s)
        after, before, heap = list(range(1, n + 1)), list(range(-1, n - 1)), []

        def offer(i: int, j: int) -> None:
            if 0 <= i and j < n and not frozen[i] and not frozen[j] and (x := score(s[i] + s[j])) is not None:
                heapq.heappush(heap, (-x, i, j, len(s[i]) + len(s[j])))

        for i in range(n - 1):
            offer(i, i + 1)
        while heap:
            _, i, j, size = heapq.heappop(heap)
            if not s[i] or not s[j] or after[i] != j or len(s[i]) + len(s[j]) != size:
                continue
            s[i] += s[j]
            s[j] = ""
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            offer(before[i], i)
            offer(i, after[i])
        return [x for x in s if x]

    def _split_unused(self, piece: str) -> list[str]:
        """An unused piece falls back to the parts it was merged from."""
        if piece not in self.model.unused or len(piece) < 2:
            return [piece]
        score = lambda x: self.model.mergeable.get(x, 0.0)
        parts = [(piece[:i], piece[i:]) for i in range(1, len(piece)) if all(len(x) == 1 or x in self.model.mergeable for x in (piece[:i], piece[i:]))]
        if not parts:
            return [piece]
        a, b = max(parts, key=lambda p: (min(score(p[0]), score(p[1])), len(p[0])))
        return [*self._split_unused(a), *self._split_unused(b)]

    def _ids(self, chunk: str) -> tuple[list[int], list[int]]:
        """Piece ids and the normalised bytes each covers; bytes of a fallback but the last cover none."""
        ids: list[int] = []
        lens: list[int] = []
        m, joins = self.model, False
        for piece in self._merge(chunk):
            i = m.ids.get(piece)
            if i is not None:
                ids.append(i)
                lens.append(m.lengths[i])
            elif m.byte_fallback:
                raw = piece.encode()
                ids += [m.byte_ids[b] for b in raw]
                lens += [0] * (len(raw) - 1) + [len(raw)]
            elif joins:
                lens[-1] += len(piece.encode())
            else:
                ids.append(m.unk)
                lens.append(len(piece.encode()))
            joins = i is None and not m.byte_fallback
        return ids, lens

    def _learn(self, chunks: list[list[str]]) -> list[str]:
        """Puts all chunks into the cache; returns those too long to stay there."""
        if len(self.cache) >= CACHED_CHUNKS:
            self.cache, self.older = {}, self.cache
            self.covers = {c: x for c, x in self.covers.items() if c in self.older}
        new, short, long = set().union(*chunks).difference(self.cache), [], []
        for c in new:
            if (known := self.older.get(c)) is not None:
                self.cache[c] = known
            elif len(c) > CACHED_LENGTH:
                long.append(c)
            else:
                short.append(c)
        if self.merger is None:
            long, short = [*long, *short], []
        for c in long:
            ids, lens = self._ids(c)
            self.cache[c] = array("i", ids).tobytes()
            if not self.model.plain:
                self.covers[c] = array("i", lens).tobytes()
        if short:
            for own, rows, counts in self.merger.merge(short):
                self._put([short[i] for i in own.tolist()], rows, counts)
        return [c for c in long if len(c) > CACHED_LENGTH]

    def _put(self, chunks: list[str], rows: np.ndarray, counts: np.ndarray) -> None:
        raw, step, cache = rows.astype(np.int32).tobytes(), 4 * rows.shape[1], self.cache
        for c, at, n in zip(chunks, range(0, len(raw), step), (4 * counts).tolist(), strict=True):
            cache[c] = raw[at : at + n]
        # characters without a piece fall back to their bytes
        missing = (rows >= self.merger.count) & (np.arange(rows.shape[1]) < counts[:, None])
        for i in np.flatnonzero(missing.any(axis=1)).tolist():
            ids: list[int] = []
            for x in rows[i, : counts[i]].tolist():
                ids += [x] if x < self.merger.count else [self.model.byte_ids[b] for b in chr(x - self.merger.count).encode("utf-8", "surrogatepass")]
            cache[chunks[i]] = array("i", ids).tobytes()

    def _covered(self, lengths: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Bytes that each piece covers; of a character in bytes only the last one covers it."""
        out, byte = lengths[ids], self.byte[ids]
        wide = byte >= 0x80
        if wide.any():
            begins = np.flatnonzero(byte >= 0xC0)
            middle = wide & (byte < 0xC0)
            ends = np.flatnonzero(middle & ~np.append(middle[1:], False))
            out[wide] = 0
            out[ends] = ends - begins + 1
        return out

    def encode_many(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """For every text ids, and begin and end of each piece in bytes of the source text."""
        m, origins = self.model, []
        easy = [self.escapes_only and SPACE_MARK not in t for t in texts]
        head = SPACE_MARK if m.dummy_prefix else ""
        chunks = []
        for t, simple in zip(texts, easy, strict=True):
            normal, origin = (head + t.replace(" ", SPACE_MARK) if t else "", None) if simple else self.normalise(t)
            origins.append(origin)
            chunks.append(self.chunk.findall(normal))
        long = self._learn(chunks)
        get, out = self.cache.__getitem__, []
        for own, origin in zip(chunks, origins, strict=True):
            ids = np.frombuffer(b"".join(map(get, own)), np.int32)
            if origin is None:
                stop = np.cumsum(self._covered(self.source_lengths, ids))
                stop -= len(head)
                begin = np.concatenate([[0], stop[:-1]]) if len(stop) else stop
                out.append((ids, begin, stop))
                continue
            lens = self._covered(self.lengths, ids) if m.plain else np.frombuffer(b"".join(map(self.covers.__getitem__, own)), np.int32)
            stop = np.cumsum(lens, dtype=np.int64)
            out.append((ids, origin[stop - lens], origin[stop]))
        for c in long:
            del self.cache[c]
            self.covers.pop(c, None)
        return out

    def encode(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return self.encode_many([text])[0]

    # ------------------------------------------------------------------ decoding
    def _surface(self, i: int) -> bytes:
        m = self.model
        if m.types[i] == CONTROL:
            return b""
        if m.types[i] == UNKNOWN:
            return m.unk_surface.encode()
        if m.types[i] == BYTE:
            return bytes([int(m.pieces[i][3:5], 16)])
        return m.pieces[i].replace(SPACE_MARK, " ").encode()

    def decode(self, ids: list[int]) -> str:
        m = self.model
        raw = b"".join(map(self.surface.__getitem__, ids))
        first = next((i for i in ids if m.types[i] != CONTROL), None)
        strip = first is not None and m.types[first] in (NORMAL, USER_DEFINED, UNUSED) and m.pieces[first].startswith(SPACE_MARK)
        if strip and (m.dummy_prefix or m.remove_extra):
            raw = raw.lstrip(b" ") if m.remove_extra and not m.dummy_prefix else raw[1:]
        try:
            return raw.decode()
        except UnicodeDecodeError:
            return self._lenient(raw)

    @staticmethod
    def _lenient(raw: bytes) -> str:
        """Each byte that starts no valid character gives one replacement character."""
        out, at = [], 0
        while at < len(raw):
            n = 1 if raw[at] < 0x80 else 2 if raw[at] < 0xE0 else 3 if raw[at] < 0xF0 else 4
            try:
                out.append(raw[at : at + n].decode())
                at += n
            except UnicodeDecodeError:
                out.append("�")
                at += 1
        return "".join(out)


_loaded: dict[bytes, Codec] = {}


def codec(blob: bytes) -> Codec:
    """One codec for each model and Python worker, so that its cache lives over tasks."""
    key = hashlib.sha256(blob).digest()
    if key not in _loaded:
        _loaded[key] = Codec(blob)
    return _loaded[key]


def read_model(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def encode(df: DataFrame, model: bytes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row: id, ids, begins and ends (source bytes) of all pieces, and the decoded text."""
    kind = df.schema[id_col].dataType.simpleString()
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(shared.value)
        for batch in batches:
            for ids, texts in _slices(batch):
                rows = c.encode_many([t or "" for t in texts])
                cols = [pa.array([r[k] for r in rows], pa.list_(t)) for k, t in ((0, pa.int32()), (1, pa.int64()), (2, pa.int64()))]
                yield pa.RecordBatch.from_arrays([ids, *cols, pa.array([c.decode(r[0].tolist()) for r in rows], pa.string())], ["id", "ids", "begins", "ends", "decoded"])

    out = df.select(df[id_col].alias("id"), df[text_col].cast("string").alias("text")).mapInArrow(run, f"id {kind}, ids array<int>, begins array<bigint>, ends array<bigint>, decoded string")
    return out.withColumnRenamed("id", id_col)


def encode_digests(df: DataFrame, model: bytes, id_col: str = "doc_id", text_col: str = "text", arrays: bool = False) -> DataFrame:
    """What ``encode`` gives, as digests: the arrays stay in the Python worker, or stand beside the digests."""
    kind = df.schema[id_col].dataType.simpleString()
    shared = df.sparkSession.sparkContext.broadcast(model)
    names = ["id", "n_tokens", "ids_sha256", "decoded_sha256", "spans_sha256"]
    types = [pa.int64(), pa.string(), pa.string(), pa.string()]
    if arrays:
        names += ["ids", "begins", "ends"]
        types += [pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int64())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(shared.value)
        hexed = lambda b: hashlib.sha256(b).hexdigest()
        for batch in batches:
            for ids, texts in _slices(batch):
                rows = []
                for pieces, begins, ends in c.encode_many([t or "" for t in texts]):
                    listed = pieces.tolist()
                    joined, decoded = ",".join(map(c.names.__getitem__, listed)), c.decode(listed)
                    spans = np.stack([begins, ends], 1).astype("<i8").tobytes()
                    rows.append((len(pieces), hexed(joined.encode()), hexed(decoded.encode("utf-8", "surrogatepass")), hexed(spans), *((pieces, begins, ends) if arrays else ())))
                cols = [pa.array([r[k] for r in rows], t) for k, t in enumerate(types)]
                yield pa.RecordBatch.from_arrays([ids, *cols], names)

    more = ", ids array<int>, begins array<bigint>, ends array<bigint>" if arrays else ""
    out = df.select(df[id_col].alias("id"), df[text_col].cast("string").alias("text")).mapInArrow(run, f"id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string, spans_sha256 string{more}")
    return out.withColumnRenamed("id", id_col)


def _slices(batch: pa.RecordBatch, rows: int = 256) -> Iterator[tuple[pa.Array, list[str | None]]]:
    """A few rows at a time, fewer where texts are long, so that what is held besides the batch stays small."""
    sizes = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False)
    at = 0
    while at < batch.num_rows:
        n = max(1, int(np.searchsorted(np.cumsum(sizes[at : at + rows]), SLICE, side="right")))
        part = batch.slice(at, n)
        yield part.column(0), part.column(1).to_pylist()
        at += n


def decode(df: DataFrame, model: bytes, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """One row per row: id and the text its ids decode to; null ids decode to the empty text."""
    kind = df.schema[id_col].dataType.simpleString()
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(shared.value)
        for batch in batches:
            texts = [c.decode(x or []) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["id", "decoded"])

    out = df.select(df[id_col].alias("id"), df[ids_col].alias("ids")).mapInArrow(run, f"id {kind}, decoded string")
    return out.withColumnRenamed("id", id_col)
