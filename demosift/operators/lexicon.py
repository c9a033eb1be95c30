"""Dictionaries: building, extending, exact and fuzzy lookup.

A lexicon is a table ``key, surface, translations``, of one row for each key.  One that has few enough bytes to be
sent out is looked up where the texts are, so that no token crosses: parts of a token that is no key are found by an
automaton over the keys.  With larger ones lookups are joins: each distinct unknown token meets the keys by its pieces,
no longer than the longest key, and a row's hits get their translations when they are cut to those that are shown.
Both fuzzy modes follow from the parts.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from demosift.functions import text as T

from demosift.sources.storage import stored

from .automaton import Automaton, greedy
from .normalize import word_pairs

TOP_N, MAX_ENTRIES, MIN_CHARS = 2, 80, 3
#: Bytes of keys whose automaton is sent to every task, at most; a byte makes a node of 21 bytes at most.  Surfaces and
#: shown translations that are sent with them have ``WITH_KEYS`` times as many at most.
KEY_BYTES, WITH_KEYS = 4_000_000, 4
#: Tokens whose rows are looked up at a time.
AT_ONCE = 1 << 18
#: Tokens, and characters of them, that are matched at a time.
TOKENS, CHARACTERS = 4096, 1 << 18
#: Characters of a block of a token whose pieces are joined.
BLOCK = 1024
HIT = "struct<query:string,source:string,translations:array<string>,match:string>"


def entries(rows: DataFrame, order: str = "row_id", source: str = "source_text", target: str = "target_text") -> DataFrame:
    """``key, surface, translations``: of each key the first surface and all targets in order."""
    one = rows.select(F.col(order).alias("at"), T.strip(F.coalesce(F.col(source), F.lit(""))).alias("surface"), T.strip(F.coalesce(F.col(target), F.lit(""))).alias("target"))
    one = one.withColumn("key", T.lexicon_key("surface")).where((F.col("key") != "") & (F.col("surface") != "") & (F.col("target") != ""))
    found = one.groupBy("key").agg(F.min(F.struct("at", "surface")).alias("first"), F.array_sort(F.collect_list(F.struct("at", "target"))).alias("all"))
    return found.select("key", F.col("first.surface").alias("surface"), T.distinct_in_order(F.transform("all", lambda x: x["target"])).alias("translations"))


def build(df: DataFrame, source_lang: str, target_lang: str, order: str = "row_id") -> DataFrame:
    """The lexicon of a corpus' word pairs."""
    return entries(word_pairs(df, source_lang, target_lang), order)


def extend(lexicon: DataFrame, rows: DataFrame, order: str = "row_id", source: str = "source_text", target: str = "target_text") -> DataFrame:
    """New targets are added behind known ones; known surfaces stay."""
    more = entries(rows, order, source, target).select("key", F.col("surface").alias("new_surface"), F.col("translations").alias("new"))
    none = F.array().cast("array<string>")
    joined = lexicon.join(more, "key", "full")
    return joined.select("key", F.coalesce("surface", "new_surface").alias("surface"), F.array_union(F.coalesce("translations", none), F.coalesce("new", none)).alias("translations"))


def stats(lexicon: DataFrame) -> DataFrame:
    return lexicon.agg(F.count("*").alias("source_terms"), F.coalesce(F.sum(F.size("translations")), F.lit(0)).cast("long").alias("translation_entries"))


def _tokens_and_keys(df: DataFrame, id_col: str, text: str) -> DataFrame:
    """``id, tokens, keys``.

    Folding does not change which characters make up a token's key, so the keys of a row are made at once.
    """
    rows = df.select(F.col(id_col).alias("id"), T.lexicon_tokens(text).alias("tokens"))
    folded = F.split(T.folded(F.array_join("tokens", "\n")), "\n")
    keys = F.transform(folded, lambda t: F.regexp_replace(t, f"[^{T.LEXICON_CHARS}]", ""))
    return rows.select("id", "tokens", F.when(F.size("tokens") > 0, keys).otherwise(F.array().cast("array<string>")).alias("keys"))


def _first_tokens(df: DataFrame, id_col: str, text: str) -> DataFrame:
    """``id, at, token, key``: of each key in a row the first token that has it."""
    rows = _tokens_and_keys(df, id_col, text)
    all_ = F.transform("keys", lambda k, i: F.struct(k.alias("key"), i.alias("at"), F.get("tokens", i).alias("token")))
    rows = rows.select("id", F.array_sort(F.filter(all_, lambda t: t["key"] != "")).alias("t"))
    first = F.filter("t", lambda t, i: (i == 0) | (t["key"] != F.coalesce(F.get("t", i - 1)["key"], F.lit(""))))
    return rows.select("id", F.explode(first).alias("t")).select("id", "t.at", "t.token", "t.key")


def _collected(hits: DataFrame, lexicon: DataFrame, df: DataFrame, id_col: str, top_n: int, max_entries: int) -> DataFrame:
    """Hits ``id, at, nth, token, key, match`` as an ordered list for every row of ``df``."""
    by_key = Window.partitionBy("id", "key").orderBy("at", "nth")
    first = hits.withColumn("n", F.row_number().over(by_key)).where("n = 1")
    shown = first.withColumn("n", F.row_number().over(Window.partitionBy("id").orderBy("at", "nth"))).where(F.col("n") <= max_entries)
    shown = shown.join(lexicon.select("key", "surface", F.slice("translations", 1, top_n).alias("translations")), "key")
    one = F.struct("n", F.struct(F.col("token").alias("query"), F.col("surface").alias("source"), "translations", "match").alias("e"))
    lists = shown.groupBy("id").agg(F.array_sort(F.collect_list(one)).alias("all")).select("id", F.col("all.e").alias("entries"))
    rows = df.select(F.col(id_col).alias("id")).join(lists, "id", "left")
    return rows.select(F.col("id").alias(id_col), F.coalesce("entries", F.array().cast(f"array<{HIT}>")).alias("entries"))


def _inside(automaton: Automaton, tokens: list[str]) -> Iterator[tuple[str, list[int], list[int]]]:
    """Each token with starts and sizes of the keys inside; a bounded number of characters is matched at a time."""
    at = 0
    while at < len(tokens):
        part, n = [], 0
        while at < len(tokens) and len(part) < TOKENS and (not part or n + len(tokens[at]) <= CHARACTERS):
            part.append(tokens[at])
            n += len(tokens[at])
            at += 1
        own, starts, sizes = automaton.matches(part)
        stops = [0, *own.searchsorted(range(len(part)), side="right").tolist()]
        for token, a, b in zip(part, stops, stops[1:], strict=False):
            yield token, starts[a:b].tolist(), sizes[a:b].tolist()


def _keys_inside(token: str, starts: list[int], sizes: list[int], mode: str) -> list[str]:
    """The parts that a mode takes, each once, in its order."""
    if mode == "greedy":
        return list(dict.fromkeys(token[a : a + n] for a, n in greedy(starts, sizes, len(token))))
    return sorted({token[a : a + n] for a, n in zip(starts, sizes, strict=True)}, key=lambda k: (-len(k), k))


def _sent(df: DataFrame, known: pa.Table, id_col: str, text: str, mode: str | None, max_entries: int, min_chars: int) -> DataFrame:
    """The lookup where the texts are: ``known`` (key, surface, translations) goes to every task."""
    names = known.column("key").to_pylist()
    automaton = Automaton.of([k for k in names if len(k) >= min_chars]) if mode else None
    shared = df.sparkSession.sparkContext.broadcast((automaton, known.combine_chunks()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton, known = shared.value
        place = {k: i for i, k in enumerate(known.column("key").to_pylist())}
        surfaces, meanings = (known.column(c).combine_chunks() for c in ("surface", "translations"))
        for batch in batches:
            at, ends = 0, pc.fill_null(pc.list_value_length(batch.column(1)), 0).to_numpy(zero_copy_only=False).cumsum()
            while at < batch.num_rows:
                n = max(1, int(ends.searchsorted((ends[at - 1] if at else 0) + AT_ONCE, side="right")) - at)
                part = batch.slice(at, n)
                at += n
                tokens, keys = part.column(1).flatten(), part.column(2).flatten().dictionary_encode()
                # what each distinct key of these rows leads to: itself, or parts of it
                distinct = keys.dictionary.to_pylist()
                leads = [[place[k]] if k in place else [] for k in distinct]
                if mode:
                    number = {k: i for i, k in enumerate(distinct) if k not in place and len(k) >= min_chars}
                    for token, starts, sizes in _inside(automaton, list(number)):
                        if starts:
                            leads[number[token]] = [place[k] for k in _keys_inside(token, starts, sizes, mode)]
                exact = [k in place for k in distinct]
                codes, stops = keys.indices.to_numpy(), [0]
                hit, entry, kind = [], [], []
                first = 0
                for size in pc.fill_null(pc.list_value_length(part.column(1)), 0).to_pylist():
                    seen, looked = set(), set()
                    for i, code in enumerate(codes[first : first + size].tolist(), first):
                        if code in looked:
                            continue
                        looked.add(code)
                        for key in leads[code]:
                            if key not in seen and len(seen) < max_entries:
                                seen.add(key)
                                hit.append(i)
                                entry.append(key)
                                kind.append("exact" if exact[code] else "fuzzy")
                        if len(seen) >= max_entries:
                            break
                    first += size
                    stops.append(len(hit))
                hits, places = pa.array(hit, pa.int64()), pa.array(entry, pa.int64())
                columns = [tokens.take(hits), surfaces.take(places), meanings.take(places), pa.array(kind, pa.string())]
                lists = pa.ListArray.from_arrays(pa.array(stops, pa.int32()), pa.StructArray.from_arrays(columns, ["query", "source", "translations", "match"]))
                yield pa.RecordBatch.from_arrays([part.column(0), lists], ["id", "entries"])

    kind = df.schema[id_col].dataType.simpleString()
    return _tokens_and_keys(df, id_col, text).mapInArrow(run, f"id {kind}, entries array<{HIT}>").withColumnRenamed("id", id_col)


def _joined(tokens: DataFrame, keys: DataFrame) -> DataFrame:
    """The same by a join: every piece of a token that is as long as some key is a row.

    Tokens are cut into blocks first, so that no row repeats a long token for each of its pieces.
    """
    named = stored(tokens.select(F.monotonically_increasing_id().alias("token"), "whole"), "unknown-tokens")
    lengths = F.broadcast(keys.agg(F.sort_array(F.collect_set(F.length("key"))).alias("lengths")))
    numbers = F.sequence(F.lit(0), ((F.length("whole") - 1) / BLOCK).cast("int"))
    cut = lambda b: F.struct((b * BLOCK).alias("base"), F.substring("whole", b * BLOCK + 1, F.lit(BLOCK) + F.array_max("lengths")).alias("part"))
    blocks = named.crossJoin(lengths).where("size(lengths) > 0").select("token", "lengths", F.explode(F.transform(numbers, cut)).alias("b")).select("token", "lengths", "b.*")
    inside = F.sequence(F.lit(0), F.least(F.lit(BLOCK), F.length("part")) - 1)
    pieces = blocks.select("token", "base", "part", "lengths", F.explode(inside).alias("at")).select("token", "base", "part", "at", F.explode("lengths").alias("size"))
    pieces = pieces.where(F.col("at") + F.col("size") <= F.length("part"))
    pieces = pieces.select("token", (F.col("base") + F.col("at")).alias("start"), "size", F.substring("part", F.col("at") + 1, F.col("size")).alias("key"))
    lists = pieces.join(keys, "key", "left_semi").groupBy("token").agg(F.array_sort(F.collect_list(F.struct("start", "size"))).alias("p"))
    return named.join(lists, "token").select("whole", F.col("p.start").alias("starts"), F.col("p.size").alias("sizes"))


def _taken(parts: DataFrame) -> DataFrame:
    """``whole, starts, sizes`` of the parts that greedy matching takes, in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [greedy(a, n, len(w)) for w, a, n in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
            lists = [pa.array([[x[i] for x in f] for f in found], pa.list_(pa.int32())) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *lists], ["whole", "starts", "sizes"])

    return parts.select("whole", "starts", "sizes").mapInArrow(run, "whole string, starts array<int>, sizes array<int>")


def parts_of(tokens: DataFrame, lexicon: DataFrame, mode: str, min_chars: int = MIN_CHARS) -> DataFrame:
    """``whole, nth, key`` of distinct tokens (column ``whole``): the keys inside, each once.

    ``mode``: ``substring``, all keys, the longest first, or ``greedy``, those that greedy matching takes in order.
    """
    found = _joined(tokens, stored(lexicon.where(F.length("key") >= min_chars).select("key"), "long-keys"))
    if mode == "greedy":
        found = _taken(found)
    key = F.transform(F.arrays_zip("starts", "sizes"), lambda p: F.substring("whole", p["starts"] + 1, p["sizes"]))
    keys_in = F.array_distinct(key)
    if mode != "greedy":
        keys_in = F.transform(F.array_sort(F.transform(keys_in, lambda k: F.struct((-F.length(k)).alias("size"), k.alias("key")))), lambda s: s["key"])
    return found.select("whole", F.posexplode(keys_in).alias("nth", "key"))


def lookup(df: DataFrame, lexicon: DataFrame, id_col: str, text: str, fuzzy: str | None = "max_matching", top_n: int = TOP_N, max_entries: int = MAX_ENTRIES, min_chars: int = MIN_CHARS, key_bytes: int = KEY_BYTES) -> DataFrame:
    """``id, entries``: exact matches and, in tokens that match none, parts that do.

    ``fuzzy``: None, ``substring``, or anything else for greedy matching.  Entries without translations match as well.
    Ids name one row each.
    """
    top_n, max_entries, min_chars = max(1, top_n), max(1, max_entries), max(1, min_chars)
    mode = None if fuzzy is None else "substring" if fuzzy.strip().lower() == "substring" else "greedy"
    known = stored(lexicon.select("key", "surface", F.slice("translations", 1, top_n).alias("translations")), "lexicon")
    size = lambda c: F.coalesce(F.sum(F.octet_length(c)), F.lit(0))
    sizes = known.agg(size(F.col("key")).alias("keys"), (size(F.col("surface")) + size(F.array_join("translations", ","))).alias("rest")).first()
    if sizes.keys <= key_bytes and sizes.rest <= WITH_KEYS * key_bytes:
        return _sent(df, known.toArrow(), id_col, text, mode, max_entries, min_chars)
    tokens = _first_tokens(df, id_col, text)
    if mode:
        tokens = stored(tokens, "tokens")
    hits = tokens.join(known.select("key"), "key").select("id", "at", F.lit(0).alias("nth"), "token", "key", F.lit("exact").alias("match"))
    if mode:
        # each distinct unknown key is cut once, however many tokens have it
        unknown = tokens.select("key").distinct().join(known.select("key"), "key", "left_anti").where(F.length("key") >= min_chars)
        parts = stored(parts_of(unknown.select(F.col("key").alias("whole")), known, mode, min_chars), "parts")
        inside = tokens.select("id", "at", "token", F.col("key").alias("whole")).join(parts, "whole")
        hits = hits.unionByName(inside.select("id", "at", "nth", "token", "key", F.lit("fuzzy").alias("match")))
    return _collected(hits, known, df, id_col, top_n, max_entries)


def entry_column(entries: Column) -> Column:
    """As it is printed in records."""
    return F.to_json(entries)
