"""Text functions as columns: tokenisers, keys, buckets, prefixes, names.

All but the two that need Unicode normalisation are JVM expressions.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as S

# fixed values: white space as the text tools of the corpus see it, token characters, display names
WHITE = r"(?U)[\s\x{1c}-\x{1f}]+"
WHITE_ENDS = r"(?U)^[\s\x{1c}-\x{1f}]+|[\s\x{1c}-\x{1f}]+$"
GRAPH_BREAK = r"[^\p{L}\p{N}_ʿʾ'-]+"
LEXICON_CHARS = r"\p{L}\p{N}\p{M}ʿʾ'’-"
SOURCE_NAMES = {"chg": "Chagatai"}
TARGET_NAMES = {"en": "English", "ru": "Russian", "kk": "Kazakh", "uz": "Uzbek", "tr": "Turkish"}
EMBEDDING_PREFIXES = {"intfloat/multilingual-e5-base": ("query: ", "passage: "), "BAAI/bge-m3": ("", "")}


@F.pandas_udf(S.StringType())
def nfkc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


@F.pandas_udf(S.StringType())
def nfkc_folded(texts: pd.Series) -> pd.Series:
    """Compatibility-normalised and case-folded, which lowers more than ``lower`` does."""
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t).casefold())


def _column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _beyond_ascii(text: Column) -> Column:
    """Null where nothing but ASCII stands: such texts need no Unicode tables and stay in the JVM."""
    return F.when(text.rlike(r"[^\x00-\x7f]"), text)


def normal(text: Column | str) -> Column:
    """Compatibility-normalised."""
    t = _column(text)
    return F.coalesce(nfkc(_beyond_ascii(t)), t)


def folded(text: Column | str) -> Column:
    """Compatibility-normalised and case-folded."""
    t = _column(text)
    return F.coalesce(nfkc_folded(_beyond_ascii(t)), F.lower(t))


def strip(text: Column | str) -> Column:
    """Without white space at both ends; of every kind, where ``trim`` knows one."""
    return F.regexp_replace(_column(text), WHITE_ENDS, "")


def _nonempty(parts: Column) -> Column:
    return F.filter(parts, lambda t: t != "")


def bm25_tokens(text: Column | str) -> Column:
    """Lower-cased runs between white space; null gives no tokens."""
    return F.coalesce(_nonempty(F.split(F.lower(_column(text)), WHITE)), F.array().cast("array<string>"))


def graph_text(text: Column | str, normalised: bool = False) -> Column:
    """Compatibility-normalised unless it is known to be, stripped, lowered, white space collapsed."""
    t = _column(text) if normalised else normal(text)
    return F.regexp_replace(F.lower(strip(t)), WHITE, " ")


def graph_tokens(text: Column | str, normalised: bool = False) -> Column:
    """Runs of letters, numbers, underscores, hyphens and three apostrophes of the graph text."""
    # white space breaks words wherever it stands, so it is neither stripped nor collapsed before
    t = _column(text) if normalised else normal(text)
    return F.coalesce(_nonempty(F.split(F.lower(t), GRAPH_BREAK)), F.array().cast("array<string>"))


def lexicon_tokens(text: Column | str, normalised: bool = False) -> Column:
    """Maximal runs of token characters, case kept."""
    t = _column(text) if normalised else normal(text)
    return F.coalesce(F.regexp_extract_all(t, F.lit(f"([{LEXICON_CHARS}]+)"), F.lit(1)), F.array().cast("array<string>"))


def lexicon_key(text: Column | str) -> Column:
    """Folded and reduced to token characters, so the parts of a compound concatenate."""
    return F.regexp_replace(folded(text), f"[^{LEXICON_CHARS}]", "")


def length_bucket(value: Column | None, tokens: Column) -> Column:
    """Bucket of a stated length, or of the number of tokens where it is not a finite number."""
    n = F.size(tokens).cast("double")
    if value is not None:
        stated = value.cast("string").try_cast("double")
        finite = stated.isNotNull() & ~F.isnan(stated) & (F.abs(stated) != float("inf"))
        n = F.when(finite, F.when(stated >= 0, F.floor(stated)).otherwise(F.ceil(stated)).cast("double")).otherwise(n)
    return F.when(n <= 1, "1").when(n <= 2, "2").when(n <= 4, "3-4").when(n <= 8, "5-8").otherwise("9+")


def distinct_in_order(values: Column) -> Column:
    """Stripped, non-empty, first occurrences."""
    return F.array_distinct(_nonempty(F.transform(values, strip)))


def bigrams(tokens: Column) -> Column:
    pairs = F.transform(F.sequence(F.lit(0), F.size(tokens) - 2), lambda i: F.concat_ws(" ", F.get(tokens, i), F.get(tokens, i + 1)))
    return F.when(F.size(tokens) >= 2, pairs).otherwise(F.array().cast("array<string>"))


def jaccard(a: Column, b: Column) -> Column:
    """Of two token arrays as sets; two empty ones share nothing."""
    return F.size(F.array_intersect(a, b)) / F.greatest(F.lit(1), F.size(F.array_union(a, b)))


def embedding_prefixes(model: str) -> tuple[str, str]:
    """Query and passage prefixes; models of one family are known by their name."""
    known = EMBEDDING_PREFIXES.get(model.strip())
    return known or (("query: ", "passage: ") if "e5" in model.lower() else ("", ""))


def prefixed(text: Column | str, model: str, query: bool) -> Column:
    return F.concat(F.lit(embedding_prefixes(model)[0 if query else 1]), F.coalesce(_column(text), F.lit("")))


def _named(code: Column | str, names: dict[str, str]) -> Column:
    c = _column(code)
    return F.coalesce(F.create_map(*[F.lit(x) for kv in names.items() for x in kv])[c], c)


def source_name(code: Column | str) -> Column:
    """Display name of a source language, or its code."""
    return _named(code, SOURCE_NAMES)


def target_name(code: Column | str) -> Column:
    """Display name of a target language, or its code."""
    return _named(code, TARGET_NAMES)


def score_id(*parts: Column | str) -> Column:
    """A stable id of the parts of a score: 32 hex digits."""
    return F.left(F.sha2(F.concat_ws(":", *[_column(p).cast("string") for p in parts]), 256), F.lit(32))


def shortened(text: Column | str, most: int = 300) -> Column:
    t = _column(text)
    return F.when(F.length(t) > most, F.concat(F.left(t, F.lit(most)), F.lit("..."))).otherwise(t)


def safe_name(text: str) -> str:
    """As part of a file name."""
    return text.translate(str.maketrans("/:. ", "____"))


def parse_keys(text: str) -> list[str]:
    """Keys between commas or line ends, quotes stripped, first occurrences."""
    parts = (p.strip().strip("\"'").strip() for p in text.replace("\r", "\n").replace("\n", ",").split(","))
    return list(dict.fromkeys(p for p in parts if p))


def parse_k_list(text: str) -> list[int]:
    values = [int(x) for x in text.split(",") if x.strip()]
    if not values or min(values) < 1:
        raise ValueError("k_list must hold positive integers")
    return values


def parse_int(text: object, default: int, least: int = 0) -> int:
    """An integer of at least ``least``; blank gives the default."""
    if not str(text).strip():
        return default
    value = int(str(text).strip())
    if value < least:
        raise ValueError(f"value must be at least {least}")
    return value


def parse_fraction(text: object) -> float | None:
    if not str(text).strip():
        return None
    value = float(str(text).strip())
    if not 0 < value <= 1:
        raise ValueError("a sample fraction lies in (0, 1]")
    return value
