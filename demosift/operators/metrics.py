"""Corpus metrics by experiment: BLEU, chrF with words, format and emptiness.

Both scores depend on sums over rows only.  Each row's statistics are counted where the row is, and only
a few numbers of each group are shuffled; the closed forms are columns over the sums.
"""

from __future__ import annotations

import string
from collections import Counter
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as S

from demosift.functions import text as T

from .normalize import bad_format, require

GROUP = ("model", "target_lang", "strategy", "k")
ORDER, CHAR_ORDER, WORD_ORDER, BETA = 4, 6, 2, 2.0
BLEU_FIELDS = [*[f"match_{n}" for n in range(1, ORDER + 1)], *[f"total_{n}" for n in range(1, ORDER + 1)], "hyp_len", "ref_len"]
CHRF_FIELDS = [f"{side}_{n}" for n in range(1, CHAR_ORDER + WORD_ORDER + 1) for side in ("hyp", "ref", "match")]


def bleu_tokens(text: Column | str) -> Column:
    """The international tokenisation: entities unescaped, symbols and punctuation not between digits set apart."""
    t = F.col(text) if isinstance(text, str) else text
    t = F.regexp_replace(F.regexp_replace(F.replace(t, F.lit("<skipped>"), F.lit("")), "-\n", ""), "\n", " ")
    for name, char in (("&quot;", '"'), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">")):
        t = F.replace(t, F.lit(name), F.lit(char))
    t = F.concat(F.lit(" "), t, F.lit(" "))
    t = F.regexp_replace(t, r"([\{-\~\[-\` -\&\(-\+\:-\@\/])", " $1 ")
    t = F.regexp_replace(t, r"([^0-9])([\.,])", "$1 $2 ")
    t = F.regexp_replace(t, r"([\.,])([^0-9])", " $1 $2")
    t = F.regexp_replace(t, r"([0-9])(-)", "$1 $2 ")
    return F.filter(F.split(t, T.WHITE), lambda x: x != "")


def _grams(items: list | str, n: int) -> Counter:
    return Counter(tuple(items[i : i + n]) if isinstance(items, list) else items[i : i + n] for i in range(len(items) - n + 1))


def _bleu_row(hyp: list[str], ref: list[str]) -> tuple[int, ...]:
    matches, totals = [], []
    for n in range(1, ORDER + 1):
        h, r = _grams(hyp, n), _grams(ref, n)
        matches.append(sum((h & r).values()))
        totals.append(max(0, len(hyp) - n + 1))
    return *matches, *totals, len(hyp), len(ref)


def _words(text: str) -> list[str]:
    """Words with one punctuation mark at an end set apart."""
    out: list[str] = []
    for w in text.split():
        if len(w) > 1 and w[-1] in string.punctuation:
            out += [w[:-1], w[-1]]
        elif len(w) > 1 and w[0] in string.punctuation:
            out += [w[0], w[1:]]
        else:
            out.append(w)
    return out


def _chrf_row(hyp: str, ref: str) -> list[int]:
    out: list[int] = []
    sides = [("".join(hyp.split()), "".join(ref.split()), n) for n in range(1, CHAR_ORDER + 1)]
    sides += [(_words(hyp), _words(ref), n) for n in range(1, WORD_ORDER + 1)]
    for h, r, n in sides:
        a, b = _grams(h, n), _grams(r, n)
        out += [sum(a.values()) if b else 0, sum(b.values()), sum((a & b).values())]
    return out


_bleu_schema = S.StructType([S.StructField(f, S.LongType()) for f in BLEU_FIELDS])
_chrf_schema = S.StructType([S.StructField(f, S.LongType()) for f in CHRF_FIELDS])


@F.pandas_udf(_bleu_schema)
def bleu_statistics(hyp: pd.Series, ref: pd.Series) -> pd.DataFrame:
    """Of two columns of tokens."""
    return pd.DataFrame([_bleu_row(list(h), list(r)) for h, r in zip(hyp, ref, strict=True)], columns=BLEU_FIELDS)


@F.pandas_udf(_chrf_schema)
def chrf_statistics(hyp: pd.Series, ref: pd.Series) -> pd.DataFrame:
    """Of two columns of text."""
    return pd.DataFrame([_chrf_row(h, r) for h, r in zip(hyp, ref, strict=True)], columns=CHRF_FIELDS)


def bleu(get: Callable[[str], Column]) -> Column:
    """BLEU of summed statistics: exponential smoothing of orders without match, brevity penalty."""
    smooth, logs = F.lit(1.0), F.lit(0.0)
    for n in range(1, ORDER + 1):
        match, total = get(f"match_{n}").cast("double"), get(f"total_{n}").cast("double")
        smooth = F.when((match == 0) & (total > 0), smooth * 2).otherwise(smooth)
        precision = F.when(match == 0, 100.0 / (smooth * F.nullif(total, F.lit(0.0)))).otherwise(100.0 * match / F.nullif(total, F.lit(0.0)))
        logs = logs + F.log(precision)
    hyp, ref = get("hyp_len").cast("double"), get("ref_len").cast("double")
    brevity = F.when(hyp >= ref, F.lit(1.0)).when(hyp > 0, F.exp(1 - ref / F.nullif(hyp, F.lit(0.0)))).otherwise(F.lit(0.0))
    any_match = sum((get(f"match_{n}") for n in range(2, ORDER + 1)), get("match_1")) > 0
    return F.when(any_match, F.coalesce(brevity * F.exp(logs / ORDER), F.lit(0.0))).otherwise(F.lit(0.0))


def chrf(get: Callable[[str], Column]) -> Column:
    """chrF of summed statistics: precision and recall averaged over the orders that both sides have."""
    precision, recall, orders = F.lit(0.0), F.lit(0.0), F.lit(0)
    for n in range(1, CHAR_ORDER + WORD_ORDER + 1):
        hyp, ref, match = (get(f"{side}_{n}").cast("double") for side in ("hyp", "ref", "match"))
        both = (hyp > 0) & (ref > 0)
        precision = precision + F.when(both, match / F.nullif(hyp, F.lit(0.0))).otherwise(0.0)
        recall = recall + F.when(both, match / F.nullif(ref, F.lit(0.0))).otherwise(0.0)
        orders = orders + both.cast("int")
    precision, recall = precision / F.greatest(orders, F.lit(1)), recall / F.greatest(orders, F.lit(1))
    value = (1 + BETA**2) * precision * recall / F.nullif(BETA**2 * precision + recall, F.lit(0.0))
    return F.coalesce(100 * value, F.lit(0.0))


def with_statistics(df: DataFrame, which: tuple[str, ...] = ("bleu", "chrf")) -> DataFrame:
    """Prediction rows with cleaned texts and the statistics of each wanted score."""
    side = lambda c: T.strip(F.coalesce(F.col(c).cast("string"), F.lit("")))
    df = df.withColumns({"prediction": side("prediction"), "reference": side("reference")})
    if "bleu" in which:
        df = df.withColumn("bleu_stats", bleu_statistics(bleu_tokens("prediction"), bleu_tokens("reference")))
    if "chrf" in which:
        df = df.withColumn("chrf_stats", chrf_statistics(F.col("prediction"), F.col("reference")))
    return df


def evaluate(df: DataFrame, group: tuple[str, ...] = GROUP, semantic: Column | None = None, which: tuple[str, ...] = ("bleu", "chrf")) -> DataFrame:
    """One row of metrics for each experiment, sorted by language, k and strategy.

    ``semantic``: a column with the likeness of a pair by some model in 0..1, averaged over pairs with both
    sides; without a model the value is null.  Rows with a null in the group take no part.
    """
    require(df, (*group, "prediction", "reference"))
    rows = with_statistics(df.dropna(subset=list(group)), which)
    sums = [F.sum(f"bleu_stats.{f}").alias(f"b_{f}") for f in BLEU_FIELDS if "bleu" in which] + [F.sum(f"chrf_stats.{f}").alias(f"c_{f}") for f in CHRF_FIELDS if "chrf" in which]
    both = (F.col("prediction") != "") & (F.col("reference") != "")
    out = rows.groupBy(*group).agg(
        *sums,
        (F.lit(None).cast("double") if semantic is None else F.avg(F.when(both, semantic)) * 100).alias("BERTScore"),
        (F.avg(bad_format("prediction").cast("double")) * 100).alias("format_error_rate"),
        F.count_if(F.col("prediction") == "").alias("empty_prediction_count"),
        F.count_if(F.col("reference") == "").alias("empty_reference_count"),
        F.count("*").alias("n"),
    )
    values = {}
    if "bleu" in which:
        values["BLEU"] = bleu(lambda f: F.col(f"b_{f}"))
    if "chrf" in which:
        values["chrF"] = chrf(lambda f: F.col(f"c_{f}"))
    found = out.select(*group, *[v.alias(n) for n, v in values.items()], "BERTScore", "format_error_rate", "empty_prediction_count", "empty_reference_count", "n")
    order = [c for c in ("target_lang", "k", "strategy") if c in group]
    return found.orderBy(*order) if order else found


def session_ids(df: DataFrame, fallback: str, group: tuple[str, ...] = GROUP, column: str = "session_id") -> DataFrame:
    """Of each group the one session id that its rows name, or the fallback."""
    one = F.when(F.trim(F.coalesce(F.col(column).cast("string"), F.lit(""))) != "", F.trim(F.col(column).cast("string")))
    found = df.groupBy(*group).agg(F.min(one).alias("least"), F.max(one).alias("most"))
    return found.select(*group, F.when(F.col("least") == F.col("most"), F.col("least")).otherwise(F.lit(fallback)).alias("session_id"))
