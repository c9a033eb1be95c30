"""Schema, cleaning and filters of a parallel corpus."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from demosift.functions import text as T

REQUIRED = ("source_text", "target_text", "source_lang", "target_lang", "type")
# fixed values: other column names, language codes and their three-letter prefixes, types, format markers
RENAMED = {"src_text": "source_text", "tgt_text": "target_text", "src_lang": "source_lang", "tgt_lang": "target_lang"}
CODES = {"chg_Arab": "chg", "eng_Latn": "en", "kaz_Cyrl": "kk", "rus_Cyrl": "ru", "uzb_Latn": "uz", "uzb_Cyrl": "uz", "tur_Latn": "tr"}
PREFIXES = {"eng": "en", "kaz": "kk", "rus": "ru", "uzb": "uz", "tur": "tr", "chg": "chg"}
SENTENCE_TYPES = ("phrase", "sentence")
BAD_MARKERS = ("translation:", "explanation:", "here is", "the translation is", "```", "source:", "target:")


def _map(values: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in values.items() for x in kv])


def language_code(code: Column | str) -> Column:
    """Canonical code: a known code, else a known prefix before an underscore, else as it is."""
    c = F.col(code) if isinstance(code, str) else code
    return F.coalesce(_map(CODES)[c], F.when(F.instr(c, "_") > 0, _map(PREFIXES)[F.substring_index(c, "_", 1)]), c)


def derived_type(source: Column | str, normalised: bool = False) -> Column:
    """``word`` for exactly one token, else ``phrase``."""
    return F.when(F.size(T.graph_tokens(source, normalised)) == 1, "word").otherwise("phrase")


def normalize_schema(df: DataFrame, normalised: bool = False) -> DataFrame:
    """Canonical column names and language codes, and a type where there is none; idempotent."""
    df = df.withColumnsRenamed({a: b for a, b in RENAMED.items() if a in df.columns})
    for c in ("source_lang", "target_lang"):
        if c in df.columns:
            df = df.withColumn(c, language_code(F.coalesce(F.col(c).cast("string"), F.lit(""))))
    if "type" not in df.columns:
        known = F.coalesce(F.col("source_text").cast("string"), F.lit("")) if "source_text" in df.columns else None
        df = df.withColumn("type", F.lit("phrase") if known is None else derived_type(known, normalised))
    return df


def require(df: DataFrame, columns: tuple[str, ...] = REQUIRED) -> None:
    for c in columns:
        if c not in df.columns:
            raise ValueError(f"the table lacks the column {c}")


def clean(df: DataFrame) -> DataFrame:
    """Required columns as stripped strings, null as empty; rows without source, target or target language go."""
    require(df)
    df = df.withColumns({c: T.strip(F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in REQUIRED})
    return df.where((F.col("source_text") != "") & (F.col("target_text") != "") & (F.col("target_lang") != ""))


def select_pairs(df: DataFrame, target_lang: str, only_sentences: bool = False) -> DataFrame:
    """Rows of a target language (whatever their source language), words left out on demand."""
    df = df.where(F.col("target_lang") == target_lang)
    return df.where(F.col("type").isin(*SENTENCE_TYPES)) if only_sentences else df


def split_pairs(train: DataFrame, test: DataFrame, target_lang: str, only_sentences: bool = False) -> tuple[DataFrame, DataFrame]:
    return select_pairs(train, target_lang, only_sentences), select_pairs(test, target_lang, only_sentences)


def word_pairs(df: DataFrame, source_lang: str, target_lang: str) -> DataFrame:
    missing = sorted(set(REQUIRED) - set(df.columns))
    if missing:
        raise ValueError(f"a dictionary needs the columns {', '.join(missing)}")
    return df.where((F.col("source_lang") == source_lang) & (F.col("target_lang") == target_lang) & (F.col("type") == "word"))


def bad_format(text: Column | str) -> Column:
    """Whether an output holds a marker of anything but a plain translation."""
    t = F.lower(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")))
    found = F.lit(False)
    for marker in BAD_MARKERS:
        found = found | t.contains(marker)
    return found


def request_budget(source: Column | str, base: int, cap: int, chars_per_token: float = 3.0, adaptive: bool = True) -> Column:
    """Output tokens to ask for: grows with the source, between the base and the cap."""
    base = max(1, int(base))
    cap = max(base, int(cap))
    if not adaptive:
        return F.lit(min(base, cap))
    s = F.coalesce(F.col(source) if isinstance(source, str) else source, F.lit(""))
    wanted = F.floor(F.length(s) / F.lit(max(0.1, float(chars_per_token)))).cast("int") + 1
    return F.least(F.greatest(F.lit(base), wanted), F.lit(cap))


def empty_retry_budget(requested: Column | str, max_tokens: int, cap: int) -> Column:
    """Tokens for another try after an empty output: twice as many, below the larger of both limits."""
    r = F.col(requested) if isinstance(requested, str) else requested
    return F.least(F.lit(max(max_tokens, cap)), F.greatest(2 * r, F.lit(max_tokens)))


def outcome_flags(df: DataFrame) -> DataFrame:
    """``exact_match, empty_prediction, has_error`` of prediction rows."""
    side = lambda c: T.strip(F.coalesce(F.col(c).cast("string"), F.lit("")))
    error = side("error") if "error" in df.columns else F.lit("")
    return df.withColumns({"exact_match": side("prediction") == side("reference"), "empty_prediction": side("prediction") == "", "has_error": error != ""})
