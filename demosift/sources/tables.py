"""Reading corpora, dictionaries, predictions and previews."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from demosift.operators import normalize

# fixed values: cells that count as missing, and the language columns of a wide dictionary
MISSING = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")
WIDE_TARGETS = {"en": "English (eng_Latn)", "kk": "Kazakh (kaz_Cyrl)", "ru": "Russian (rus_Cyrl)", "uz": "Uzbek (uzn_Latn)", "tr": "Turkish (tur_Latn)"}
#: Row ids of a range that is numbered at a time, as a power of two.
RANGE_BITS = 16
WIDE_SOURCES = ("source_text", "Chagatai Latin (chg_Latn)")
PREDICTION_COLUMNS = ("prediction", "reference", "target_lang", "strategy", "k", "model")


def _local(path: str) -> str:
    return path.removeprefix("file://")


def split_path(folder: str, split: str) -> str:
    """``<split>_icl.csv`` of a folder on the driver, or ``<split>.csv``."""
    tried = [os.path.join(_local(folder), f"{split}{tail}.csv") for tail in ("_icl", "")]
    for path in tried:
        if os.path.exists(path):
            return path
    raise FileNotFoundError(f"no table for the split {split}: neither {' nor '.join(tried)} exists")


def optional_path(path: str | None, folder: str | None = None) -> str | None:
    """A path as given, or below a folder; nothing for nothing, an error for a missing file."""
    if not path:
        return None
    for at in (path, os.path.join(folder, path) if folder else path):
        if os.path.exists(_local(at)):
            return at
    raise FileNotFoundError(path)


def read_csv(spark: SparkSession, path: str, na_values: str = "pandas", numbered: bool = True) -> DataFrame:
    """All cells as strings, quoted line breaks kept, a byte-order mark skipped.

    ``na_values``: ``pandas`` turns the usual words for missing cells into null, ``strict`` only empty
    cells.  ``numbered`` adds ``row_id``, dense and in file order; one task numbers a file, as a row's
    place in it is only known by reading on.
    """
    df = spark.read.csv(path, header=True, multiLine=True, escape='"', encoding="UTF-8", nullValue=None, emptyValue="")
    df = df.withColumnsRenamed({c: c.lstrip("﻿") for c in df.columns})
    names = [c for c in df.columns if c != "row_id"]
    missing = MISSING if na_values == "pandas" else ("",)
    df = df.select(*[F.when(F.col(f"`{c}`").isin(*missing), None).otherwise(F.col(f"`{c}`")).alias(c) for c in names])
    if not numbered:
        return df
    return renumbered(df.select(F.monotonically_increasing_id().alias("row_id"), *names))


def read_corpus(spark: SparkSession, path: str, na_values: str = "pandas") -> DataFrame:
    return renumbered(normalize.clean(normalize.normalize_schema(read_csv(spark, path, na_values))))


def renumbered(df: DataFrame, row_id: str = "row_id") -> DataFrame:
    """Dense row ids in the old order, as filters leave gaps.

    Rows are counted by ranges of their id, the counts are summed up, and rows are numbered inside a range.
    """
    names = [c for c in df.columns if c != row_id]
    ranged = df.withColumn("id_range", F.shiftright(F.col(row_id).cast("long"), RANGE_BITS))
    before = Window.orderBy("of_range").rowsBetween(Window.unboundedPreceding, -1)
    counts = ranged.groupBy(F.col("id_range").alias("of_range")).agg(F.count("*").alias("n"))
    counts = counts.select("of_range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    found = ranged.join(counts, F.col("id_range") == F.col("of_range"))
    place = F.row_number().over(Window.partitionBy("id_range").orderBy(row_id))
    return found.select((F.col("offset") + place - 1).cast("long").alias(row_id), *[F.col(f"`{c}`") for c in names])


def read_split(spark: SparkSession, folder: str, split: str, na_values: str = "pandas") -> DataFrame:
    return read_corpus(spark, split_path(folder, split), na_values)


def as_dictionary(df: DataFrame, source_lang: str, target_lang: str) -> DataFrame:
    """A dictionary in long form (all columns of a corpus) or wide form (a column for each language)."""
    df = normalize.normalize_schema(df)
    if set(normalize.REQUIRED) <= set(df.columns):
        return normalize.clean(df)
    target = WIDE_TARGETS.get(target_lang)
    if target not in df.columns:
        raise ValueError(f"the dictionary names no column for {target_lang}, and it lacks columns of a corpus")
    source = next((c for c in WIDE_SOURCES if c in df.columns), None)
    if source is None:
        raise ValueError("the wide dictionary lacks a column of source words")
    ids = ["row_id"] if "row_id" in df.columns else []
    pairs = df.select(*ids, F.col(f"`{source}`").alias("source_text"), F.col(f"`{target}`").alias("target_text"), F.lit(source_lang).alias("source_lang"), F.lit(target_lang).alias("target_lang"), F.lit("word").alias("type"))
    return normalize.clean(pairs)


def all_languages(df: DataFrame, source_lang: str) -> DataFrame:
    """A wide dictionary in long form, all its languages at once."""
    source = next(c for c in WIDE_SOURCES if c in df.columns)
    known = {code: c for code, c in WIDE_TARGETS.items() if c in df.columns}
    pairs = F.explode(F.array(*[F.struct(F.lit(code).alias("target_lang"), F.col(f"`{c}`").alias("target_text")) for code, c in known.items()]))
    ids = ["row_id"] if "row_id" in df.columns else []
    out = df.select(*ids, F.col(f"`{source}`").alias("source_text"), pairs.alias("p")).select(*ids, "source_text", "p.target_text", F.lit(source_lang).alias("source_lang"), "p.target_lang", F.lit("word").alias("type"))
    return normalize.clean(out)


def read_dictionary(spark: SparkSession, path: str, source_lang: str, target_lang: str, na_values: str = "pandas") -> DataFrame:
    return as_dictionary(read_csv(spark, path, na_values), source_lang, target_lang)


def read_static_examples(spark: SparkSession, path: str, target_lang: str, source_lang: str, only_sentences: bool = False, na_values: str = "pandas") -> DataFrame:
    """Fixed examples of a language pair; an error if none is left."""
    df = normalize.clean(normalize.normalize_schema(read_csv(spark, path, na_values)))
    df = normalize.select_pairs(df, target_lang, only_sentences).where(F.col("source_lang") == source_lang)
    if df.isEmpty():
        raise ValueError(f"none of the fixed examples goes from {source_lang} to {target_lang}")
    return renumbered(df)


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    """Predictions for evaluation; the texts of missing cells are empty."""
    df = read_csv(spark, path, numbered=False)
    missing = [c for c in PREDICTION_COLUMNS if c not in df.columns]
    if missing:
        raise ValueError(f"predictions lack the column {missing[0]}")
    return df.withColumns({c: F.coalesce(F.col(c), F.lit("")) for c in ("prediction", "reference")}).withColumn("k", F.col("k").try_cast("double").cast("int"))


def csv_preview(spark: SparkSession, path: str, limit: int = 200) -> tuple[list[str], DataFrame]:
    """Header and first rows of a file."""
    df = spark.read.csv(path, header=True, multiLine=True, escape='"')
    df = df.withColumnsRenamed({c: c.lstrip("﻿") for c in df.columns})
    return df.columns, df.limit(limit)


def jsonl_preview(spark: SparkSession, path: str, limit: int = 100) -> DataFrame:
    """``value``: the first lines as variants; blank ones count but are not shown, unreadable ones are kept raw."""
    lines = spark.read.text(path).limit(limit).select(F.trim("value").alias("line")).where("line <> ''")
    raw = F.parse_json(F.to_json(F.struct(F.col("line").alias("raw"))))
    return lines.select(F.coalesce(F.try_parse_json("line"), raw).alias("value"))


def request_previews(requests: DataFrame) -> DataFrame:
    """Logged requests with the prompt taken out of the first message."""
    return requests.withColumn("prompt", F.col("request_payload.messages")[0]["content"])
