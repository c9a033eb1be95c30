"""A bounded, reproducible sample of labelled documents, to fit a classifier on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored, trained_on


def sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int, longest: int, seed: int = 1, id_col: str = "doc_id", text_col: str = "text") -> list[tuple[str, int]]:
    """Whole texts and 0/1 labels: at most ``per_class`` ids of each class, by hash.

    Only ids outside the held-out fifth are used, and only texts of up to ``longest`` characters, so the
    result is bounded by 2 x per_class x longest.  Null ids, texts and labels take no part; of several
    labels of an id the largest counts; of repeated ids every text counts, up to twice the bound of ids.
    """
    known = labels.where(F.col(id_col).isNotNull() & F.col(label).isin(0, 1) & trained_on(id_col))
    known = known.groupBy(F.col(id_col).alias("id")).agg(F.max(label).cast("int").alias("label"))
    of: dict = {}
    for value in (0, 1):
        chosen = known.where(F.col("label") == value).orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(per_class)
        of |= {r.id: r.label for r in chosen.collect()}
    if not of:
        return []
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).where(F.col("id").isin(list(of)) & (F.length("text") <= longest))
    # ids can repeat: the bound cuts in a fixed order
    texts = texts.orderBy(F.xxhash64("id", F.lit(seed)), "id", F.xxhash64("text"), "text").limit(4 * per_class)
    # cut on an executor: an ordered collect would take every task's share of the bound to the driver
    return sorted((r.text, of[r.id]) for r in stored(texts, "sample").collect())
