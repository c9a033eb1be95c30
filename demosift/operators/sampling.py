"""Samples of rows: by type, at random for each query, fixed ones, none."""

from __future__ import annotations

import random
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


#: Bits of the hash that name a bin.
BIN_BITS = 14


def sample_fraction(df: DataFrame, fraction: float | None, seed: int, row_id: str = "row_id") -> DataFrame:
    """The same fraction of every type, at least one row, rounded half to even; by a hash of the row id.

    Rows fall into bins of the hash; whole bins are taken as long as they fit, and only rows of the bin where
    the wanted number is reached are ranked, so no type is sorted in one task.  Equal seeds choose equal rows
    at any partitioning.
    """
    if fraction is None or fraction >= 1:
        return df
    draw = F.xxhash64(F.lit(seed), row_id)
    rows = df.withColumn("sample_bin", F.shiftright(draw, 64 - BIN_BITS))
    bins = rows.groupBy(F.col("type").alias("of_type"), F.col("sample_bin").alias("of_bin")).agg(F.count("*").alias("n"))
    up_to = Window.partitionBy("of_type").orderBy("of_bin").rowsBetween(Window.unboundedPreceding, 0)
    total = F.sum("n").over(Window.partitionBy("of_type"))
    wanted = F.least(total, F.greatest(F.lit(1), F.bround(total * F.lit(float(fraction)), 0).cast("long")))
    bins = bins.select("of_type", "of_bin", "n", (wanted - F.sum("n").over(up_to) + F.col("n")).alias("room")).where("room > 0")
    found = rows.join(bins, F.col("type").eqNullSafe(F.col("of_type")) & (F.col("sample_bin") == F.col("of_bin")))
    whole = found.where("n <= room").select(df.columns)
    rank = F.row_number().over(Window.partitionBy("type", "sample_bin").orderBy(draw, row_id))
    return whole.unionByName(found.where("n > room").withColumn("sample_rank", rank).where("sample_rank <= room").select(df.columns))


def sample_pair(train: DataFrame, test: DataFrame, fraction: float | None, seed: int) -> tuple[DataFrame, DataFrame]:
    return sample_fraction(train, fraction, seed), sample_fraction(test, fraction, seed + 1)


def random_rows(queries: DataFrame, n: int, k: int, seed: int, query_id: str = "query_id", position: str = "test_index") -> DataFrame:
    """``query_id, rank, place``: ``k`` places out of ``n`` for each query, by the standard generator seeded
    with seed + position, so the draw is the same as that of a plain Python program."""

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(q, r + 1, place) for q, p in zip(batch["query_id"], batch["position"], strict=True) for r, place in enumerate(random.Random(seed + int(p)).sample(range(n), k=min(k, n)))]
            yield pd.DataFrame(rows, columns=["query_id", "rank", "place"])

    kind = queries.schema[query_id].dataType.simpleString()
    return queries.select(F.col(query_id).alias("query_id"), F.col(position).cast("long").alias("position")).mapInPandas(draw, f"query_id {kind}, rank int, place long")


def no_examples(corpus: DataFrame) -> DataFrame:
    return corpus.limit(0)


def first_rows(corpus: DataFrame, k: int, row_id: str = "row_id") -> DataFrame:
    """The first ``k`` rows in order of their id, for every query alike."""
    return corpus.orderBy(row_id).limit(k)
