"""Cosine over given unit vectors, encoders that make them, and their cache."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from demosift.functions import text as T

#: Query vectors that are sent to all tasks at once, in bytes; more are searched block by block.
QUERY_BYTES = 32_000_000
#: Queries that are scored at a time inside a task.
TOGETHER = 64


def dot(a: Column, b: Column) -> Column:
    """Inner product of two arrays in double precision, in order of their components."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def _blocks(vectors: DataFrame, asked: DataFrame, value: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """``query_id, row_id, score`` of the pairs that ``value`` picks out of every batch of rows.

    Queries go out in blocks of bounded size; ``value`` takes the rows' ids and a matrix of scores (queries
    by rows) and gives, for every query, places of rows.
    """
    dim = asked.select(F.max(F.size("embedding"))).first()[0] or 1
    blocks = max(1, -(-asked.count() * dim * 8 // QUERY_BYTES))
    row_kind, kind = vectors.schema["row_id"].dataType.simpleString(), asked.schema["query_id"].dataType.simpleString()
    found: DataFrame | None = None
    for block in range(blocks):
        part = asked.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == block).select("query_id", "embedding").toPandas()
        if not len(part):
            continue
        shared = vectors.sparkSession.sparkContext.broadcast((part["query_id"].to_numpy(), np.array(part["embedding"].tolist(), float)))

        def scored(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            ids, queries = shared.value
            for batch in batches:
                if not len(batch):
                    continue
                rows, matrix = batch["row_id"].to_numpy(), np.array(batch["embedding"].tolist(), float)
                for at in range(0, len(ids), TOGETHER):
                    score = queries[at : at + TOGETHER] @ matrix.T
                    order = value(rows, score)
                    yield pd.DataFrame({"query_id": np.repeat(ids[at : at + TOGETHER], order.shape[1]), "row_id": rows[order].ravel(), "score": np.take_along_axis(score, order, 1).ravel()})

        one = vectors.select("row_id", "embedding").mapInPandas(scored, f"query_id {kind}, row_id {row_kind}, score double")
        found = one if found is None else found.unionByName(one)
    if found is None:
        return asked.select("query_id").limit(0).crossJoin(vectors.select("row_id").limit(0)).select("query_id", "row_id", F.lit(0.0).alias("score"))
    return found


def scores(vectors: DataFrame, asked: DataFrame) -> DataFrame:
    """``query_id, row_id, score`` of every query and row; ``vectors`` and ``asked`` hold ``embedding``."""
    return _blocks(vectors, asked, lambda rows, score: np.broadcast_to(np.arange(len(rows)), score.shape))


def similarity(vectors: DataFrame, asked: DataFrame, k: int = 8) -> DataFrame:
    """The best ``k`` rows of each query.

    Each batch keeps its own best ``k`` for a query before anything is shuffled, so what moves is queries
    times batches times ``k``, not queries times rows.
    """
    from .rank import DIGITS, top_k

    best = lambda rows, score: np.lexsort((np.broadcast_to(-rows, score.shape), -np.round(score, DIGITS)), axis=1)[:, :k]
    return top_k(_blocks(vectors, asked, best), k)


def encode(df: DataFrame, id_col: str, text: str, encoder: Callable[[list[str]], np.ndarray], model: str, query: bool) -> DataFrame:
    """``id_col, embedding``: texts with the model's prefix through an encoder that is built by the caller."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            vectors = np.asarray(encoder(batch["text"].tolist()), np.float32)
            norms = np.linalg.norm(vectors, axis=1, keepdims=True)
            yield pd.DataFrame({id_col: batch[id_col], "embedding": list(vectors / np.where(norms == 0, 1, norms))})

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(id_col, T.prefixed(text, model, query).alias("text")).mapInPandas(run, f"{id_col} {kind}, embedding array<float>")


def cached(spark: SparkSession, path: str, corpus: DataFrame, fingerprint: str, make: Callable[[], DataFrame]) -> DataFrame:
    """Vectors stored at ``path``, valid if the corpus' fingerprint and number of rows are those they were made for."""
    from pyspark.errors import AnalysisException

    at = f"{path.rstrip('/')}/{fingerprint}"
    try:
        found = spark.read.parquet(at)
        if found.count() == corpus.count():
            return found
    except AnalysisException:
        pass
    make().write.mode("overwrite").parquet(at)
    return spark.read.parquet(at)
