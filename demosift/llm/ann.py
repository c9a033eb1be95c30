"""Nearest neighbours by randomly rotated one-bit codes.

A vector is normalised, padded and rotated at random; the signs of its coordinates are its code, packed
into 64-bit words, and one scalar - the length of its projection on its code - corrects estimates.  A
query is rotated alike and its inner product with every code is estimated without touching the vectors.
The estimate's error is bounded by a multiple of that scalar's spread, so a candidate whose upper bound
stays below the k-th best value found so far is discarded, and all others are scored exactly.

Rows are packed into blocks with their codes, queries into blocks of bounded size; every row block meets
every query block once, dealt by (query block, salt) so that no join key gathers the rows.  Equal
vectors are collapsed before to the few smallest ids that any answer could hold.

Defined results: vectors that are null, empty, zero or hold null or non-finite components, or whose
length differs from the query's, take no part, nor do rows without id; a vector that is repeated under
its own id is one candidate; equal scores rank by smaller id; other columns are ignored; fewer
candidates than ``k`` are all returned; an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import partitions

#: Rows of a block, queries of a block, standard deviations of the error bound, bits for each dimension.
ROWS, QUERIES, BOUND, SPREAD, SEED = 4096, 8192, 4.0, 4, 11


def rotation(dim: int, seed: int = SEED) -> np.ndarray:
    """Orthonormal columns that take ``dim`` coordinates to a padded space of more."""
    wide = -(-dim * SPREAD // 64) * 64
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((wide, dim)))
    return (q * np.sign(np.diag(r))).T


class Codes:
    """Packed codes of unit vectors, and the projection of each vector on its code."""

    def __init__(self, unit: np.ndarray, turn: np.ndarray):
        turned = unit @ turn
        signs = turned > 0
        self.bits = np.packbits(signs, axis=1, bitorder="little").view(np.uint64)
        self.wide = turn.shape[1]
        self.along = np.abs(turned).sum(axis=1) / np.sqrt(self.wide)

    def estimate(self, turned_query: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Estimated inner products with a rotated unit query, and the bound of each one's error."""
        signs = np.unpackbits(self.bits.view(np.uint8), axis=1, bitorder="little")
        return self.estimate_block(turned_query[None, :], signs)[0][0], self.error()

    def estimate_block(self, turned: np.ndarray, signs: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        if signs is None:
            signs = np.unpackbits(self.bits.view(np.uint8), axis=1, bitorder="little")
        dots = turned.astype(np.float32) @ (signs.astype(np.float32) * 2 - 1).T
        return dots / np.sqrt(self.wide) / self.along[None, :], self.error()

    def error(self) -> np.ndarray:
        return BOUND * np.sqrt(np.maximum(1 - self.along**2, 0)) / self.along / np.sqrt(self.wide - 1)


def exact(vectors: np.ndarray, norms: np.ndarray, query: np.ndarray, norm: float) -> np.ndarray:
    """Cosines in double precision, each summed alike, so that equal vectors score equally."""
    return (vectors * query[None, :]).sum(axis=1) / (norms * norm)


def search_block(ids: np.ndarray, vectors: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int, turn: np.ndarray, codes: Codes | None = None) -> list[tuple[int, int, float]]:
    """The ``k`` nearest of a block for each query, but for the query's own id."""
    norms, query_norms = np.sqrt((vectors * vectors).sum(axis=1)), np.sqrt((queries * queries).sum(axis=1))
    codes = codes or Codes(vectors / norms[:, None], turn)
    error = codes.error()
    signs = np.unpackbits(codes.bits.view(np.uint8), axis=1, bitorder="little")
    out = []
    for begin in range(0, len(query_ids), 128):
        unit = queries[begin : begin + 128] / query_norms[begin : begin + 128, None]
        estimates, _ = codes.estimate_block(unit @ turn, signs)
        for j, estimate in enumerate(estimates):
            q = begin + j
            upper = np.where(ids == query_ids[q], -np.inf, estimate + error)
            # score the best estimates first: their k-th value is the bar for all upper bounds
            first = np.argpartition(-upper, min(4 * k, len(ids) - 1))[: 4 * k]
            score = np.full(len(ids), -np.inf)
            score[first] = exact(vectors[first], norms[first], queries[q], query_norms[q])
            score[ids == query_ids[q]] = -np.inf
            bar = np.sort(score)[-k] if len(ids) >= k else -np.inf
            rest = np.flatnonzero((upper >= bar) & (score == -np.inf) & (ids != query_ids[q]))
            score[rest] = exact(vectors[rest], norms[rest], queries[q], query_norms[q])
            best = np.lexsort((ids, -score))[:k]
            out += [(int(query_ids[q]), int(ids[i]), float(score[i])) for i in best if score[i] > -np.inf]
    return out


def usable(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``id, v`` of rows that take part; components stay floats where they are, and are doubles else."""
    single = df.schema[vector_col].dataType.elementType.simpleString() == "float"
    rows = df.select(df[id_col].cast("long").alias("id"), df[vector_col].cast("array<float>" if single else "array<double>").alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.where(F.col("id").isNotNull() & (F.size("v") > 0) & F.coalesce(finite, F.lit(False)) & F.exists("v", lambda x: x != 0))


def _gathered(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Batches put together to ``most`` rows or more."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= most:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held = []
    if sum(b.num_rows for b in held):
        yield pa.Table.from_batches([b for b in held if b.num_rows]).combine_chunks().to_batches()[0]


def _pack(rows: DataFrame, most: int, name: str) -> DataFrame:
    """Blocks of up to ``most`` rows of one length: ``dim``, ids and vectors as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _gathered(batches, most):
            for at in range(0, batch.num_rows, most):
                part = batch.slice(at, most)
                ids, vectors = part.column(0).to_numpy(), part.column(1)
                lengths = np.diff(vectors.offsets.to_numpy())
                flat = vectors.flatten().to_numpy()
                stops = np.cumsum(lengths)
                for dim in np.unique(lengths):
                    own = np.flatnonzero(lengths == dim)
                    matrix = flat[(stops[own] - dim)[:, None] + np.arange(dim)]
                    yield pa.RecordBatch.from_arrays([pa.array([int(dim)], pa.int32()), pa.array([ids[own].tobytes()]), pa.array([matrix.tobytes()])], ["dim", "ids", "vectors"])

    return rows.select("id", "v").mapInArrow(run, "dim int, ids binary, vectors binary").withColumnsRenamed({"ids": f"{name}_ids", "vectors": f"{name}_vectors"})


def nearest(df: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``query_id, rank, id, score``: the ``k`` nearest rows of ``df`` by cosine for every row of ``queries``."""
    spark = df.sparkSession
    n = partitions(spark)
    # an answer holds at most k rows of one vector, and one more may be the query itself
    copies = Window.partitionBy("v").orderBy("id")
    rows = usable(df, id_col, vector_col).withColumn("copy", F.dense_rank().over(copies)).where(F.col("copy") <= k + 1).select("id", "v").distinct()
    asked = usable(queries, id_col, vector_col).distinct()
    blocks = -(-asked.count() // QUERIES) or 1
    # rows lie dealt by vector already; a block crosses once for each query block, and these are large
    row_blocks = _pack(rows, ROWS, "row").withColumn("salt", F.spark_partition_id() % n)
    row_blocks = row_blocks.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    dealt = asked.repartition(blocks, F.pmod(F.xxhash64("id"), F.lit(blocks)))
    query_blocks = _pack(dealt, QUERIES, "query").withColumn("block", F.spark_partition_id() % blocks)
    query_blocks = query_blocks.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    # a task's hash table holds query blocks, which are of bounded size
    met = row_blocks.join(query_blocks.hint("shuffle_hash"), ["dim", "block", "salt"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turns: dict[int, np.ndarray] = {}
        last: tuple[bytes, np.ndarray, Codes] | None = None
        for batch in batches:
            for r in range(batch.num_rows):
                dim, row_ids, row_vectors, query_ids, query_vectors = (c[r].as_py() for c in batch.columns)
                if dim not in turns:
                    turns[dim] = rotation(dim)
                turn = turns[dim]
                unpacked = lambda raw, n, dim=dim: np.frombuffer(raw, np.float32 if len(raw) == 4 * n * dim else np.float64).reshape(-1, dim).astype(np.float64)
                ids, asked_ids = np.frombuffer(row_ids, np.int64), np.frombuffer(query_ids, np.int64)
                vectors = unpacked(row_vectors, len(ids))
                if last is None or last[0] != row_ids:
                    last = row_ids, ids, Codes(vectors / np.sqrt((vectors * vectors).sum(axis=1))[:, None], turn)
                found = search_block(ids, vectors, asked_ids, unpacked(query_vectors, len(asked_ids)), k, turn, last[2])
                cols = list(zip(*found, strict=True)) or [(), (), ()]
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.float64())], ["query_id", "id", "score"])

    found = met.select("dim", "row_ids", "row_vectors", "query_ids", "query_vectors").mapInArrow(run, "query_id long, id long, score double")
    # a pair can come up twice only if an id has several vectors; its best counts
    best = found.groupBy("query_id", "id").agg(F.max("score").alias("score"))
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", F.col("id").alias(id_col), "score")
