"""The bipartite graph of rows and their features: cosine and personalized PageRank.

Edges are one table of (row, feature, weight) with the share of an edge in its feature's and in its row's
weight.  Rows meet features by an equi-join, never each other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from demosift.functions import text as T
from demosift.sources.storage import stored

# fixed values: weights of the kinds of features
WEIGHTS = {"token": 3.0, "bigram": 2.2, "suffix3": 1.2, "type": 1.0, "suffix4": 0.9, "length": 0.8, "prefix3": 0.6}
STEPS, RESTART = 8, 0.35
#: Edges of a graph that is walked as arrays in each worker; above, the walk is relational.
ARRAY_EDGES = 16_000_000


def _feature(kind: str, value: Column) -> Column:
    return F.struct(F.concat(F.lit(f"{kind}:"), value).alias("feature"), F.lit(WEIGHTS[kind]).alias("weight"))


def row_features(tokens: Column, type_: Column | None, length: Column | None) -> Column:
    """All weighted features of a row, repeats included."""
    long = lambda n: F.filter(tokens, lambda t: F.length(t) >= n)
    parts = [
        F.transform(tokens, lambda t: _feature("token", t)),
        F.transform(long(3), lambda t: _feature("suffix3", F.right(t, F.lit(3)))),
        F.transform(long(3), lambda t: _feature("prefix3", F.left(t, F.lit(3)))),
        F.transform(long(4), lambda t: _feature("suffix4", F.right(t, F.lit(4)))),
        F.transform(T.bigrams(tokens), lambda t: _feature("bigram", t)),
        F.array(_feature("length", T.length_bucket(length, tokens))),
    ]
    if type_ is not None:
        kind = F.lower(T.strip(F.coalesce(type_, F.lit(""))))
        parts.append(F.when(kind != "", F.array(_feature("type", kind))).otherwise(F.filter(F.array(_feature("type", kind)), lambda _: F.lit(False))))
    return F.concat(*parts)


def _features_of(df: DataFrame, id_col: str, text: str, type_col: str | None, length_col: str | None, normalised: bool, dealt: bool) -> DataFrame:
    """``id_col, features`` (repeats included)."""
    optional = lambda c: F.col(c) if c and c in df.columns else None
    kind, length = optional(type_col), optional(length_col)
    columns = {"tokens": T.graph_tokens(text, normalised)} | {n: c for n, c in (("kind", kind), ("stated", length)) if c is not None}
    rows = (df.repartition(id_col) if dealt else df).select(id_col, *[c.alias(n) for n, c in columns.items()])
    found = row_features(F.col("tokens"), F.col("kind") if kind is not None else None, F.col("stated") if length is not None else None)
    return rows.select(id_col, found.alias("features"))


def raw_features(df: DataFrame, id_col: str, text: str, type_col: str | None = "type", length_col: str | None = "length", normalised: bool = False) -> DataFrame:
    """``id_col, feature, raw``: weights summed over repeats."""
    # rows are dealt by id before their features are made, so that counting these moves nothing more
    rows = _features_of(df, id_col, text, type_col, length_col, normalised, dealt=True)
    return rows.select(id_col, F.explode("features").alias("f")).groupBy(id_col, F.col("f.feature").alias("feature")).agg(F.sum("f.weight").alias("raw"))


def _idf() -> Column:
    return F.log((F.col("n") + 1) / (F.col("df") + 1)) + 1


def feature_counts(corpus: DataFrame, text: str = "source_text", normalised: bool = False) -> DataFrame:
    """``feature, df, idf``, counted from the texts alone: no edge is stored or moved.  Row ids name one row each."""
    rows = _features_of(corpus, "row_id", text, "type", "length", normalised, dealt=False)
    names = rows.select(F.explode(F.array_distinct(F.transform("features", lambda f: f["feature"]))).alias("feature"))
    n = corpus.agg(F.greatest(F.lit(1), F.count("*")).alias("n"))
    known = names.groupBy("feature").agg(F.count("*").alias("df")).crossJoin(F.broadcast(n))
    return known.select("feature", "df", _idf().alias("idf"))


def known_features(corpus: DataFrame, text: str = "source_text", normalised: bool = False) -> tuple[DataFrame, DataFrame]:
    """``row_id, feature, raw`` of all rows, stored, and ``feature, df, raw_total, idf``."""
    raw = stored(raw_features(corpus, "row_id", text, normalised=normalised), "row-features")
    rows = corpus.agg(F.greatest(F.lit(1), F.count("*")).alias("n"))
    known = raw.groupBy("feature").agg(F.count("*").alias("df"), F.sum("raw").alias("raw_total")).crossJoin(F.broadcast(rows))
    known = known.select("feature", "df", "raw_total", _idf().alias("idf"))
    return raw, known


#: Features that nearly every row can have (types, lengths, common endings): so many meet their edges apart.
COMMON = 64


def _with_known(raw: DataFrame, known: DataFrame) -> DataFrame:
    """Edges with what is known of their feature; the most frequent features are few, and no task gets all their edges."""
    common = F.broadcast(stored(known.orderBy(F.desc("df"), "feature").limit(COMMON), "common-features"))
    return raw.join(common, "feature").unionByName(raw.join(common.select("feature"), "feature", "left_anti").join(known, "feature"))


def weights(raw: DataFrame, known: DataFrame) -> DataFrame:
    """``row_id, feature, weight``: edges without the shares that only a walk needs."""
    return _with_known(raw, known).select("row_id", "feature", (F.col("raw") * F.col("idf")).alias("weight"))


def build(corpus: DataFrame, text: str = "source_text", normalised: bool = False) -> tuple[DataFrame, DataFrame]:
    """Edges ``row_id, feature, weight, p_s_given_f, p_f_given_s`` and ``feature, df, idf``."""
    raw, known = known_features(corpus, text, normalised)
    return shares(raw, known), known.select("feature", "df", "idf")


def shares(raw: DataFrame, known: DataFrame) -> DataFrame:
    """Edges with their shares in their feature's and their row's weight."""
    # a feature's weights share its idf, so its total comes with the document frequency; a row's total needs
    # one more shuffle, by row, and a row is no larger than its text
    edges = _with_known(raw, known).select("row_id", "feature", (F.col("raw") * F.col("idf")).alias("weight"), (F.col("raw_total") * F.col("idf")).alias("feature_total"))
    share = lambda total: F.col("weight") / F.when(total == 0, F.lit(1.0)).otherwise(total)
    of_row = F.sum("weight").over(Window.partitionBy("row_id"))
    return edges.select("row_id", "feature", "weight", share(F.col("feature_total")).alias("p_s_given_f"), share(of_row).alias("p_f_given_s"))


def query_features(queries: DataFrame, idf: DataFrame, text: str = "text", normalised: bool = False) -> DataFrame:
    """``query_id, feature, weight``; features that no row has count with idf one."""
    raw = raw_features(queries, "query_id", text, normalised=normalised)
    return raw.join(idf, "feature", "left").select("query_id", "feature", (F.col("raw") * F.coalesce("idf", F.lit(1.0))).alias("weight"))


def common_scores(edges: DataFrame, asked: DataFrame) -> DataFrame:
    """Cosine of query and row features; the query's norm includes features unknown to the graph."""
    norm = lambda df, key: df.groupBy(key).agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias(f"{key}_norm"))
    hits = edges.select("row_id", "feature", "weight").join(asked.withColumnRenamed("weight", "asked"), "feature")
    dots = hits.groupBy("query_id", "row_id").agg(F.sum(F.col("weight") * F.col("asked")).alias("dot"))
    found = dots.join(norm(asked, "query_id"), "query_id").join(norm(edges, "row_id"), "row_id")
    return found.select("query_id", "row_id", (F.col("dot") / F.greatest(F.col("query_id_norm") * F.col("row_id_norm"), F.lit(1e-12))).alias("score"))


def restart(edges: DataFrame, asked: DataFrame) -> DataFrame:
    """``query_id, feature, mass``: the query's weight over features that the graph has."""
    known = asked.join(edges.select("feature").distinct(), "feature", "left_semi")
    total = F.sum("weight").over(Window.partitionBy("query_id"))
    return known.select("query_id", "feature", (F.col("weight") / total).alias("mass"))


def ppr_scores(edges: DataFrame, asked: DataFrame, steps: int = STEPS, alpha: float = RESTART, array_edges: int = ARRAY_EDGES) -> DataFrame:
    """Mass on each row after ``steps`` half steps from features to rows, restarting at the query.

    Small graphs are walked as arrays (their size is counted first), larger ones by joins; both give
    the same numbers.  Queries none of whose features is known have no scores.
    """
    steps, alpha = max(1, int(steps)), min(0.95, max(0.05, float(alpha)))
    start = restart(edges, asked)
    walk = _walk_arrays if edges.count() <= array_edges else _walk_tables
    return walk(edges, start, steps, alpha)


def _walk_tables(edges: DataFrame, start: DataFrame, steps: int, alpha: float) -> DataFrame:
    start = stored(start, "restart")
    mass = start
    for step in range(steps):
        rows = edges.join(mass, "feature").groupBy("query_id", "row_id").agg(F.sum(F.col("mass") * F.col("p_s_given_f")).alias("score"))
        rows = stored(rows, "walk-rows")
        if step == steps - 1:
            return rows
        back = edges.join(rows, "row_id").groupBy("query_id", "feature").agg((F.sum(F.col("score") * F.col("p_f_given_s")) * (1 - alpha)).alias("mass"))
        both = back.unionByName(start.select("query_id", "feature", (F.col("mass") * alpha).alias("mass")))
        mass = stored(both.groupBy("query_id", "feature").agg(F.sum("mass").alias("mass")), "walk-features")
    raise AssertionError("at least one step is walked")


#: Queries that are walked together in a task, and edges that are multiplied at a time.
TOGETHER, CHUNK = 8, 500_000


class _Side:
    """Edges sorted by their target: sums of source values times weights, for several queries at once."""

    def __init__(self, target: np.ndarray, source: np.ndarray, share: np.ndarray, n: int):
        order = np.argsort(target, kind="stable")
        self.source, self.share, self.n = source[order].astype(np.int32), share[order], n
        sorted_target = target[order]
        self.begins = np.flatnonzero(np.concatenate([[True], sorted_target[1:] != sorted_target[:-1]])) if len(order) else np.zeros(0, np.int64)
        self.targets = sorted_target[self.begins]

    def sums(self, values: np.ndarray) -> np.ndarray:
        out = np.zeros((self.n, values.shape[1]))
        first = 0
        while first < len(self.begins):
            last = max(first + 1, int(np.searchsorted(self.begins, self.begins[first] + CHUNK)))
            a, b = self.begins[first], self.begins[last] if last < len(self.begins) else len(self.source)
            part = values[self.source[a:b]] * self.share[a:b, None]
            out[self.targets[first:last]] = np.add.reduceat(part, self.begins[first:last] - a, axis=0)
            first = last
        return out


def _walk_arrays(edges: DataFrame, start: DataFrame, steps: int, alpha: float) -> DataFrame:
    spark = edges.sparkSession
    # numbers in place of names, so that no strings leave the executors
    numbers = stored(edges.select("feature").distinct().withColumn("number", F.monotonically_increasing_id()), "feature-numbers")
    table = edges.join(numbers, "feature").select("row_id", "number", "p_s_given_f", "p_f_given_s").toArrow()
    rows, at_row = np.unique(table.column("row_id").to_numpy(), return_inverse=True)
    known, at_feature = np.unique(table.column("number").to_numpy(), return_inverse=True)
    to_rows = _Side(at_row, at_feature, table.column("p_s_given_f").to_numpy(), len(rows))
    to_features = _Side(at_feature, at_row, table.column("p_f_given_s").to_numpy(), len(known))
    shared = spark.sparkContext.broadcast((rows, known, to_rows, to_features))

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows, known, to_rows, to_features = shared.value
        for batch in batches:
            for begin in range(0, len(batch), TOGETHER):
                part = batch.iloc[begin : begin + TOGETHER]
                first = np.zeros((len(known), len(part)))
                for j, (found, weight) in enumerate(zip(part["features"], part["masses"], strict=True)):
                    first[np.searchsorted(known, found), j] = weight
                mass = first
                for step in range(steps):
                    score = to_rows.sums(mass)
                    if step < steps - 1:
                        mass = (1 - alpha) * to_features.sums(score) + alpha * first
                for j, query in enumerate(part["query_id"]):
                    hit = np.flatnonzero(score[:, j] > 0)
                    yield pd.DataFrame({"query_id": query, "row_id": rows[hit], "score": score[hit, j]})

    kind = start.schema["query_id"].dataType.simpleString()
    row_kind = edges.schema["row_id"].dataType.simpleString()
    packed = start.join(numbers, "feature").groupBy("query_id").agg(F.collect_list("number").alias("features"), F.collect_list("mass").alias("masses"))
    tasks = spark.sparkContext.defaultParallelism
    return packed.repartition(tasks, "query_id").mapInPandas(walk, f"query_id {kind}, row_id {row_kind}, score double")
