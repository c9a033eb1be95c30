"""Ranking, completion and blending of scores.

Scores rank by their value rounded to ten digits, so that noise of summation does not order equal ones,
and then by the larger row id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from demosift.sources.storage import stored

DIGITS = 10
BLENDS = {
    "hybrid_graph": {"dense": 0.55, "graph_ppr": 0.30, "graph_common": 0.15},
    "graph_ppr_bm25_dense": {"dense": 0.55, "graph_ppr": 0.30, "bm25": 0.15},
}


def top_k(scores: DataFrame, k: int) -> DataFrame:
    """``query_id, row_id, score, rank`` of the best ``k`` rows of each query; NaN ranks last."""
    value = F.when(F.isnan("score"), F.lit(float("-inf"))).otherwise(F.round("score", DIGITS))
    order = Window.partitionBy("query_id").orderBy(value.desc(), F.desc("row_id"))
    return scores.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


#: Row ids that are looked at together where absent rows are sought.
RANGE = 4096


def _numbered_ranges(rows: DataFrame) -> DataFrame:
    """``range, n, place``: ranges of row ids, how many rows they hold, and their place from the top.

    Counted in two steps, so that no task sees more than one in ``RANGE`` of them but for their own.
    """
    counts = rows.groupBy(F.floor(F.col("row_id") / RANGE).alias("range")).agg(F.count("*").alias("n"))
    counts = stored(counts.withColumn("above", F.floor(F.col("range") / RANGE)), "row-ranges")
    outer = counts.groupBy("above").agg(F.count("*").alias("size"))
    before = F.sum("size").over(Window.orderBy(F.desc("above")).rowsBetween(Window.unboundedPreceding, -1))
    outer = stored(outer.select("above", F.coalesce(before, F.lit(0)).alias("before")), "outer-ranges")
    place = F.row_number().over(Window.partitionBy("above").orderBy(F.desc("range")))
    return counts.withColumn("own", place).join(outer, "above").select("range", "n", (F.col("before") + F.col("own")).alias("place"))


def complete(scores: DataFrame, queries: DataFrame, rows: DataFrame, k: int) -> DataFrame:
    """Adds rows of score zero that can reach the first ``k``: those a sparse join leaves out still rank.

    Only queries with fewer than ``k`` positive scores need any, and then only the largest absent row ids; of these
    queries ``scores`` holds every row they match.  Row ids are whole numbers.  A query that matches rows in ``m``
    ranges of ids finds enough absent ones in the ``m + k`` largest ranges; of these, only as many are looked into as
    hold them by the counts of their rows.
    """
    of_query = scores.groupBy("query_id").agg(F.count_if(F.round("score", DIGITS) > 0).alias("positive"))
    need = queries.select("query_id").join(of_query, "query_id", "left").where(F.coalesce("positive", F.lit(0)) < k).select("query_id")
    need = stored(need, "queries-to-complete")
    if need.isEmpty():
        return scores
    taken = scores.join(need, "query_id", "left_semi").groupBy("query_id", F.floor(F.col("row_id") / RANGE).alias("range")).agg(F.count("*").alias("taken"))
    taken = stored(taken, "matched-ranges")
    depth = need.join(taken.groupBy("query_id").agg(F.count("*").alias("m")), "query_id", "left").select("query_id", (F.coalesce("m", F.lit(0)) + k).alias("depth"))
    top = depth.select("query_id", F.explode(F.sequence(F.lit(1).cast("long"), "depth")).alias("place")).join(_numbered_ranges(rows), "place")
    top = top.join(taken, ["query_id", "range"], "left").withColumn("absent", F.col("n") - F.coalesce("taken", F.lit(0))).where("absent > 0")
    earlier = F.coalesce(F.sum("absent").over(Window.partitionBy("query_id").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    top = top.withColumn("earlier", earlier).where(F.col("earlier") < k).select("query_id", "range")
    absent = top.join(rows.select("row_id", F.floor(F.col("row_id") / RANGE).alias("range")), "range").select("query_id", "row_id")
    absent = absent.join(scores.select("query_id", "row_id"), ["query_id", "row_id"], "left_anti")
    return scores.select("query_id", "row_id", "score").unionByName(absent.withColumn("score", F.lit(0.0)))


def normalized(score: Column, low: Column, high: Column) -> Column:
    """Min-max scaled; a constant (up to a billionth) becomes zero."""
    flat = F.abs(high - low) <= F.lit(1e-9) * F.greatest(F.abs(high), F.abs(low))
    return F.when(flat, F.lit(0.0)).otherwise((score - low) / (high - low))


def normalize(scores: DataFrame, total_rows: int | None = None) -> DataFrame:
    """Min-max scaled scores of each query.

    ``total_rows``: how many rows there are where absent ones count as zero; by default none is absent.
    """
    ends = scores.groupBy("query_id").agg(F.min("score").alias("low"), F.max("score").alias("high"), F.count("*").alias("n"))
    if total_rows is not None:
        partial = F.col("n") < total_rows
        ends = ends.withColumns({"low": F.when(partial, F.least("low", F.lit(0.0))).otherwise(F.col("low")), "high": F.when(partial, F.greatest("high", F.lit(0.0))).otherwise(F.col("high"))})
    # a row for a query: stored, so that the planner knows how small it is and moves no scores
    ends = stored(ends, "score-ends")
    return scores.join(ends, "query_id").select("query_id", "row_id", normalized(F.col("score"), F.col("low"), F.col("high")).alias("score"))


def blend(parts: dict[str, DataFrame], weights: dict[str, float], total_rows: int) -> DataFrame:
    """Weighted sum of scaled scores, of every pair that some part scores.

    A pair that a part leaves out counts there as zero before scaling, which makes one value for a query: these
    values are summed for the query, and a scored pair adds by how much it differs from its part's.  ``total_rows``:
    how many rows there are.  A query without any score in a part gets nothing from it.
    """
    pairs: DataFrame | None = None
    bases: DataFrame | None = None
    for name, weight in weights.items():
        part = parts[name]
        ends = part.groupBy("query_id").agg(F.min("score").alias("low"), F.max("score").alias("high"), F.count("*").alias("n"))
        partial = F.col("n") < total_rows
        ends = ends.withColumns({"low": F.when(partial, F.least("low", F.lit(0.0))).otherwise(F.col("low")), "high": F.when(partial, F.greatest("high", F.lit(0.0))).otherwise(F.col("high"))})
        ends = ends.withColumn("absent", F.when(partial, normalized(F.lit(0.0), F.col("low"), F.col("high")) * weight).otherwise(F.lit(0.0)))
        scaled = normalized(F.col("score"), F.col("low"), F.col("high")) * weight
        one = part.join(ends, "query_id").select("query_id", "row_id", (scaled - F.col("absent")).alias("score"))
        base = ends.select("query_id", "absent")
        pairs, bases = (one, base) if pairs is None else (pairs.unionByName(one), bases.unionByName(base))
    bases = bases.groupBy("query_id").agg(F.sum("absent").alias("base"))
    found = pairs.groupBy("query_id", "row_id").agg(F.sum("score").alias("score"))
    return found.join(bases, "query_id").select("query_id", "row_id", (F.col("score") + F.col("base")).alias("score"))


def with_rows(ranked: DataFrame, corpus: DataFrame) -> DataFrame:
    """Ranked rows with the corpus' columns; the score is named as in a report of examples."""
    return ranked.withColumnRenamed("score", "retrieval_score").join(corpus, "row_id")
