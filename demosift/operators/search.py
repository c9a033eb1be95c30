"""The best rows of sparse scores, exactly, without scoring every pair that shares a term.

A score is a sum over the terms that a query and a row share, of the query's weight times the row's.  Each term's
postings are cut into levels of weight; a cell is one level of a term, with its largest weight and its number of rows.

First the cells that can add most are looked at until they hold enough rows, and the best of these are scored, which
gives every query a threshold: its k-th best score so far.  Then cells are given up, those first that free most rows for the bound they cost: the largest
weights of the given-up levels, summed over a query's terms, bound what a row can score that lies in no other cell.
As long as the bound stays below the threshold, such rows are never looked at.  A row in a cell that is left has
its exact weights there and the bound elsewhere; if that reaches the threshold, its score is summed in full.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from demosift.sources.storage import stored

from .rank import DIGITS

#: Levels of a term; for each wanted row, places in the best cells that are looked at, and rows of these that are scored,
#: to find the threshold; share of the threshold up to which cells are given up.
LEVELS, SEEDS, TRIED, SHARE = 32, 256, 4, 0.5
#: Scores rank by their rounded value, so bounds keep this far off.
MARGIN = 10.0 ** (1 - DIGITS)


@dataclass
class Index:
    """``postings`` (row_id, term, weight, level) and ``cells`` (term, level, most, n)."""

    postings: DataFrame
    cells: DataFrame

    @staticmethod
    def of(postings: DataFrame) -> Index:
        """From ``row_id, term, weight``; weights can be negative.  Levels rise with the weight, zero has all that add nothing."""
        tops = stored(postings.groupBy("term").agg(F.max("weight").alias("top")), "term-tops")
        level = F.when((F.col("weight") > 0) & (F.col("top") > 0), F.least(F.ceil(F.col("weight") / F.col("top") * LEVELS), F.lit(LEVELS))).otherwise(F.lit(0))
        levelled = stored(postings.join(tops, "term").select("row_id", "term", "weight", level.cast("int").alias("level")), "levelled-postings")
        cells = levelled.groupBy("term", "level").agg(F.max("weight").alias("most"), F.count("*").alias("n"))
        return Index(levelled, stored(cells, "cells"))


def _total(asked: str, weight: str) -> Column:
    """The sum of what terms add, each to fifteen places: the same in any order, so that equal rows tie."""
    return F.sum((F.col(asked) * F.col(weight)).cast("decimal(38,15)")).cast("double")


def _summed(pairs: DataFrame, index: Index, asked: DataFrame) -> DataFrame:
    """``query_id, row_id, score`` of these pairs, over all their terms."""
    terms = pairs.join(asked, "query_id").select("query_id", "row_id", "term", F.col("weight").alias("asked"))
    found = terms.join(index.postings.select("row_id", "term", "weight"), ["row_id", "term"])
    return found.groupBy("query_id", "row_id").agg(_total("asked", "weight").alias("score"))


def _cells(index: Index, asked: DataFrame) -> DataFrame:
    """``query_id, term, level, n, gain``: what a cell adds to a score at most."""
    mine = asked.withColumnRenamed("weight", "asked").join(index.cells, "term")
    return mine.select("query_id", "term", "level", "n", "asked", F.greatest(F.col("asked") * F.col("most"), F.lit(0.0)).alias("gain"))


def _thresholds(index: Index, asked: DataFrame, cells: DataFrame, k: int) -> DataFrame:
    """``query_id, floor``: a score that ``k`` rows reach; queries for which none is known, or none above zero, are absent."""
    by_gain = Window.partitionBy("query_id").orderBy(F.desc("gain"), "term", "level")
    earlier = F.coalesce(F.sum("n").over(by_gain.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    seeds = cells.where("gain > 0").withColumn("earlier", earlier).where(F.col("earlier") < SEEDS * k)
    hits = seeds.join(index.postings, ["term", "level"]).groupBy("query_id", "row_id").agg(F.sum(F.col("asked") * F.col("weight")).alias("part"))
    by_part = Window.partitionBy("query_id").orderBy(F.desc("part"), "row_id")
    pairs = hits.withColumn("nth", F.row_number().over(by_part)).where(F.col("nth") <= TRIED * k).select("query_id", "row_id")
    by_score = Window.partitionBy("query_id").orderBy(F.desc("score"))
    best = _summed(pairs, index, asked).withColumn("nth", F.row_number().over(by_score))
    return best.where((F.col("nth") == k) & (F.round("score", DIGITS) > 0)).select("query_id", F.col("score").alias("floor"))


def _given_up(cells: DataFrame, floors: DataFrame, share: float) -> DataFrame:
    """Cells with ``floor``, whether they are ``left``, and what their term's given-up levels add at most (``bound``)."""
    levels = Window.partitionBy("query_id", "term").orderBy("level")
    step = F.col("gain") - F.coalesce(F.lag("gain").over(levels), F.lit(0.0))
    rows_for_bound = F.when(F.col("step") > 0, F.col("n") / F.col("step")).otherwise(F.lit(float("inf")))
    found = cells.withColumn("step", step).withColumn("worth", rows_for_bound)
    # a level goes after those below it
    found = found.withColumn("worth", F.min("worth").over(levels.rowsBetween(Window.unboundedPreceding, 0)))
    found = found.join(floors, "query_id", "left")
    by_worth = Window.partitionBy("query_id").orderBy(F.desc("worth"), "term", "level").rowsBetween(Window.unboundedPreceding, 0)
    allowed = (F.col("floor") - MARGIN) * share
    found = found.withColumn("left", F.col("floor").isNull() | (F.sum("step").over(by_worth) > allowed))
    bound = F.max(F.when(~F.col("left"), F.col("gain")).otherwise(F.lit(0.0)))
    return found.withColumn("bound", bound.over(Window.partitionBy("query_id", "term")))


def _reaching(index: Index, cells: DataFrame) -> DataFrame:
    """``query_id, row_id`` of pairs in a cell that is left, whose bound reaches the threshold."""
    hits = cells.where("left").join(index.postings, ["term", "level"])
    over = F.sum(F.col("asked") * F.col("weight") - F.col("bound")).alias("over")
    # what a query's given-up cells add at most, over all its terms
    most = cells.groupBy("query_id", "term").agg(F.first("bound").alias("bound"), F.first("floor").alias("floor"))
    most = most.groupBy("query_id").agg(F.sum("bound").alias("rest"), F.first("floor").alias("floor"))
    found = hits.groupBy("query_id", "row_id").agg(over).join(most, "query_id")
    reaches = F.col("floor").isNull() | (F.col("over") + F.col("rest") >= F.col("floor") - MARGIN)
    return found.where(reaches).select("query_id", "row_id")


def best(index: Index, asked: DataFrame, k: int, share: float = SHARE, seen: Observation | None = None) -> DataFrame:
    """``query_id, row_id, score``, stored: all pairs that can rank among a query's first ``k``.

    ``asked`` has ``query_id, term, weight``, each pair of the first two once, no weight negative.  Where fewer than
    ``k`` rows score above zero all pairs with a common term are there.  ``seen`` counts the pairs that were scored.
    """
    asked = stored(asked, "asked")
    cells = stored(_cells(index, asked), "asked-cells")
    floors = stored(_thresholds(index, asked, cells, k), "floors")
    pairs = _reaching(index, stored(_given_up(cells, floors, share), "given-up"))
    if seen is not None:
        pairs = pairs.observe(seen, F.count("*").alias("scored"))
    return stored(_summed(pairs, index, asked), "best-scores")


def matched(index: Index, asked: DataFrame) -> DataFrame:
    """``query_id, row_id, score`` of every pair with a common term."""
    found = index.postings.join(asked.withColumnRenamed("weight", "asked"), "term")
    return found.groupBy("query_id", "row_id").agg(_total("asked", "weight").alias("score"))

