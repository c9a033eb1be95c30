"""Connected components of an edge table, by contraction.

Each round hooks every node to its smallest neighbour, shortens the pointers, and rewrites the edges to
the pointers' ends; what is left is a smaller graph of distinct edges.  Nodes that many edges point to
appear only as join values, never as one group of rows, and all state lives in stored tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node, root`` for every node that has an edge to another; equal roots mean connected.

    Null ends and loops are no edges; repeated edges count once; no edge gives an empty table.
    """
    pair = edges.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col("a") != F.col("b")))
    left = stored(pair.distinct(), "edges")
    labels: DataFrame | None = None
    while not left.isEmpty():
        both = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hooked = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("near")).select("node", F.least("node", "near").alias("root"))
        for _ in range(2):
            ends = hooked.select(F.col("node").alias("root"), F.col("root").alias("end"))
            hooked = hooked.join(ends, "root").select("node", F.col("end").alias("root"))
        hooked = stored(hooked, "labels")
        one = hooked.select(F.col("node").alias("a"), F.col("root").alias("ra"))
        two = hooked.select(F.col("node").alias("b"), F.col("root").alias("rb"))
        moved = left.join(one, "a").join(two, "b").where(F.col("ra") != F.col("rb"))
        left = stored(moved.select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct(), "edges")
        if labels is None:
            labels = hooked
        else:
            ends = hooked.select(F.col("node").alias("root"), F.col("root").alias("end"))
            labels = labels.join(ends, "root", "left").select("node", F.coalesce("end", "root").alias("root"))
    if labels is None:
        return left.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return labels
