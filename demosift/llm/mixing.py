"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Every document draws a reproducible uniform number; its key is that number's exponential scaled by the
document's quality weight, so better documents come early.  A source's target is met by complete
epochs first and then by the documents of smallest key until the budget of words is spent.  Prefix
sums run in two steps, over fixed bins of the key and inside a bin, so that no source, however large,
is sorted in one task.

Defined results: a null text has no words; a null source is a source of its own, last in order;
repeated rows are mixed one by one, in an order that leaves their sum alike; null ids are hashed as the
empty string; other columns are ignored; an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, stored

#: BINS: of a key, for each factor of e; no bin holds more than 0.04 % of a source's documents.
WEIGHTS, SHARE, CAP, BINS = (3, 1, 2), 1.5, 2, 1024
JUNK = r"[0-9#$%&*|!<>{}=_~^@/]"


def quality_weight(text: str = "text") -> Column:
    """Share of characters that are neither digits nor symbols, 0.05 at least."""
    n = F.length(text)
    return F.when(n > 0, F.greatest(F.lit(0.05), 1 - F.regexp_count(text, F.lit(JUNK)) / n)).otherwise(F.lit(1.0))


def key(doc_id: str = "doc_id", weight: str = "weight", seed: int = 1) -> Column:
    text = F.concat(F.coalesce(F.col(doc_id).cast("string"), F.lit("")), F.lit(f":{seed}"))
    draw = F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("bigint").cast("double")
    return -F.log((draw + 0.5) / 2.0**52) / F.col(weight)


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, cap: int = CAP) -> DataFrame:
    """``source, source_size, target`` of ``source, source_size``.

    Weights repeat over the sources in code-point order, null last.  Sources in order of size for weight: as long as
    one's cap lies below its share of what is left, it gives its cap; the rest share by weight.  One row
    stands for a source, so the windows over all of them are small.
    """
    if cap < share:
        raise ValueError("sources cannot give that many words")
    place = F.row_number().over(Window.orderBy(F.asc_nulls_last("source"))) - 1
    of = sizes.withColumn("w", F.get(F.array(*map(F.lit, weights)), place % len(weights)).cast("double"))
    all_, order = Window.partitionBy(), Window.orderBy(F.col("source_size") / F.col("w"), F.asc_nulls_last("source"))
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    rest = F.sum("source_size").over(all_) * F.lit(float(share)) - cap * F.coalesce(F.sum("source_size").over(before), F.lit(0))
    left = F.sum("w").over(all_) - F.coalesce(F.sum("w").over(before), F.lit(0.0))
    of = of.select("source", "source_size", "w", rest.alias("rest"), left.alias("left"))
    open_ = cap * F.col("source_size") * F.col("left") > F.col("rest") * F.col("w")
    of = of.withColumn("level", F.max(F.when(open_, F.col("rest") / F.col("left"))).over(all_))
    capped = F.col("level").isNull() | (cap * F.col("source_size") <= F.col("level") * F.col("w"))
    return of.select("source", "source_size", F.when(capped, (cap * F.col("source_size")).cast("double")).otherwise(F.col("level") * F.col("w")).alias("target"))


def mix(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 1, row_col: str | None = None, weight_col: str | None = None) -> DataFrame:
    """``id, size, source_size, target, taken, copies``: what the mix takes of every row.

    ``taken`` counts words, repeats included, the last document of a budget in part; ``copies`` counts
    whole documents, where that last one is taken if half of it is.  A column that numbers the rows is
    passed through, so that repeated and null ids can be told apart, and orders rows that are else alike.
    ``weight_col``: a document's weight, such as a classifier's score, in place of ``quality_weight``; null and
    NaN weigh one, and none weighs less than a thousandth.
    """
    number = [] if row_col is None else ["row_number"]
    base = df.select(*[df[row_col].alias(c) for c in number], df[id_col].alias("id"), df[source_col].cast("string").alias("source"), df[text_col].cast("string").alias("text"), *[df[c].cast("double").alias("given") for c in [weight_col] if c])
    weight = quality_weight() if weight_col is None else F.greatest(F.lit(0.001), F.coalesce(F.when(~F.isnan("given"), F.col("given")), F.lit(1.0)))
    base = base.select(*number, "id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"), weight.alias("weight"))
    # bins of the key's logarithm: a weight only moves them, so they are as even for any weights
    place = F.floor(F.log(F.greatest(F.col("key"), F.lit(1e-300))) * BINS).cast("int")
    base = base.withColumn("key", key("id", "weight", seed)).withColumn("bin", place)
    base = stored(base.drop("weight"), "mix")
    sizes = base.groupBy("source").agg(F.sum("size").alias("source_size"))
    plan = targets(sizes).withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long"))
    plan = plan.withColumn("budget", F.floor("target").cast("long") - F.col("epochs") * F.col("source_size"))
    bins = base.groupBy("source", "bin").agg(F.sum("size").alias("bin_size"))
    before = Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    bins = bins.withColumn("offset", F.coalesce(F.sum("bin_size").over(before), F.lit(0)))
    bins = bins.join(plan.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of"))).drop("of")
    bins = bins.withColumnsRenamed({"source": "of", "bin": "in_bin"})
    found = base.join(bins, F.col("source").eqNullSafe(F.col("of")) & (F.col("bin") == F.col("in_bin")))
    inside = Window.partitionBy("source", "bin").orderBy("key", "id", "size", *number).rowsBetween(Window.unboundedPreceding, -1)
    left = F.col("budget") - F.col("offset") - F.coalesce(F.sum("size").over(inside), F.lit(0))
    part = F.greatest(F.lit(0).cast("long"), F.least("size", left))
    chosen = (left > 0) & (2 * part >= F.col("size"))
    return found.select(*[F.col(c).alias(row_col) for c in number], F.col("id").alias(id_col), "size", "source_size", "target", (F.col("epochs") * F.col("size") + part).alias("taken"), (F.col("epochs") + chosen.cast("long")).alias("copies"))


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
    CASE WHEN length(text) > 0 THEN greatest(0.05::DOUBLE, 1 - (length(text) - length(regexp_replace(text, '[0-9#$%&*|!<>{}=_~^@/]', '', 'g')))::DOUBLE / length(text)) ELSE 1 END AS weight,
    (('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':1'), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496 AS u
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS w,
    1.5::DOUBLE * sum(source_size) OVER () AS total FROM s),
p AS (SELECT *, total - 2 * coalesce(sum(source_size) OVER o, 0) AS rest, sum(w) OVER () - coalesce(sum(w) OVER o, 0) AS weights FROM w
  WINDOW o AS (ORDER BY source_size::DOUBLE / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT max(rest / weights) FILTER (WHERE 2 * source_size * weights > rest * w) AS level FROM p),
t AS (SELECT source, source_size, CASE WHEN level IS NULL OR 2 * source_size <= level * w THEN 2.0::DOUBLE * source_size ELSE level * w END AS target FROM p, f),
b AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS epochs FROM t),
r AS (SELECT d.doc_id, d.size, b.source_size, b.target, b.epochs, floor(b.target)::BIGINT - b.epochs * b.source_size
    - coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY -ln(u) / weight, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS room
  FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source)
SELECT doc_id, size, source_size, target, (epochs * size + greatest(0, least(size, room)))::BIGINT AS taken FROM r
"""
