"""Metrics of a growing prediction log: each micro-batch adds its statistics, sums are read at any time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from demosift.operators import metrics
from demosift.operators.normalize import bad_format


def watch(spark: SparkSession, log: str, schema: str, statistics: str, checkpoint: str, group: tuple[str, ...] = metrics.GROUP) -> StreamingQuery:
    """Follows JSON files of predictions; a batch's sums replace themselves if it runs again."""
    rows = spark.readStream.schema(schema).json(log)

    def add(batch: DataFrame, number: int) -> None:
        sums(batch, group).write.mode("overwrite").parquet(f"{statistics}/batch={number}")

    return rows.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def sums(rows: DataFrame, group: tuple[str, ...] = metrics.GROUP) -> DataFrame:
    found = metrics.with_statistics(rows.dropna(subset=list(group)))
    columns = [F.sum(f"bleu_stats.{f}").alias(f"b_{f}") for f in metrics.BLEU_FIELDS] + [F.sum(f"chrf_stats.{f}").alias(f"c_{f}") for f in metrics.CHRF_FIELDS]
    return found.groupBy(*group).agg(*columns, F.count_if(bad_format("prediction")).alias("bad"), F.count_if(F.col("prediction") == "").alias("empty"), F.count("*").alias("n"))


def current(spark: SparkSession, statistics: str, group: tuple[str, ...] = metrics.GROUP) -> DataFrame:
    """Metrics of all batches so far."""
    whole = spark.read.parquet(statistics)
    names = [c for c in whole.columns if c not in group and c != "batch"]
    whole = whole.groupBy(*group).agg(*[F.sum(c).alias(c) for c in names])
    return whole.select(*group, metrics.bleu(lambda f: F.col(f"b_{f}")).alias("BLEU"), metrics.chrf(lambda f: F.col(f"c_{f}")).alias("chrF"), (F.col("bad") / F.col("n") * 100).alias("format_error_rate"), F.col("empty").alias("empty_prediction_count"), "n")
