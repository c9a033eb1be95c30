"""Dictionaries induced from parallel text: reading an aligner's pairs, running one, or aligning here."""

from __future__ import annotations

import os
import subprocess
import sys
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from demosift.functions import text as T
from demosift.sources.storage import stored

THRESHOLD = 0.6


def parse_pairs(lines: DataFrame, threshold: float = THRESHOLD, line: str = "value", keep: tuple[str, ...] = ()) -> DataFrame:
    """``source_text, target_text, score`` of lines of tab-separated pairs.

    Lines without a tab are split at white space; a missing or unreadable score is one; pairs below the
    threshold and scores that are no number go.  ``keep``: columns that stay, such as the lines' order.
    """
    one = lines.select(*keep, T.strip(line).alias("line")).where("line <> ''")
    tabs = F.split("line", "\t", -1)
    parts = one.select(*keep, F.when(F.size(tabs) >= 2, tabs).otherwise(F.split("line", T.WHITE, -1)).alias("p")).where(F.size("p") >= 2)
    score = F.when(F.size("p") >= 3, F.coalesce(T.strip(F.get("p", 2)).try_cast("double"), F.lit(1.0))).otherwise(F.lit(1.0))
    out = parts.select(*keep, T.strip(F.get("p", 0)).alias("source_text"), T.strip(F.get("p", 1)).alias("target_text"), score.alias("score"))
    return out.where((F.col("source_text") != "") & (F.col("target_text") != "") & ~F.isnan("score") & (F.col("score") >= float(threshold)))


def read_pairs(spark: SparkSession, path: str, threshold: float = THRESHOLD) -> DataFrame:
    return parse_pairs(spark.read.text(path), threshold)


def tokenized_pairs(corpus: DataFrame) -> DataFrame:
    """``row_id, source, target``: tokens joined by spaces; pairs with an empty side go."""
    side = lambda c: F.array_join(T.lexicon_tokens(F.coalesce(F.col(c), F.lit(""))), " ")
    return corpus.select("row_id", side("source_text").alias("source"), side("target_text").alias("target")).where("source <> '' AND target <> ''")


def write_pairs(corpus: DataFrame, source_path: str, target_path: str) -> int:
    """Two aligned text files on the driver, row by row: what an external aligner reads."""
    n = 0
    with open(source_path, "w", encoding="utf-8") as s, open(target_path, "w", encoding="utf-8") as t:
        for r in tokenized_pairs(corpus).orderBy("row_id").toLocalIterator():
            s.write(r.source + "\n")
            t.write(r.target + "\n")
            n += 1
    return n


def run_aligner(spark: SparkSession, corpus: DataFrame, script: str, output: str, folder: str, threshold: float = THRESHOLD) -> DataFrame:
    """Pairs of an external aligner that takes ``--source --target --lexicon --lexicon-threshold --quiet [--bin]``."""
    source, target = os.path.join(folder, "source.txt"), os.path.join(folder, "target.txt")
    write_pairs(corpus, source, target)
    found = Path(script).resolve()
    command = [sys.executable, str(found)]
    if (found.parent / ".bin").is_dir():
        command += ["--bin", str(found.parent / ".bin")]
    Path(output).parent.mkdir(parents=True, exist_ok=True)
    subprocess.run([*command, "--source", source, "--target", target, "--lexicon", output, "--lexicon-threshold", str(threshold), "--quiet"], check=True)
    with open(output, encoding="utf-8") as f:
        lines = [(x.rstrip("\n"),) for x in f]
    return parse_pairs(spark.createDataFrame(lines, "value string"), threshold)


def pairs_from(spark: SparkSession, corpus: DataFrame, pairs_path: str | None, script: str | None, folder: str, threshold: float = THRESHOLD) -> DataFrame:
    """Pairs of a given file, else of a given aligner."""
    if pairs_path:
        return read_pairs(spark, pairs_path, threshold)
    if script:
        return run_aligner(spark, corpus, script, os.path.join(folder, "lexicon.tsv"), folder, threshold)
    raise ValueError("induction needs a file of pairs or an aligner")


def align(corpus: DataFrame, rounds: int = 5, threshold: float = THRESHOLD) -> DataFrame:
    """``source_text, target_text, score``: translation probabilities of a word-based model (IBM model 1).

    An addition for where no aligner is at hand: expectation maximisation over word pairs of sentence
    pairs, each round two aggregations.
    """
    tokens = tokenized_pairs(corpus).select("row_id", F.array_distinct(F.split(F.lower("source"), " ")).alias("s"), F.array_distinct(F.split(F.lower("target"), " ")).alias("t"))
    pairs = tokens.select("row_id", F.explode("s").alias("s"), "t").select("row_id", "s", F.explode("t").alias("t"))
    pairs = stored(pairs, "pairs")
    p = pairs.groupBy("s", "t").agg(F.lit(1.0).alias("p"))
    for _ in range(rounds):
        told = pairs.join(p, ["s", "t"])
        total = told.groupBy("row_id", "t").agg(F.sum("p").alias("total"))
        counts = told.join(total, ["row_id", "t"]).groupBy("s", "t").agg(F.sum(F.col("p") / F.col("total")).alias("c"))
        whole = counts.groupBy("s").agg(F.sum("c").alias("whole"))
        p = stored(counts.join(whole, "s").select("s", "t", (F.col("c") / F.col("whole")).alias("p")), "translation")
    return p.where(F.col("p") >= threshold).select(F.col("s").alias("source_text"), F.col("t").alias("target_text"), F.col("p").alias("score"))
