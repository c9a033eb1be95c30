"""From raw documents to tokens: five stages, each working on all that the one before kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from demosift.llm import mixing, near_dedup, registry, secrets, sentencepiece_codec, toxicity
from demosift.llm.common import stored, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the conditional random field scores below one half."""
    return toxicity.drop_toxic(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one with the smallest id: five-word shingles alike by 0.8.

    Null and wordless texts are copies of each other; rows without id stay; repeated rows count once.
    """
    return near_dedup.near_dedup(docs)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets replaced by a mark; the stored length follows the text."""
    found = secrets.redact(docs)
    changed = F.when(F.col("text").contains(secrets.MARK), F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return found.withColumn("n_chars", changed) if "n_chars" in docs.columns else found


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target takes it: whole epochs, then a sample by quality."""
    # numbered and stored first: ids can be null or repeated
    rows = stored(docs.select(F.monotonically_increasing_id().alias("n"), F.struct(*[F.col(c) for c in docs.columns]).alias("row")), "numbered")
    taken = mixing.mix(rows.select("n", "row.doc_id", "row.text", "row.source"), row_col="n").where("copies > 0").select("n", "copies")
    found = rows.join(taken, "n").select(F.explode(F.array_repeat("row", F.col("copies").cast("int"))).alias("row"))
    return found.select("row.*")


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every text and their source offsets, and digests of these and of the decoded text."""
    return sentencepiece_codec.encode_digests(docs, registry.tokenizer_model(), arrays=True)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_copies),
    ("secret_scans", redact_secrets),
    ("mixing", mix_sources),
    ("sentencepiece", tokenize),
]

#: Scores of a trained model and XXH64 fingerprints have no SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
