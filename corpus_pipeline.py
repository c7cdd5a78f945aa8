"""A training corpus from raw documents: toxicity, near duplicates, benchmark leaks, personal data, mix.

Counted as part of kinweave.llm. Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all
but the last return the columns of ``documents``. A stage's result is written as Parquet and read
again as the next one's documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinweave.llm import minhash, mixing, pii, tiling, toxicity
from kinweave.llm.common import dropped, stored, table


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows predicted toxic go; the score of a null or empty text is that of a text without words.
    Repeated rows go or stay together. Empty documents or labels are no error."""
    return toxicity.accepted(docs, table(spark, sf_dir, "labels"))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: the one with the smallest doc_id. Null and empty texts are no
    duplicates of each other; of rows that repeat a doc_id one stays, rows without one all stay."""
    return minhash.representatives(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that leak a benchmark item go. Null and empty texts stay, repeated rows go or stay together."""
    return tiling.clean(docs, table(spark, sf_dir, "benchmark"))


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in texts is replaced by its kind; n_chars follows the text. A null text stays null;
    no row goes."""
    done = pii.redacted(docs)
    return done.withColumn("n_chars", F.length("text").cast("long")).select(docs.columns) if "n_chars" in docs.columns else done


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: a row for each document that it takes, with its text and how many times it is sent. Ties
    of finish times are ordered by source, hash, id and size; documents without words are never taken."""
    mixed = mixing.mix(docs, carry=("text", "lang", "source"))
    return mixed.where("sendings > 0").select("doc_id", "text", "lang", "source", "size", "source_size", "target", "taken", "sendings", "first_finish")


STAGES = [
    ("toxicity", toxicity_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("pii", pii_stage),
    ("mixing", mixing_stage),
]

#: Fitted models and similarity components can't be written in SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what passes between them is written to the shared folder, and goes
    when the next stage has been written (the last one is read by the caller)."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs, path = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if before:
            dropped(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
