"""Record-linkage views over the test tables: masters, noisy copies and the truth."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _described(df: DataFrame) -> DataFrame:
    # 18 words are wanted: with a blank piece in front and the rest of the text as the last, 20 pieces hold them
    w = df.withColumn("w", F.filter(F.split(F.lower("text"), r"\s+", 20), lambda x: x != ""))
    w = w.withColumn("name", F.array_join(F.slice("w", 1, 6), " ")).withColumn("address", F.array_join(F.slice("w", 7, 12), " "))
    return w.withColumn("state", F.substring("name", 1, 1)).drop("w")


def masters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """s1_id, name, address, country, state: of each distinct text the document with the lowest id."""
    # texts are told apart by their digests: what is kept of a text goes through the exchange, not the text
    d = _described(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang", "text", F.sha2("text", 256).alias("digest")))
    d = d.groupBy("digest").agg(F.min(F.struct("doc_id", "lang", "name", "address", "state")).alias("d"))
    return d.select(F.concat(F.lit("S1-"), F.col("d.doc_id").cast("string")).alias("s1_id"), "d.name", "d.address", F.col("d.lang").alias("country"), "d.state")


def others(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``copies`` of the test tables' masters."""
    return copies(masters(spark, sf_dir))


def copies(known: DataFrame) -> DataFrame:
    """oth_id, src, name, address, country, state, true_s1: perturbed copies of two of three masters. Every
    rule depends on the id alone: a letter lost, the address blank or joined words."""
    m = known.withColumn("k", F.substring("s1_id", 4, 20).cast("long")).where("k % 3 < 2")
    name = F.when(F.col("k") % 4 == 0, F.concat(F.substring("name", 1, 3), F.expr("substring(name, 5)"))).when(F.col("k") % 4 == 1, F.concat("name", F.lit(" ltd"))).otherwise(F.col("name"))
    address = F.when(F.col("k") % 5 == 0, F.lit("")).otherwise(F.col("address"))
    src = (F.lit(2) + F.col("k") % 2).cast("int")
    return m.select(F.concat(F.lit("S"), src.cast("string"), F.lit("-"), F.col("k").cast("string")).alias("oth_id"), src.alias("src"), name.alias("name"), address.alias("address"), "country", F.when(F.col("k") % 7 == 0, "").otherwise(F.col("state")).alias("state"), F.col("s1_id").alias("true_s1"))
