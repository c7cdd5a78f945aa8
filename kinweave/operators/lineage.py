"""Cutting lineage by way of the folder that all nodes share."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def written(df: DataFrame) -> DataFrame:
    """``df`` from the session's spark.checkpoint.dir (a temporary folder only where none is set, as in
    tests): computed once however often it is read, and safe from lost executors."""
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
        if not named and not (sc.master == "local" or sc.master.startswith("local[")):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all nodes share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="kinweave-checkpoint-"))
    return df.checkpoint(eager=True)
