"""A streaming linker: arriving records against a static index of masters."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators.blocking import candidates
from ..operators.decide import one_owner


def link_stream(records: DataFrame, masters: DataFrame, path: str, checkpoint: str, floor: float = 0.3):
    """Starts a query that writes each micro-batch's best link per record to ``path``."""

    def batch(df: DataFrame, number: int) -> None:
        found = candidates(masters, df.dropDuplicates(["oth_id"])).withColumnRenamed("blk_sim", "p")
        one_owner(found.where(f"p >= {floor}")).write.mode("append").parquet(path)

    return records.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).start()
