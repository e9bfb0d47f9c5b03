"""Batch operators over files that keep arriving."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery


def run_increments(spark: SparkSession, folder: str, schema: str, step: Callable[[DataFrame], DataFrame], out: str, checkpoint: str) -> StreamingQuery:
    """Apply ``step`` to each increment of new parquet files and append its rows to ``out``, a folder per increment.

    A repeated increment overwrites its own folder, so each row is written once. For steps whose results can be
    combined later, such as sketches and partial counts.
    """

    def write(batch: DataFrame, epoch: int) -> None:
        step(batch).write.mode("overwrite").parquet(f"{out}/increment={epoch}")

    stream = spark.readStream.schema(schema).parquet(folder)
    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
