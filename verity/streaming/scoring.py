"""Scoring of tables that arrive in a folder, as a stream of files. Each file is scored whole, exactly once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery


def drop_folder(spark: SparkSession, folder: str, schema, step: Callable[[DataFrame], DataFrame], out: str, state: str, available_now: bool = True) -> StreamingQuery:
    """Apply step to each new batch of files and write it under its batch number: a repeated batch replaces itself."""

    def each(batch: DataFrame, number: int) -> None:
        step(batch).write.mode("overwrite").parquet(f"{out}/batch={number}")

    writer = spark.readStream.schema(schema).parquet(folder).writeStream.foreachBatch(each).option("checkpointLocation", state)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
