"""Incremental runs: a folder of documents as a stream, each file processed once, results committed with the checkpoint."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery


def process_new(spark: SparkSession, source: str, schema: str, transform: Callable[[DataFrame], DataFrame], sink: str, checkpoint: str) -> StreamingQuery:
    """Applies transform to the Parquet files of source that no earlier run has committed, appends to sink, and ends. A failed run leaves nothing that counts as done."""

    def write(batch: DataFrame, number: int) -> None:
        # a batch that is run again overwrites its own folder
        transform(batch).write.mode("overwrite").parquet(f"{sink}/batch={number}")

    rows = spark.readStream.schema(schema).parquet(source)
    return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
