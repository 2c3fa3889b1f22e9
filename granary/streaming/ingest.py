"""Resumable loading of new files: the streaming form of the high-water mark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from granary.sources.sinks import append_new


def load_new_files(spark: SparkSession, source: str, schema: T.StructType, target: str, checkpoint: str, key: list[str], order: list[str], files_per_batch: int = 100) -> StreamingQuery:
    """Append every file of ``source`` not yet seen, in batches, rows with a known key left out; then stop.

    The checkpoint remembers the files, and a batch that is run again after a loss inserts nothing twice,
    because its keys are already there.
    """
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source)

    def write(batch: DataFrame, _: int) -> None:
        append_new(batch, target, key, order)

    return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
