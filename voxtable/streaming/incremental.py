"""New scans as they arrive: a stream over a catalog folder, processed by the batch operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.query import StreamingQuery


def process_new(spark: SparkSession, source: str, schema: str, process: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Run ``process`` on all files not seen before, then stop; the checkpoint remembers what was seen."""
    stream = spark.readStream.schema(schema).parquet(source)
    return stream.writeStream.foreachBatch(process).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
