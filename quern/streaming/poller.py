"""Repeated indexing as a stream of micro-batches.

Logs grow in place, and a file source hands each path over once only, so change
detection stays with the version tokens of the indexer; the stream is just the
clock that starts it, with a checkpoint that survives restarts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import SparkSession
from pyspark.sql.streaming import StreamingQuery


def poll(spark: SparkSession, index: Callable[[], object], checkpoint: str, every: str = "15 minutes") -> StreamingQuery:
    """Run ``index`` at each trigger; a failed run is tried again with the next."""
    ticks = spark.readStream.format("rate").option("rowsPerSecond", 1).load()
    return ticks.writeStream.foreachBatch(lambda _, __: index()).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()
