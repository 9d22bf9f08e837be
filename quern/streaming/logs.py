"""Changed sources as a stream of its own, and an index that follows it.

The offset of the stream is what is there: of each harness its sources with their
versions.  A batch is what two offsets differ in, so a log that grows in place is a change,
and a source that goes is one, too.  Spark writes the offsets to the checkpoint before a
batch is run; the index keeps the number of the batch in the manifest that has its rows.
A batch that is run again after a crash between the two is known by it and left alone.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.streaming import StreamingQuery

from ..plans.engine import Engine
from ..sources import adapters

FORMAT = "quern_logs"
CHANGES = "harness string, source_key string, path string, version string, status string"
#: Changes of a partition.
SOME = 1000


@dataclass
class Changes(InputPartition):
    rows: list[tuple]


class LogReader(DataSourceStreamReader):
    def __init__(self, roots: dict[str, str]):
        self.roots = roots

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        """harness -> source -> path and version; a harness that can't be listed is left out."""
        found: dict = {}
        for harness, root in self.roots.items():
            try:
                found[harness] = {s["source_key"]: {"path": s["path"], "version": s["version"]} for s in adapters.discover(harness, root)}
            except (OSError, ValueError):
                continue
        return found

    def partitions(self, start: dict, end: dict) -> list[Changes]:
        rows: list[tuple] = []
        for harness, now in end.items():
            old = start.get(harness, {})
            rows += [(harness, k, s["path"], s["version"], "changed" if k in old else "new") for k, s in now.items() if old.get(k, {}).get("version") != s["version"]]
            rows += [(harness, k, s["path"], s["version"], "missing") for k, s in old.items() if k not in now]
        return [Changes(rows[at : at + SOME]) for at in range(0, len(rows), SOME)]

    def read(self, partition: Changes) -> Iterator[tuple]:
        yield from partition.rows

    def commit(self, end: dict) -> None:
        """Nothing is held back until here."""


class LogSource(DataSource):
    """``spark.readStream.format("quern_logs")`` with the option ``roots``, a JSON object of harness and place."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return CHANGES

    def streamReader(self, schema) -> LogReader:
        return LogReader(json.loads(self.options["roots"]))


def follow(engine: Engine, checkpoint: str, every: str = "15 minutes") -> StreamingQuery:
    """Index whenever sources change; each batch is committed once, whatever is killed when."""
    spark = engine.spark
    spark.dataSource.register(LogSource)
    changes = spark.readStream.format(FORMAT).option("roots", json.dumps(engine.roots()[0])).load()

    def index(_, number: int) -> None:
        engine.index_batch(f"{spark.sparkContext.getLocalProperty('sql.streaming.queryId')}:{number}")

    return changes.writeStream.foreachBatch(index).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()
