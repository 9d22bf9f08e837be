"""Running totals over rows dealt by ranges.

A window over a hot key puts all its rows into one task.  Here rows are dealt by ranges
of (keys, order), so a key with a third of all rows lies in many tasks; each task adds up
its own rows, and a key that goes on from task to task gets the totals of the tasks
before as an offset.  What the driver sees is one row a task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .lineage import cut


def _starts(keys: list[pa.Array], n: int) -> np.ndarray:
    """Where a row's keys differ from the row before's, without the first row."""
    new = np.zeros(n, dtype=bool)
    for k in keys:
        a, b = k.slice(1), k.slice(0, n - 1)
        differ = pc.fill_null(pc.not_equal(a, b), False)
        new[1:] |= np.asarray(differ.to_numpy(zero_copy_only=False), dtype=bool)
        if k.null_count:
            new[1:] |= np.asarray(pc.xor(a.is_null(), b.is_null()).to_numpy(zero_copy_only=False), dtype=bool)
    return np.flatnonzero(new)


def _key_at(keys: list[pa.Array], i: int) -> tuple:
    return tuple(k[i].as_py() for k in keys)


def dealt(df: DataFrame, keys: list[str], order: list[str], partitions: int | None = None) -> DataFrame:
    """The rows in ranges of (keys, order), sorted, with their lineage cut: read twice, they lie in the same tasks."""
    by = [*keys, *order]
    return cut((df.repartitionByRange(partitions, *by) if partitions else df.repartitionByRange(*by)).sortWithinPartitions(*by))


def running_totals(df: DataFrame, keys: list[str], order: list[str], totals: dict[str, str], partitions: int | None = None, before: dict[str, str] | None = None) -> DataFrame:
    """``df`` with running totals of long columns within each combination of ``keys``, in ``order``.

    ``totals`` maps new columns to the columns added up; a row's total has the row itself in
    it, a total of ``before`` hasn't.  Sums wrap around at 64 bits; a null counts as 0.  A null key is a key of its own;
    rows equal in keys and order come in any order; an empty table gives no rows.
    """
    rows = dealt(df, keys, order, partitions)
    before = before or {}
    values = list(dict.fromkeys([*totals.values(), *before.values()]))

    def numbers(batch: pa.RecordBatch) -> np.ndarray:
        return np.stack([pc.fill_null(batch.column(v).cast(pa.int64()), 0).to_numpy(zero_copy_only=False) for v in values])

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of a task: its first key, its last key, the totals of the last key, and whether it has but one key."""
        first = last = None
        whole, total = True, np.zeros(len(values), dtype=np.int64)
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            by = [batch.column(k) for k in keys]
            cuts = _starts(by, n)
            if first is None:
                first = last = _key_at(by, 0)
            if _key_at(by, 0) != last:
                whole, total = False, np.zeros(len(values), dtype=np.int64)
            found = numbers(batch)
            if len(cuts):
                whole, total = False, np.zeros(len(values), dtype=np.int64)
                found = found[:, cuts[-1] :]
            total = total + found.sum(axis=1, dtype=np.int64)
            last = _key_at(by, n - 1)
        if first is not None:
            yield pa.RecordBatch.from_pydict({"first": [repr(first)], "last": [repr(last)], "whole": [whole], "total": pa.array([total.tolist()], pa.list_(pa.int64()))})

    own = rows.select(*dict.fromkeys([*keys, *values]))
    found = own.mapInArrow(ends, "first string, last string, whole boolean, total array<bigint>").withColumn("task", F.spark_partition_id()).collect()
    offsets: dict[int, np.ndarray] = {}
    key, sums = None, np.zeros(len(values), dtype=np.int64)
    for r in sorted(found, key=lambda r: r["task"]):
        if r["first"] == key:
            offsets[r["task"]] = sums.copy()
        total = np.array(r["total"], dtype=np.int64)
        sums = sums + total if r["whole"] and r["first"] == key else total
        key = r["last"]
    known = rows.sparkSession.sparkContext.broadcast(offsets)
    names, at, less = [*totals, *before], [values.index(v) for v in totals.values()], [values.index(v) for v in before.values()]

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        last, sums = None, known.value.get(TaskContext.get().partitionId())
        begun = False
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            by = [batch.column(k) for k in keys]
            if sums is None or begun and _key_at(by, 0) != last:
                sums = np.zeros(len(values), dtype=np.int64)
            begun = True
            found, cuts = numbers(batch), _starts(by, n)
            upto = np.cumsum(found, axis=1, dtype=np.int64)
            earlier = np.repeat(-sums[:, None], n, axis=1)
            if len(cuts):  # what the earlier keys of the batch have added up goes
                earlier[:, cuts[0] :] = np.repeat(upto[:, cuts - 1], np.diff(np.append(cuts, n)), axis=1)
            upto = upto - earlier
            last, sums = _key_at(by, n - 1), upto[:, -1].copy()
            columns = [batch.column(c) for c in batch.schema.names] + [pa.array(upto[i]) for i in at] + [pa.array(upto[i] - found[i]) for i in less]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, *names])

    schema = StructType([*rows.schema.fields, *(StructField(c, LongType()) for c in names)])
    return rows.mapInArrow(add, schema)
