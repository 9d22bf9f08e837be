"""Exact nearest vectors without reading all of them.

Rows lie in *cells* around centroids, which are fitted on a bounded sample; every row is
in the cell of its nearest centroid, and a cell knows its radius, the largest distance of a
row from the centroid.  So no row of a cell has a dot product with q above
q . centroid + |q| * radius.  A search reads the most promising cells of each query first;
the k-th best found there is a floor, and cells whose bound lies below it are never read.
The result is that of reading everything; how much is read depends on how far the
vectors cluster.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import BLOCK, NEAR, SLICE, _matrix, best_rows, keep_best, kinds_of, placed
from .lineage import cut

#: Rows that centroids are fitted on (those with the smallest hashes of their keys), and rounds of it.
SAMPLE, ROUNDS = 20_000, 15
#: Rows of a cell that are aimed at, and the most cells.
CELL_ROWS, MOST_CELLS = 64, 4096
#: Cells that are read first, at least.
FIRST = 2
#: Distances that are held at once.
AT_ONCE = 1 << 20


@dataclass
class Cells:
    """Rows (cell, key, v) and, by cell, centroid, radius and number of rows."""

    rows: DataFrame = field(repr=False)
    centroids: np.ndarray = field(repr=False)
    radius: np.ndarray = field(repr=False)
    count: np.ndarray = field(repr=False)


@dataclass
class Read:
    """Pairs of a query and a cell, and those that were compared."""

    pairs: int = 0
    read: int = 0


def means(x: np.ndarray, cells: int, rounds: int = ROUNDS, seed: int = 1) -> np.ndarray:
    """Centroids of rows by Lloyd's rounds from seeded rows; empty cells keep their centroid."""
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), min(cells, len(x)), replace=False)].astype(np.float64)
    for _ in range(rounds):
        near = nearest_centroid(x, c)
        n = np.bincount(near, minlength=len(c))
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        c = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], c)
    return c


def nearest_centroid(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Slices of rows, so that the table of distances has one size however many cells there are."""
    norm, near = (c**2).sum(axis=1), np.empty(len(x), dtype=np.int64)
    step = max(1, AT_ONCE // max(1, len(c)))
    for at in range(0, len(x), step):
        near[at : at + step] = (norm - 2 * (x[at : at + step].astype(np.float64) @ c.T)).argmin(axis=1)
    return near


def build(rows: DataFrame, key: str, vector: str, *, cells: int | None = None, sample: int = SAMPLE) -> Cells:
    """Deal all vectors to cells.  They must be of one length; rows without a vector are left out."""
    spark = rows.sparkSession
    source = rows.select(F.col(key).alias("key"), F.col(vector).alias("v")).where("v is not null")
    about = source.agg(F.count("*").alias("n"), F.min(F.size("v")).alias("a"), F.max(F.size("v")).alias("b")).first()
    if about["a"] != about["b"]:
        raise ValueError(f"vectors of {about['a']} and of {about['b']} numbers")
    kind = dict(source.dtypes)["key"]
    if not about["n"]:
        return Cells(source.select(F.lit(0).alias("cell"), "key", "v"), np.zeros((0, 0)), np.zeros(0), np.zeros(0, dtype=np.int64))
    few = source.orderBy(F.xxhash64("key"), "key").limit(sample).select("v").collect()
    x = np.array([r["v"] for r in few], dtype=np.float32)
    sent = spark.sparkContext.broadcast(means(x, cells or int(min(MOST_CELLS, max(1, about["n"] // CELL_ROWS)))))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = sent.value
        for batch in batches:
            if batch.num_rows:
                m = _matrix(batch.column("v"), c.shape[1])
                near = nearest_centroid(m, c)
                far = np.sqrt(((m - c[near]) ** 2).sum(axis=1))
                yield pa.RecordBatch.from_arrays([pa.array(near.astype(np.int32)), batch.column("key"), batch.column("v"), pa.array(far)], names=["cell", "key", "v", "far"])

    # by cell, so that a cell is few row groups; a large one may be dealt to several tasks
    dealt = cut(source.mapInArrow(deal, f"cell int, key {kind}, v array<float>, far double").repartitionByRange("cell", F.xxhash64("key")).sortWithinPartitions("cell"))
    c = sent.value
    radius, count = np.zeros(len(c)), np.zeros(len(c), dtype=np.int64)
    for r in dealt.groupBy("cell").agg(F.max("far").alias("far"), F.count("*").alias("n")).collect():  # a row a cell
        radius[r["cell"]], count[r["cell"]] = r["far"], r["n"]
    return Cells(dealt.drop("far"), c, radius, count)


def search(index: Cells, queries: DataFrame, *, query: str, vector: str, k: int = 100, digits: int = 9, least: float | None = None, block: int = BLOCK) -> tuple[DataFrame, Read]:
    """(query, key, similarity, place) as :func:`.blocks.nearest` gives them, and what was compared for it."""
    spark = queries.sparkSession
    kinds = kinds_of(queries, query, index.rows, "key")
    schema = f"query {kinds[0]}, key {kinds[1]}, similarity double"
    read = Read()
    found = spark.createDataFrame([], schema)
    size = index.centroids.shape[1]
    asked = queries.select(F.col(query).alias("query"), F.col(vector).alias("v")).where((F.size("v") == size) & (size > 0))
    parts = max(1, -(-asked.count() // block))
    asked = asked.withColumn("part", F.pmod(F.xxhash64("query"), F.lit(parts)))

    def compare(names: list, matrix: np.ndarray, wanted: np.ndarray) -> DataFrame:
        """The best of the pairs of queries and cells that are wanted."""
        cells = np.flatnonzero(wanted.any(axis=0)).tolist()
        sent = spark.sparkContext.broadcast((names, matrix, np.packbits(wanted.T, axis=1)))  # a bit a pair

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            names, matrix, bits = sent.value
            best: dict = {}
            for batch in batches:
                cell = batch.column("cell").to_numpy(zero_copy_only=False)
                for c in np.unique(cell).tolist():
                    own = batch.take(pa.array(np.flatnonzero(cell == c)))
                    some = np.flatnonzero(np.unpackbits(bits[c], count=len(names)))
                    for at in range(0, own.num_rows, SLICE):
                        part = own.slice(at, SLICE)
                        keep_best(best, [names[i] for i in some], matrix[some], _matrix(part.column("v"), size), part.column("key").to_numpy(zero_copy_only=False), k, digits, least)
            yield from best_rows(best, kinds)

        return index.rows.where(F.col("cell").isin(cells)).mapInArrow(run, schema)

    for part in range(parts):
        those = asked.where(F.col("part") == part).collect()  # about ``block`` queries
        if not those:
            continue
        names, matrix = [r["query"] for r in those], np.array([r["v"] for r in those], dtype=np.float32)
        q = matrix.astype(np.float64)
        bound = q @ index.centroids.T + np.sqrt((q**2).sum(axis=1))[:, None] * index.radius[None, :] + NEAR
        bound[:, index.count == 0] = -np.inf
        order = np.argsort(-bound, axis=1, kind="stable")
        seen = np.cumsum(index.count[order], axis=1)
        lead = np.zeros(bound.shape, dtype=bool)
        np.put_along_axis(lead, order, (seen - index.count[order] < k) | (np.arange(bound.shape[1]) < FIRST)[None, :], axis=1)
        lead &= bound > -np.inf
        first = placed(compare(names, matrix, lead), k, digits, least)
        floors = {r["query"]: r["worst"] for r in first.groupBy("query").agg(F.count("*").alias("n"), F.min("similarity").alias("worst")).where(F.col("n") == k).collect()}
        floor = np.array([floors.get(n, -np.inf if least is None else least) for n in names])
        wanted = bound >= floor[:, None] - NEAR
        read.pairs += bound.shape[0] * int((index.count > 0).sum())
        read.read += int((wanted | lead).sum())
        found = found.unionByName(compare(names, matrix, wanted))
    return placed(found, k, digits, least), read
