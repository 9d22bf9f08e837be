"""Searches of a stated set of queries against all rows, in blocks of queries.

Every query sees every row; what grows is the number of passes, never what a task or the
driver holds: a block's queries are broadcast, a task keeps the best rows of each, and
those few are merged by query.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .lineage import cut

#: Queries of a block, and rows that a task compares with it at once.
BLOCK, SLICE = 2048, 4096


#: How far a sum of products in another precision may be off; what is so near to the k-th is compared exactly.
NEAR = 1e-5


def _best(scores: np.ndarray, keys: np.ndarray, k: int, digits: int) -> np.ndarray:
    """Places of the k best by descending rounded score, then key."""
    return np.lexsort((keys, -np.round(scores, digits)))[:k]


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    return np.asarray(column.flatten(), dtype=np.float32).reshape(-1, size)


def keep_best(best: dict, names: list, matrix: np.ndarray, x: np.ndarray, keys: np.ndarray, k: int, digits: int, least: float | None = None) -> None:
    """Among ``best`` (query to sums and keys) and the rows ``x``, the ``k`` best of each query stay.

    One matrix product tells which rows can be among them; only these are multiplied as single rows are."""
    about = matrix.astype(np.float64) @ x.T.astype(np.float64)
    for i, q in enumerate(names):
        old = best.get(q)
        floor = -np.inf if least is None else least - NEAR
        if len(keys) > k:
            floor = max(floor, np.partition(about[i], len(keys) - k)[len(keys) - k] - NEAR)
        if old is not None and len(old[0]) == k:
            floor = max(floor, old[0][-1] - NEAR)
        few = np.flatnonzero(about[i] >= floor)
        if not len(few):
            continue
        exact = (x[few] * matrix[i]).astype(np.float64).sum(axis=1)
        s, c = (exact, keys[few]) if old is None else (np.r_[old[0], exact], np.r_[old[1], keys[few]])
        chosen = _best(s, c, k, digits)
        best[q] = s[chosen], c[chosen]


_ARROW = {"int": pa.int32(), "bigint": pa.int64(), "string": pa.string()}


def best_rows(best: dict, kinds: list[str]) -> Iterator[pa.RecordBatch]:
    """What :func:`keep_best` has kept, as rows (query, key, similarity)."""
    for q, (s, c) in best.items():
        yield pa.RecordBatch.from_arrays([pa.array([q] * len(s), _ARROW[kinds[0]]), pa.array(c, _ARROW[kinds[1]]), pa.array(s)], names=["query", "key", "similarity"])


def placed(found: DataFrame, k: int, digits: int, least: float | None) -> DataFrame:
    """The best of all tasks by query, with their place."""
    if least is not None:
        found = found.where(F.round("similarity", digits) >= least)
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc(F.round("similarity", digits)), "key"))
    return found.withColumn("place", place).where(F.col("place") <= k)


def kinds_of(queries: DataFrame, query: str, rows: DataFrame, key: str) -> list[str]:
    """Types of the two names, which must be numbers or strings."""
    kinds = [dict(queries.dtypes)[query], dict(rows.dtypes)[key]]
    if unknown := set(kinds) - set(_ARROW):
        raise ValueError(f"keys must be of the types {', '.join(_ARROW)}, not {', '.join(sorted(unknown))}")
    return kinds


def nearest(rows: DataFrame, queries: DataFrame, *, key: str, vector: str, query: str | None = None, k: int = 100, digits: int = 9, least: float | None = None, block: int = BLOCK) -> DataFrame:
    """(query, key, similarity, place): for each query the ``k`` rows with the highest dot product
    (of ``least`` at least), ties by key.  Vectors of another length than the query's are no match."""
    spark = rows.sparkSession
    name = query or key
    kinds = kinds_of(queries, name, rows, key)
    count = queries.count()
    parts = max(1, -(-count // block))
    asked = queries.select(F.col(name).alias("query"), F.col(vector).alias("v")).where("v is not null").withColumn("part", F.pmod(F.xxhash64("query"), F.lit(parts)))
    source = rows.select(F.col(key).alias("key"), F.col(vector).alias("v"), F.size(vector).alias("size")).where("v is not null")
    out = None
    for part in range(parts):
        # about ``block`` queries, dealt by hash
        sent = spark.sparkContext.broadcast([(r["query"], r["v"]) for r in asked.where(F.col("part") == part).collect()])

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            by_size: dict[int, tuple[list, np.ndarray]] = {}
            for n in {len(v) for _, v in sent.value}:
                own = [(q, v) for q, v in sent.value if len(v) == n]
                by_size[n] = [q for q, _ in own], np.array([v for _, v in own], dtype=np.float32)
            best: dict = {}
            for batch in batches:
                sizes = batch.column("size").to_numpy(zero_copy_only=False)
                for n, (names, matrix) in by_size.items():
                    own = batch.take(pa.array(np.flatnonzero(sizes == n)))
                    for at in range(0, own.num_rows, SLICE):
                        some = own.slice(at, SLICE)
                        keep_best(best, names, matrix, _matrix(some.column("v"), n), some.column("key").to_numpy(zero_copy_only=False), k, digits, least)
            yield from best_rows(best, kinds)

        found = source.mapInArrow(run, f"query {kinds[0]}, key {kinds[1]}, similarity double")
        out = found if out is None else out.unionByName(found)
    return placed(out, k, digits, least)


#: Rows of the sample from which a query's floor comes.
SAMPLE_ROWS = 4096
#: Trigrams of all queries that are broadcast; more are joined by a shuffle.
MOST_GRAMS = 200_000


def similar_texts(rows: DataFrame, queries: DataFrame, *, key: str, grams: str = "grams", k: int = 100, least: float = 0.25, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """(query, key, similarity, place): for each query the ``k`` rows that hold most of its trigrams,
    at least the share ``least``, ties by key.

    A prefix filter over trigrams from the rarest to the commonest: a row that holds t of a query's
    n trigrams has one of its n - t + 1 rarest.  How many the k-th best must hold at least, a sample
    of rows tells (k of its rows are a floor for all); the higher the floor, the fewer trigrams are
    asked for, and the common ones, which most rows have, aren't.  Rows found are verified by their
    whole sets."""
    held = cut(rows.select(F.col(key).alias("key"), F.col(grams).alias("grams")))
    asked = cut(queries.select(F.col(key).alias("query"), F.col(grams).alias("asked"), F.size(grams).alias("n")).where("n > 0"))
    terms = cut(asked.select("query", F.explode("asked").alias("gram")))
    known = terms.select("gram").distinct()
    few = known.count() <= MOST_GRAMS
    bound = lambda df: F.broadcast(df) if few else df
    one = lambda df: df.select("key", F.explode("grams").alias("gram"))
    counts = one(held).join(bound(known), "gram", "left_semi").groupBy("gram").agg(F.count("*").alias("df"))
    # a query's trigrams from the rarest on; those that no row has come first
    ordered = terms.join(counts, "gram", "left").groupBy("query").agg(F.sort_array(F.collect_list(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "gram"))).alias("ordered"))
    parts = max(1, held.count() // sample_rows)
    sample = held.where(F.pmod(F.xxhash64("key"), F.lit(parts)) == 0)
    shared = one(sample).join(terms, "gram").groupBy("query", "key").agg(F.count("*").alias("shared"))
    nth = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("shared")))
    floor = shared.withColumn("nth", nth).where(F.col("nth") == k).select("query", F.col("shared").alias("floor"))
    # similarities are compared to nine digits, so a share may fall short by half of the last one
    share = F.ceil(F.col("n") * (least - 5e-10)).cast("bigint")
    wanted = asked.join(ordered, "query").join(floor, "query", "left")
    wanted = wanted.withColumn("prefix", F.slice("ordered", F.lit(1), (F.col("n") - F.greatest(F.lit(1), share, F.coalesce("floor", F.lit(0))) + 1).cast("int")))
    probes = cut(wanted.select("query", F.explode("prefix.gram").alias("gram")))
    found = one(held).join(bound(probes), "gram").select("query", "key").distinct()
    both = found.join(held, "key").join(asked, "query").withColumn("similarity", F.round(F.size(F.array_intersect("grams", "asked")) / F.col("n"), 9))
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("similarity"), "key"))
    return both.where(F.col("similarity") >= least).withColumn("place", place).where(F.col("place") <= k).select("query", "key", "similarity", "place")
