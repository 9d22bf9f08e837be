"""SimHash near-dedup with a segment-popcount embedding.

Fingerprint: words are runs of non-white-space (A-Z lower-cased), shingles four
words joined by a space, repeats included; a bit is set if more than half of the
shingles' XXH64 hashes (seed 42) have it.

Candidates: a fingerprint's 64 bits are 32 segments of two bits, and the vector
of the segments' bit counts (0, 1 or 2 each) embeds it in a grid.  The Manhattan
distance of two vectors is a lower bound of the Hamming distance.  The vector
has two halves of 16 coordinates, and at a Hamming distance of 4 or less one of
the halves is within Manhattan distance 2.  Such points have a common grid point
within distance 1 of both, so every fingerprint is put in its own cell and in
the cells one step away, for each half, and only cell mates are compared, by the
exact distance.  A cell is one of 3**16 points, so cells stay small: some 50
entries a fingerprint, and no pairs are written, only a spanning forest of each
cell's links.

Equal fingerprints are one entry from the start, so copies cost nothing.  A cell
that may hold over ``cell_limit`` entries (found on a sample of the fingerprints;
a cell that the sample misses is still compared in full, just by one task) is
dealt to blocks, and every pair of blocks is compared by its own group.  The
crowded cells are a table that is joined, broadcast while it is small.

The embedding proves links of up to five differing bits; a larger ``distance`` is
an error, not a loss.

Defined results: a null text or one without words has fingerprint zero, linked
like any other; fewer than four words are one shingle; null ids take part, and
are never the smallest id unless the whole group has none; repeated rows are in
one component; an empty table gives no rows; texts are read whole; other
columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, cut, map_batches
from .components import components

SHINGLE = 4
DISTANCE = 4
SEED = 42
CELL_LIMIT = 50_000
SAMPLE = 64
#: Differing bits up to which one half is within Manhattan distance 2.
MOST_DISTANCE = 5
#: Crowded cells that are broadcast, 16 bytes each; more are joined by a shuffle.
MOST_CELLS = 500_000
_POW3 = 3 ** np.arange(16, dtype=np.int64)


def fingerprint(raw: bytes, k: int = SHINGLE) -> int:
    """The 64-bit fingerprint of a UTF-8 text."""
    words = raw.lower().split()
    n = len(words)
    if not n:
        return 0
    joined = b" ".join(words)
    if n <= k:
        return xxhash.xxh64_intdigest(joined, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=n) + 1)
    starts = np.r_[0, ends[: n - k]].tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter([digest(joined[a:b], SEED) for a, b in zip(starts, (ends[k - 1 :] - 1).tolist(), strict=True)], dtype="<u8", count=n - k + 1)
    ones = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", k: int = SHINGLE, extra: tuple = ()) -> DataFrame:
    """(doc_id, fp, and the long columns ``extra``), fp as a signed long."""
    names = [c for c, _ in extra]

    def make():
        def fn(batch: pa.RecordBatch) -> pa.RecordBatch:
            fp = np.fromiter((fingerprint(t, k) for t in as_bytes(batch.column(1))), dtype=np.uint64, count=batch.num_rows)
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp.view(np.int64)), *batch.columns[2:]], names=["doc_id", "fp", *names])

        return fn

    source = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), text_col, *[c.alias(n) for n, c in extra])
    return map_batches(source, make, ", ".join(["doc_id bigint", "fp bigint", *[f"{n} bigint" for n in names]]))


def digits(fp: np.ndarray) -> np.ndarray:
    """Bit counts of the 32 two-bit segments, one row a fingerprint."""
    two = (fp[:, None] >> (2 * np.arange(32, dtype=np.uint64))) & np.uint64(3)
    return np.bitwise_count(two).astype(np.int64)


def cells_of(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, cell): the cells of every fingerprint; the second half's have a flag bit."""
    rows, cells = [], []
    d = digits(fp)
    every = np.arange(len(fp))
    for half in (0, 1):
        x = d[:, 16 * half : 16 * half + 16]
        code = x @ _POW3 + (half << 40)
        rows.append(every)
        cells.append(code)
        for step in (1, -1):
            r, c = np.nonzero((x + step >= 0) & (x + step <= 2))
            rows.append(r)
            cells.append(code[r] + step * _POW3[c])
    return np.concatenate(rows), np.concatenate(cells)


def roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest (node, root) of the edges a-b, the root being the least node."""
    nodes, flat = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = flat[: len(a)], flat[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, label[x], low)
        np.minimum.at(new, label[y], low)
        while (new != new[new]).any():
            new = new[new]
        if (new == label).all():
            break
        label = new
    other = label != np.arange(len(nodes))
    return nodes[other], nodes[label[other]]


def forest(fp: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of a large cell: search from each entry among those not yet reached."""
    a, b = [], []
    left = fp
    while len(left):
        start, left = left[:1], left[1:]
        edge = [start]
        while edge and len(left):
            group = edge.pop()
            for q in group:
                near = np.bitwise_count(left ^ q) <= distance
                if near.any():
                    new = left[near]
                    a.append(new)
                    b.append(np.full(len(new), start[0], dtype=np.uint64))
                    edge.append(new)
                    left = left[~near]
                    if not len(left):
                        break
    none = np.zeros(0, dtype=np.uint64)
    return (np.concatenate(a), np.concatenate(b)) if a else (none, none)


def links_of_runs(cell: np.ndarray, fp: np.ndarray, distance: int, large: int = 128) -> tuple[np.ndarray, np.ndarray]:
    """A forest of the links within runs of equal cells."""
    edge = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1], True])
    length = np.diff(edge)
    a, b = [], []
    for i in np.flatnonzero(length > large):
        x, y = forest(fp[edge[i] : edge[i + 1]], distance)
        a.append(x)
        b.append(y)
    end = np.repeat(edge[1:], length)
    at = np.flatnonzero(np.repeat((length > 1) & (length <= large), length))
    k = 1
    while len(at := at[end[at] > at + k]):
        x, y = fp[at], fp[at + k]
        near = np.bitwise_count(x ^ y) <= distance
        a.append(x[near])
        b.append(y[near])
        k += 1
    if not a:
        none = np.zeros(0, dtype=np.uint64)
        return none, none
    return roots(np.concatenate(a), np.concatenate(b))


def entries(fps: DataFrame) -> DataFrame:
    """(cell, fp): the cells of distinct fingerprints (fp)."""

    def make():
        def fn(batch: pa.RecordBatch) -> pa.RecordBatch:
            fp = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            row, cell = cells_of(fp)
            return pa.RecordBatch.from_arrays([pa.array(cell), pa.array(fp[row].view(np.int64))], names=["cell", "fp"])

        return fn

    return map_batches(fps.select("fp"), make, "cell bigint, fp bigint")


def crowded_cells(fps: DataFrame, cell_limit: int, sample: int) -> DataFrame | None:
    """(cell, blocks) of the cells that may hold over ``cell_limit`` entries, or None."""
    if fps.count() <= cell_limit:  # no cell can
        return None
    few = entries(fps.where(F.pmod(F.xxhash64("fp"), F.lit(sample)) == 0))
    over = few.groupBy("cell").agg(F.count("*").alias("n")).where(F.col("n") * sample > cell_limit)
    cells = cut(over.select("cell", F.ceil(2 * F.col("n") * sample / F.lit(cell_limit)).cast("bigint").alias("blocks")))
    found = cells.count()
    return None if not found else F.broadcast(cells) if found <= MOST_CELLS else cells


def dealt_entries(fps: DataFrame, crowded: DataFrame | None) -> DataFrame:
    """(cell, pair, fp): an entry of a crowded cell goes to every pair that its block is in."""
    made = entries(fps)
    if crowded is None:
        return made.select("cell", F.lit(0).cast("bigint").alias("pair"), "fp")
    made = made.join(crowded, "cell", "left").withColumn("own", F.expr("pmod(xxhash64(fp, 7), blocks)"))
    pairs = F.expr("if(blocks is null, array(0L), transform(sequence(0L, blocks - 1), j -> least(own, j) * blocks + greatest(own, j)))")
    return made.select("cell", F.explode(pairs).alias("pair"), "fp")


def links(fps: DataFrame, *, distance: int = DISTANCE, cell_limit: int = CELL_LIMIT, sample: int = SAMPLE) -> DataFrame:
    """(u, v): a spanning forest of all links between distinct fingerprints (fp)."""
    if not 0 <= distance <= MOST_DISTANCE:
        raise ValueError(f"distance must be 0 to {MOST_DISTANCE}: beyond, cells don't hold all links")
    crowded = crowded_cells(fps, cell_limit, sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(parts: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
            cell, pair, fp = (np.concatenate(x) for x in zip(*parts, strict=True))
            u, v = links_of_runs(np.cumsum(np.r_[False, (cell[1:] != cell[:-1]) | (pair[1:] != pair[:-1])]), fp, distance)
            return pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], names=["u", "v"])

        held: list[tuple[np.ndarray, ...]] = []  # the run that may go on in the next batch

        for batch in batches:
            cell, pair, fp = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            fp = fp.view(np.uint64)
            last = int(np.flatnonzero((cell == cell[-1]) & (pair == pair[-1]))[0])  # sorted: where the last run begins
            if not last and held and held[0][0][0] == cell[0] and held[0][1][0] == pair[0]:
                held.append((cell, pair, fp))
                continue
            done = [*held, (cell[:last], pair[:last], fp[:last])]
            if any(len(x[0]) for x in done):
                yield out(done)
            held = [(cell[last:], pair[last:], fp[last:])]
        if held:
            yield out(held)

    dealt = dealt_entries(fps, crowded).repartition("cell", "pair").sortWithinPartitions("cell", "pair")
    return dealt.mapInArrow(run, "u bigint, v bigint")


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", k: int = SHINGLE, distance: int = DISTANCE, cell_limit: int = CELL_LIMIT, extra: tuple = ()) -> DataFrame:
    """doc_id, fp, root (a fingerprint that names the component), component_id, and ``extra``."""
    made = cut(fingerprints(docs, id_col=id_col, text_col=text_col, k=k, extra=extra))
    classes = cut(made.groupBy("fp").agg(F.min("doc_id").alias("low")))
    found = components(links(classes, distance=distance, cell_limit=cell_limit))
    named = classes.join(found, classes["fp"] == found["node"], "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    smallest = named.groupBy("root").agg(F.min("low").alias("component_id"))
    # as in components(): both sides are shuffled for the join, so a large group can be split
    smallest = smallest.select(F.expr("root ^ 0L").alias("of"), "component_id")
    named = named.join(smallest, F.col("root") == F.col("of")).select("fp", "root", "component_id")
    return made.join(named, "fp").select("doc_id", "fp", "root", "component_id", *[n for n, _ in extra])


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """One row of each group of ``docs``: that with the smallest id (of several, the smallest text hash)."""
    mark = F.xxhash64(F.coalesce(F.col("text"), F.lit("")))
    found = cut(near_duplicates(docs, extra=(("mark", mark),), **options))
    best = found.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "mark")).alias("b"))
    best = best.select(F.col("b.doc_id").alias("best_id"), F.col("b.mark").alias("best_mark"))
    twice = found.join(best, F.col("doc_id").eqNullSafe(F.col("best_id")) & (F.col("mark") == F.col("best_mark"))).groupBy("best_id", "best_mark").count().where("count > 1")
    rows = docs.select(F.col("doc_id").alias("row_id"), mark.alias("row_mark"), F.struct("*").alias("row"))
    kept = rows.join(best, F.col("row_id").eqNullSafe(F.col("best_id")) & (F.col("row_mark") == F.col("best_mark")), "left_semi")
    if not twice.isEmpty():  # repeated rows
        kept = kept.dropDuplicates(["row_id", "row_mark"])
    return kept.select(*[F.col(f"row.`{c}`") for c in docs.columns])
