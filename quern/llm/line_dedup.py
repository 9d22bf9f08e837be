"""Line dedup: documents probe a sharded minimal perfect hash of the lines.

1. Every document gives the 128-bit hashes of its distinct long line keys.  Line
   and a salt of the document's id deal them to tasks that drop repeated ids and
   count, so a line that a third of the documents share is counted by many.
2. The distinct lines are dealt to shards by hash, about ``shard_lines`` each.  A
   shard is a minimal perfect hash of the first half of the line hashes, indexing
   three compact arrays: fingerprint (the second half), number of documents, and
   the document that keeps the line.  The partial counts are added up in the
   arrays, so no line is joined or grouped for its count.
3. Lines whose count stays below ``min_docs`` can't be dropped; the shard leaves
   them out and lays out hash and arrays anew for the others, so what is sent to
   the documents grows with the repeated lines only.
4. Documents look their lines up in the arrays: fingerprint, count and keeper.

The arrays are broadcast while they are within ``most_bytes``.  A larger index stays
where its shards are: the hashes of step 1, which are narrow, are dealt to the shards
(a shard with very many of them to several tasks, each with a copy of its arrays) and
probe there; what was found comes back by document.  The text is read once for the
hashes and once for the result, whatever the index's size.

A line's key is the line without ASCII white space at both ends, A-Z
lower-cased.  Keys of at least ``min_chars`` code points found in at least
``min_docs`` documents lose their lines in all documents but the one with the
largest id that holds them (where all of its occurrences stay).

Defined results: a null or empty text is one empty line; rows with the same id
are one document for counting and keeping; null ids count as one document,
smaller than all others; a line's length has no limit; an empty table gives no
rows; other columns are not looked at.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, cut, map_batches
from .perfect_hash import PerfectHash

MIN_CHARS = 40
MIN_DOCS = 5
SHARD_LINES = 50_000
#: Shards that small tables have all the same, of LEAST_LINES lines, and the most that there are: then they are larger.
LEAST_SHARDS, LEAST_LINES, MOST_SHARDS = 64, 1000, 20_000
MOST_BYTES = 96 << 20
#: Hashes that a task probes, beyond ``MOST_BYTES`` of arrays; more of a shard's are dealt to several.
TASK_ROWS = 2_000_000
#: Tasks that the documents of one line are dealt to for counting, at most.
SALTS = 512
#: Stands for a null id; no real id is smaller.
NO_ID = -(2**63)


def line_key(line: bytes, min_chars: int) -> bytes | None:
    """The key of a line that is long enough, else None."""
    if len(line) < min_chars:
        return None
    key = line.strip().lower()  # of bytes: ASCII white space and A-Z only
    if len(key) < min_chars or (len(key) < 4 * min_chars and len(key.decode("utf-8", "replace")) < min_chars):
        return None
    return key


def line_hashes(docs: DataFrame, id_col: str, text_col: str, min_chars: int) -> DataFrame:
    """(h, f, doc, mark): halves of the hash of every long key of every document, once a row; ``mark`` is a hash of the text."""

    def make():
        def fn(batch: pa.RecordBatch) -> pa.RecordBatch:
            found: list[bytes] = []
            owner: list[int] = []
            for i, text in enumerate(as_bytes(batch.column(1))):
                keys = {xxhash.xxh3_128_digest(k) for line in text.split(b"\n") if (k := line_key(line, min_chars)) is not None}
                found += keys
                owner += [i] * len(keys)
            halves = np.frombuffer(b"".join(found), dtype="<i8").reshape(-1, 2)
            ids = batch.column(0).take(pa.array(owner, pa.int64())).cast(pa.int64())
            marks = batch.column(2).take(pa.array(owner, pa.int64()))
            return pa.RecordBatch.from_arrays([pa.array(halves[:, 0].copy()), pa.array(halves[:, 1].copy()), ids, marks], names=["h", "f", "doc", "mark"])

        return fn

    return map_batches(docs.select(id_col, text_col, mark_of(text_col)), make, "h bigint, f bigint, doc bigint, mark bigint")


def mark_of(text_col: str) -> Column:
    """Tells the rows of one id apart."""
    return F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("mark")


def partial_counts(hashes: DataFrame, salts: int = SALTS) -> DataFrame:
    """(h, f, n, keep): documents and largest id of every line, one row a line and salt."""
    rows = hashes.select("h", "f", F.coalesce("doc", F.lit(NO_ID)).alias("doc"))
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("doc"), F.lit(salts)).cast("int")).repartition("h", "f", "salt")
    return rows.distinct().groupBy("h", "f", "salt").agg(F.count("*").alias("n"), F.max("doc").alias("keep")).drop("salt")


def lay_out(keys: np.ndarray) -> tuple[PerfectHash, np.ndarray]:
    ph = PerfectHash(keys)
    return ph, ph.slots(keys)


def count_shard(h: np.ndarray, f: np.ndarray, n: np.ndarray, keep: np.ndarray, min_docs: int) -> tuple[bytes, int]:
    """The dumped index of one shard, made from the partial counts of all its lines, and how many lines it had."""
    keys, first, of = np.unique(h, return_index=True, return_inverse=True)
    ph, slot = lay_out(keys)
    prints, counts, keeps = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64), np.full(len(keys), NO_ID)
    prints[slot] = f[first]
    at = slot[of]
    own = prints[at] == f
    np.add.at(counts, at[own], n[own])
    np.maximum.at(keeps, at[own], keep[own])
    side: dict[tuple[int, int], list[int]] = {}  # other lines whose first halves are equal
    for i in np.flatnonzero(~own):
        found = side.setdefault((int(h[i].view(np.int64)), int(f[i])), [0, NO_ID])
        found[0] += int(n[i])
        found[1] = max(found[1], int(keep[i]))
    often = keys[counts[slot] >= min_docs]
    old = ph.slots(often)
    ph, slot = lay_out(often)
    arrays = []
    for a, kind in ((prints, np.int64), (counts, np.uint32), (keeps, np.int64)):
        new = np.zeros(len(often), kind)
        new[slot] = np.minimum(a[old], 2**32 - 1) if kind is np.uint32 else a[old]
        arrays.append(new.tobytes())
    more = {k: v for k, v in side.items() if v[0] >= min_docs}
    return pickle.dumps((ph.dump(), *arrays, more), 5), len(keys) + len(side)


def shards_for(lines: int, shard_lines: int = SHARD_LINES) -> int:
    return max(1, min(LEAST_SHARDS, lines // LEAST_LINES), min(MOST_SHARDS, -(-lines // shard_lines)))


def build_shards(lines: DataFrame, shards: int, min_docs: int) -> DataFrame:
    """(shard, index, size, lines): a perfect hash and its arrays per shard."""

    def build(table: pa.Table) -> pa.Table:
        h, f, n, keep = (table.column(c).to_numpy().astype(np.int64) for c in ("h", "f", "n", "keep"))
        raw, distinct = count_shard(h.view(np.uint64), f, n, keep, min_docs)
        return pa.table({"shard": table.column("shard")[:1].cast(pa.int32()), "index": pa.array([raw], pa.binary()), "size": pa.array([len(raw)], pa.int64()), "lines": pa.array([distinct], pa.int64())})

    keyed = lines.withColumn("shard", F.pmod(F.xxhash64("h"), F.lit(shards)).cast("int"))
    return keyed.groupBy("shard").applyInArrow(build, "shard int, index binary, size bigint, lines bigint")


class Index:
    """Loaded shards; ``keeper`` probes many lines at once."""

    def __init__(self, parts: dict[int, bytes], shards: int):
        self.shards, self.parts = shards, {}
        for shard, raw in parts.items():
            ph, f, n, keep, more = pickle.loads(raw)
            self.parts[shard] = (PerfectHash.load(ph), np.frombuffer(f, np.int64), np.frombuffer(n, np.uint32), np.frombuffer(keep, np.int64), more)

    def keeper(self, h: np.ndarray, f: np.ndarray, shard: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The number of documents of each line (0: not a repeated one), and the id of the one that keeps it."""
        count, keep = np.zeros(len(h), dtype=np.int64), np.zeros(len(h), dtype=np.int64)
        order = np.argsort(shard, kind="stable")
        for s, rows in zip(*_runs(shard[order], order), strict=True):
            if int(s) not in self.parts:
                continue
            ph, prints, counts, keeps, more = self.parts[int(s)]
            slot = ph.slots(h[rows].view(np.uint64))
            ok = slot >= 0
            ok[ok] = prints[slot[ok]] == f[rows[ok]]
            count[rows[ok]], keep[rows[ok]] = counts[slot[ok]], keeps[slot[ok]]
            for i in rows[~ok] if more else ():
                if (k := (int(h[i]), int(f[i]))) in more:
                    count[i], keep[i] = more[k]
        return count, keep


def _runs(values: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    if not len(values):
        return values, []
    at = np.flatnonzero(np.r_[True, values[1:] != values[:-1]])
    return values[at], np.split(order, at[1:])


def _shard_of(h: np.ndarray, shards: int) -> np.ndarray:
    """``pmod(xxhash64(h), shards)`` as Spark computes it (XXH64 of the 8 bytes, seed 42)."""
    if shards == 1:
        return np.zeros(len(h), dtype=np.int64)
    signed = np.array([xxhash.xxh64_intdigest(x.tobytes(), 42) for x in h], dtype=np.uint64).view(np.int64)
    return signed % shards


def _some(texts: list[bytes], most: int = 8 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of texts of some 8 MB."""
    at = 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and size < most:
            size += len(texts[end])
            end += 1
        yield at, end
        at = end


RESULT = "doc_id bigint, n_lines bigint, n_dropped bigint, most_docs bigint, kept_text string"


def _result(ids: list, texts: list[bytes], split: list[list[bytes]], gone: dict[int, set[int]], most: dict[int, int]) -> pa.RecordBatch:
    kept = [b"\n".join(x for j, x in enumerate(lines) if j not in gone[i]) if i in gone else texts[i] for i, lines in enumerate(split)]
    counts = ids, [len(x) for x in split], [len(gone.get(i, ())) for i in range(len(ids))], [most.get(i, 0) for i in range(len(ids))]
    return pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in counts), pa.array(kept, pa.binary()).cast(pa.string())], names=[f.split()[0] for f in RESULT.split(", ")])


def _long_lines(split: list[list[bytes]], min_chars: int) -> tuple[list[tuple[int, int]], np.ndarray]:
    """Text and line number of the lines with a long key, and both halves of its hash."""
    hashes, place = [], []
    for i, lines in enumerate(split):
        for j, line in enumerate(lines):
            if (k := line_key(line, min_chars)) is not None:
                hashes.append(xxhash.xxh3_128_digest(k))
                place.append((i, j))
    return place, np.frombuffer(b"".join(hashes), dtype="<i8").reshape(-1, 2)


def probe_broadcast(docs: DataFrame, id_col: str, text_col: str, min_chars: int, min_docs: int, index, shards: int) -> DataFrame:
    """The documents without the lines that the arrays, which every task has, tell to drop."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = Index(index.value, shards)
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), as_bytes(batch.column(1))
            for at, end in _some(texts):
                split = [t.split(b"\n") for t in texts[at:end]]
                place, halves = _long_lines(split, min_chars)
                h, f = halves[:, 0].copy(), halves[:, 1].copy()
                count, keep = table.keeper(h, f, _shard_of(h, shards))
                own = np.array([NO_ID if ids[at + i] is None else ids[at + i] for i, _ in place], dtype=np.int64)
                gone: dict[int, set[int]] = {}
                most: dict[int, int] = {}
                for k in np.flatnonzero(count >= min_docs):
                    i, j = place[k]
                    most[i] = max(most.get(i, 0), int(count[k]))
                    if keep[k] != own[k]:
                        gone.setdefault(i, set()).add(j)
                yield _result(ids[at:end], texts[at:end], split, gone, most)

    return docs.select(F.col(id_col).cast("bigint"), text_col).mapInArrow(run, RESULT)


def probe_shards(hashes: DataFrame, built: DataFrame, shards: int, min_docs: int, task_rows: int = TASK_ROWS) -> DataFrame:
    """(doc, mark, drops, most_docs) of documents with repeated lines; ``drops`` are the hashes of those that go.

    Hashes meet the arrays of their shard in a task: the arrays come first, then the hashes in batches."""
    keyed = hashes.withColumn("shard", F.pmod(F.xxhash64("h"), F.lit(shards)).cast("int"))
    parts = keyed.groupBy("shard").agg(F.ceil(F.count("*") / task_rows).cast("int").alias("parts"))  # a row a shard
    rows = keyed.join(F.broadcast(parts), "shard").withColumn("part", F.pmod(F.xxhash64("doc", "mark"), F.col("parts")).cast("int"))
    none = lambda kind: F.lit(None).cast(kind)
    rows = rows.select("shard", "part", F.lit(1).alias("turn"), "h", "f", "doc", "mark", none("binary").alias("index"))
    arrays = built.join(F.broadcast(parts), "shard").select("shard", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(0).alias("turn"), *(none("bigint").alias(c) for c in ("h", "f", "doc", "mark")), "index")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, has = None, None
        for batch in batches:
            turn, shard = batch.column("turn").to_numpy(), batch.column("shard").to_numpy()
            cuts = np.flatnonzero(turn == 0).tolist()
            for begin, end in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
                at = begin
                if begin in cuts:
                    has = int(shard[begin])
                    table = Index({has: batch.column("index")[begin].as_py()}, shards)
                    at += 1
                if at >= end:
                    continue
                h, f, doc = (batch.column(c).slice(at, end - at).fill_null(NO_ID).to_numpy() for c in ("h", "f", "doc"))
                count, keep = table.keeper(h, f, np.full(len(h), has))
                found = np.flatnonzero(count >= min_docs)
                if len(found):
                    pick = batch.slice(at, end - at).take(pa.array(found))
                    yield pa.RecordBatch.from_arrays([pick.column("doc"), pick.column("mark"), pick.column("h"), pick.column("f"), pa.array(count[found].astype(np.int64)), pa.array(keep[found] != doc[found])], names=["doc", "mark", "h", "f", "n", "gone"])

    both = rows.unionByName(arrays).repartition("shard", "part").sortWithinPartitions("shard", "part", "turn")
    found = both.mapInArrow(run, "doc bigint, mark bigint, h bigint, f bigint, n bigint, gone boolean")
    drops = F.collect_set(F.when(F.col("gone"), F.struct("h", "f")))  # of one document's lines
    return found.groupBy("doc", "mark").agg(drops.alias("drops"), F.max("n").alias("most_docs"))


def without_drops(docs: DataFrame, found: DataFrame, id_col: str, text_col: str, min_chars: int) -> DataFrame:
    """The documents without the lines found in the shards."""
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"), mark_of(text_col))
    found = found.withColumnRenamed("mark", "m")
    rows = rows.join(found, F.col("doc_id").eqNullSafe(F.col("doc")) & (F.col("mark") == F.col("m")), "left").select("doc_id", "text", "drops", "most_docs")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), as_bytes(batch.column(1))
            drops, most = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            for at, end in _some(texts):
                split = [t.split(b"\n") for t in texts[at:end]]
                those = {i: {(d["h"], d["f"]) for d in drops[at + i]} for i in range(end - at) if drops[at + i]}
                place, halves = _long_lines([x if i in those else [] for i, x in enumerate(split)], min_chars)
                gone: dict[int, set[int]] = {}
                for (i, j), (h, f) in zip(place, halves.tolist(), strict=True):
                    if (h, f) in those[i]:
                        gone.setdefault(i, set()).add(j)
                yield _result(ids[at:end], texts[at:end], split, gone, {i: most[at + i] or 0 for i in range(end - at)})

    return rows.mapInArrow(run, RESULT)


def dedup_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, shard_lines: int = SHARD_LINES, most_bytes: int = MOST_BYTES, task_rows: int = TASK_ROWS) -> DataFrame:
    """doc_id, n_lines (before), n_dropped, most_docs (documents of its most common repeated line, 0 without one), kept_text."""
    spark = docs.sparkSession
    hashes = cut(line_hashes(docs, id_col, text_col, min_chars))
    shards = shards_for(hashes.count(), shard_lines)  # a line has a row a document, so shards are no larger
    built = cut(build_shards(partial_counts(hashes), shards, min_docs))
    if (built.agg(F.sum("size").alias("n")).first()["n"] or 0) <= most_bytes:
        index = spark.sparkContext.broadcast({r["shard"]: bytes(r["index"]) for r in built.select("shard", "index").collect()})
        return probe_broadcast(docs, id_col, text_col, min_chars, min_docs, index, shards)
    return without_drops(docs, probe_shards(hashes, built, shards, min_docs, task_rows), id_col, text_col, min_chars)
