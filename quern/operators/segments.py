"""An inverted index in immutable segments, read in blocks that can be skipped.

A *segment* is what one change of the corpus adds: the postings of new rows, the keys of
rows of earlier segments that are gone or replaced, and what the change adds to or takes
from the corpus statistics (rows, lengths, and how many rows have each term).  So a change
is written in its own size, and statistics are sums over segments, equal to those of an
index made anew.  Segments are merged from the newest backwards once there are many.

Rows of a segment lie in *slots* by a hash of their key, about ``SLOT_ROWS`` a slot; the
postings of a term in a slot are one *block*, with the highest frequency and the smallest
length in it.  These bound what the block adds to any row's score under whatever
statistics hold when it is read, so the sum over the query's terms bounds all rows of the
slot.  :func:`top` reads the most promising slots first; the k-th score found there is a
floor, and a slot whose bound lies below it is never read.  The result is that of a scan.

Both words and trigrams are terms, parted by ``kind``; a trigram's frequency is one.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field, replace
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import bm25
from .lineage import cut

WORD, GRAM = "word", "gram"
#: Rows of a slot; slots that are read first.
SLOT_ROWS, FIRST = 128, 64
#: Slots to be read that are named in the plan; more are joined.
MOST_SLOTS = 5000
#: Segments beyond which the newest are merged.
MOST_SEGMENTS = 8
#: Rows gone of which a broadcast may hold the keys.
MOST_GONE = 500_000
#: Words and trigrams of which blocks are made at once, in whole slots; rows that are looked at together.
GROUP_TERMS, GROUP_ROWS = 500_000, 256
#: Scores are compared to so many digits; a floor is lowered by more than that.
SLACK = 1e-8

BLOCKS = "kind string, term string, slot int, n_posts int, most_f double, most_n double, least_len int, posts array<struct<row_id:string,f:double,n:double,len:int>>"
TERMS = "kind string, term string, df bigint"
GONE = "row_id string"


@dataclass
class Segment:
    """Its tables, and what it adds to the sums over the corpus; ``rows`` counts the rows added."""

    number: int
    slots: int
    rows: int
    n_docs: int
    words: int
    grams: int
    n_gone: int
    blocks: DataFrame = field(repr=False)
    terms: DataFrame = field(repr=False)
    gone: DataFrame = field(repr=False)
    #: (kind, term, df) of the rows that went, where the blocks are a segment's own.
    fewer: DataFrame | None = field(default=None, repr=False)
    #: Whether ``terms`` are the sums of the blocks, less ``fewer``.
    summed: bool = False

    def stored(self, blocks: DataFrame) -> Segment:
        """With its blocks as they are stored; its terms are counted from these, not made anew."""
        return replace(self, blocks=blocks, terms=document_counts(blocks, self.fewer) if self.summed else self.terms)

    SUMS = ("number", "slots", "rows", "n_docs", "words", "grams", "n_gone")

    def sums(self) -> dict[str, int]:
        return {n: getattr(self, n) for n in self.SUMS}


def slots_for(rows: int) -> int:
    return 1 << max(0, math.ceil(math.log2(max(1, rows) / SLOT_ROWS)))


def slot_of(slots: int) -> Column:
    return F.pmod(F.xxhash64("row_id"), F.lit(slots)).cast("int")


def to_blocks(posts: DataFrame, *dealt: str) -> DataFrame:
    """Postings with their slot as blocks; a group holds the rows of one slot at most.  Postings that are
    dealt by slot already, or by columns ``dealt`` that the slot decides, are grouped where they are."""
    post = F.struct("row_id", "f", "n", "len")
    return posts.groupBy("kind", "term", "slot", *dealt).agg(
        F.count("*").cast("int").alias("n_posts"), F.max("f").alias("most_f"), F.max("n").alias("most_n"), F.min("len").alias("least_len"), F.sort_array(F.collect_list(post)).alias("posts")
    ).drop(*dealt)


def _block_batch(kind: str, slots: np.ndarray, ids: pa.Array, terms: pa.Array, term: np.ndarray, row: np.ndarray, f: np.ndarray, n: np.ndarray, length: np.ndarray) -> pa.RecordBatch:
    """Postings, in order of their term and row, as blocks; ``row`` tells the place of their row among ``ids`` and ``slots``."""
    slot = slots[row]
    start = np.flatnonzero(np.r_[True, (term[1:] != term[:-1]) | (slot[1:] != slot[:-1])])
    size = np.diff(np.r_[start, len(row)])
    posts = pa.StructArray.from_arrays([ids.take(pa.array(row)), pa.array(f), pa.array(n), pa.array(length, pa.int32())], names=["row_id", "f", "n", "len"])
    return pa.RecordBatch.from_arrays(
        [pa.array([kind] * len(start)), terms.take(pa.array(term[start])), pa.array(slot[start], pa.int32()), pa.array(size, pa.int32()), pa.array(np.maximum.reduceat(f, start)), pa.array(np.maximum.reduceat(n, start)),
         pa.array(np.minimum.reduceat(length, start), pa.int32()), pa.ListArray.from_arrays(pa.array(np.r_[start, len(row)], pa.int32()), posts)],
        names=["kind", "term", "slot", "n_posts", "most_f", "most_n", "least_len", "posts"],
    )


def _encoded(columns: list[pa.Array]) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """The distinct values of list columns; and of each value its number, its row and its column."""
    flat = pc.dictionary_encode(pa.concat_arrays([c.flatten() for c in columns]))
    sizes = [pc.list_value_length(c).fill_null(0).to_numpy(zero_copy_only=False) for c in columns]
    row = np.concatenate([np.repeat(np.arange(len(x)), x) for x in sizes])
    return flat.dictionary, flat.indices.to_numpy(zero_copy_only=False).astype(np.int64), row, np.repeat(np.arange(len(columns)), [int(x.sum()) for x in sizes])


def _group_blocks(group: pa.Table, weights: dict[str, float]) -> Iterator[pa.RecordBatch]:
    """Blocks of rows (row_id, slot, word_len, gram_len, token columns, grams) that are all rows of their slots."""
    rows = group.sort_by([("slot", "ascending"), ("row_id", "ascending"), ("word_len", "ascending")]).combine_chunks()
    column = lambda name: rows.column(name).combine_chunks()
    ids, count = column("row_id"), rows.num_rows
    slots, word_len, gram_len = (column(c).to_numpy(zero_copy_only=False) for c in ("slot", "word_len", "gram_len"))
    terms, term, row, own = _encoded([column(c) for c in weights])
    if len(term):
        key = term * count + row
        order = np.argsort(key)
        key = key[order]
        start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        f = np.add.reduceat(np.array([float(w) for w in weights.values()])[own[order]], start)
        n = np.diff(np.r_[start, len(key)]).astype(float)
        term, row = key[start] // count, key[start] % count
        yield _block_batch(WORD, slots, ids, terms, term, row, f, n, word_len[row])
    terms, term, row, _ = _encoded([column("grams")])
    if len(term):
        key = np.sort(term * count + row)
        term, row = key // count, key % count
        one = np.ones(len(key))
        yield _block_batch(GRAM, slots, ids, terms, term, row, one, one, gram_len[row])


def blocks_of(rows: DataFrame, weights: dict[str, float], slots: int) -> DataFrame:
    """Blocks of search rows.  The rows are dealt by slot, each once as it is: no posting is shuffled, none is a row."""
    whole = reduce(Column.__and__, [F.col(c).isNotNull() for c in weights])
    dealt = rows.select(
        "row_id", slot_of(slots).alias("slot"), F.coalesce(bm25.length(weights), F.lit(0)).alias("word_len"), F.coalesce(F.size("grams"), F.lit(0)).alias("gram_len"), *[F.when(whole, F.col(c)).alias(c) for c in weights], "grams"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for whole in batches:
            for at in range(0, whole.num_rows, GROUP_ROWS):
                some = whole.slice(at, GROUP_ROWS)
                held.append(some)
                size += sum(pc.sum(some.column(c)).as_py() for c in ("word_len", "gram_len"))
                if size < GROUP_TERMS:
                    continue
                group = pa.Table.from_batches(held).combine_chunks()
                slot = group.column("slot").to_numpy()
                end = int(np.searchsorted(slot, slot[-1]))  # the last slot may go on
                if end:
                    yield from _group_blocks(group.slice(0, end), weights)
                held, size = group.slice(end).to_batches(), 0
        if held:
            yield from _group_blocks(pa.Table.from_batches(held), weights)

    return dealt.repartition("slot").sortWithinPartitions("slot").mapInArrow(run, BLOCKS)


def _sums(rows: DataFrame, weights: dict[str, float]) -> tuple[int, int, int]:
    r = rows.agg(F.count("*"), F.coalesce(F.sum(bm25.length(weights)), F.lit(0)), F.coalesce(F.sum(F.size("grams")), F.lit(0))).first()
    return r[0], r[1], r[2]


def counted(rows: DataFrame, weights: dict[str, float]) -> DataFrame:
    """(kind, term, df) of search rows, in how many each term is: of a row, each of its terms once."""
    each = lambda kind, terms: rows.select(F.lit(kind).alias("kind"), F.explode(terms).alias("term")).groupBy("kind", "term").agg(F.count("*").alias("df"))
    return each(WORD, F.array_distinct(F.concat(*[F.col(c) for c in weights]))).unionByName(each(GRAM, F.col("grams")))


def document_counts(blocks: DataFrame, fewer: DataFrame | None) -> DataFrame:
    """(kind, term, df) that blocks add and rows that went (``fewer``) take away."""
    df = blocks.groupBy("kind", "term").agg(F.sum("n_posts").alias("df"))
    if fewer is None:
        return df
    return df.unionByName(fewer.withColumn("df", -F.col("df"))).groupBy("kind", "term").agg(F.sum("df").alias("df")).where("df <> 0")


def segment(added: DataFrame, removed: DataFrame | None, weights: dict[str, float], number: int = 1) -> Segment:
    """The segment of rows that come and of earlier rows that go (a changed row is in both); its tables are plans yet."""
    n, words, grams = _sums(added, weights)
    fewer, less, gone = None, (0, 0, 0), added.select("row_id").limit(0)
    if removed is not None:
        less = _sums(removed, weights)
        fewer, gone = counted(removed, weights), removed.select("row_id")
    slots = slots_for(n)
    blocks = blocks_of(added, weights, slots)
    return Segment(number, slots, n, n - less[0], words - less[1], grams - less[2], less[0], blocks, document_counts(blocks, fewer), gone, fewer, True)


def difference(old: DataFrame, new: DataFrame, weights: dict[str, float]) -> tuple[DataFrame, DataFrame]:
    """(added, removed): rows of ``new`` that ``old`` doesn't have with the same terms, and the other way round.

    The comparison sees a hash a row, so it is narrow whatever the rows hold."""
    terms = [*weights, "grams"]
    mark = lambda rows, is_new: rows.select("row_id", *[F.xxhash64(F.lit(salt), *terms).alias(f"m{salt}") for salt in (1, 2)], F.lit(is_new).alias("is_new"))
    sides = mark(old, False).unionByName(mark(new, True)).groupBy("row_id", "m1", "m2").agg(F.max("is_new").alias("in_new"), F.max(~F.col("is_new")).alias("in_old"))
    changed = cut(sides.where(F.col("in_new") != F.col("in_old")).select("row_id", "in_new"))
    few = changed.count() <= MOST_GONE
    those = lambda side: F.broadcast(side) if few else side
    return new.join(those(changed.where("in_new")), "row_id", "left_semi"), old.join(those(changed.where("not in_new")), "row_id", "left_semi")


@dataclass
class Index:
    """Segments, oldest first, as one index."""

    segments: list[Segment]

    @property
    def n_docs(self) -> int:
        return sum(s.n_docs for s in self.segments)

    def average(self, kind: str) -> float:
        return sum(s.words if kind == WORD else s.grams for s in self.segments) / max(1, self.n_docs)

    def blocks(self) -> DataFrame:
        return reduce(DataFrame.unionByName, [s.blocks.withColumn("seg", F.lit(s.number)) for s in self.segments])

    def terms(self) -> DataFrame:
        """(kind, term, df) of the corpus."""
        all_ = reduce(DataFrame.unionByName, [s.terms for s in self.segments])
        return all_.groupBy("kind", "term").agg(F.sum("df").alias("df")).where("df > 0")

    def live(self, posts: DataFrame) -> DataFrame:
        """Postings (seg, row_id, ...) whose row isn't gone in a later segment."""
        later = [s for s in self.segments if s.n_gone]
        if not later:
            return posts
        gone = reduce(DataFrame.unionByName, [s.gone.select("row_id", F.lit(s.number).alias("gone_at")) for s in later]).groupBy("row_id").agg(F.max("gone_at").alias("gone_at"))
        gone = F.broadcast(gone) if sum(s.n_gone for s in later) <= MOST_GONE else gone
        return posts.join(gone, "row_id", "left").where("gone_at is null or gone_at <= seg").drop("gone_at")


@dataclass
class Read:
    """Of a search: blocks of the query's terms, and those that were read."""

    blocks: int = 0
    read: int = 0


def _heads(index: Index, kind: str, query: list[str]) -> DataFrame:
    """Blocks of the query's terms with ``times``, ``idf`` and, for both frequencies, the bound of their part of a score."""
    times = Counter(query)
    blocks = index.blocks().where((F.col("kind") == kind) & F.col("term").isin(list(times)))
    table = blocks.sparkSession.createDataFrame([(t, float(n)) for t, n in times.items()], "term string, times double")
    df = index.terms().where((F.col("kind") == kind) & F.col("term").isin(list(times))).select("term", "df").join(F.broadcast(table), "term")
    df = df.select("term", "times", bm25.idf(F.lit(float(index.n_docs)), F.col("df").cast("double")).alias("idf"))  # a row a query term
    bound = lambda f: F.col("times") * bm25.term_score(F.col(f), F.col("least_len"), F.lit(index.average(kind)), F.col("idf"))
    return blocks.join(F.broadcast(df), "term").withColumn("bound_f", bound("most_f")).withColumn("bound_n", bound("most_n"))


def _scores(index: Index, kind: str, heads: DataFrame) -> DataFrame:
    """(row_id, raw, plain, n_shared): scores, the lower the better, of the live rows of blocks."""
    posts = index.live(heads.select("seg", "term", "times", "idf", F.explode("posts").alias("p")).select("seg", "term", "times", "idf", "p.*"))
    part = lambda f: F.col("times") * bm25.term_score(F.col(f), F.col("len"), F.lit(index.average(kind)), F.col("idf"))
    # the parts of a row are added up in the order of their terms, whatever segment or task they come from
    parts = F.array_sort(F.collect_list(F.struct("term", part("f").alias("f"), part("n").alias("n"))))
    total = lambda f: -F.aggregate("parts", F.lit(0.0), lambda a, x: a + x[f])
    return posts.groupBy("row_id").agg(parts.alias("parts")).select("row_id", total("f").alias("raw"), total("n").alias("plain"), F.size("parts").alias("n_shared"))


def scores(index: Index, kind: str, query: list[str]) -> DataFrame:
    """(row_id, raw, plain, n_shared) of all rows with a term of the query; all of their blocks are read."""
    return _scores(index, kind, _heads(index, kind, query))


def top(index: Index, kind: str, query: list[str], keys: DataFrame, k: int, by: str = "raw", digits: int = 9, first: int = FIRST) -> tuple[DataFrame, Read]:
    """The ``k`` best of the rows in ``keys`` (row_id, updated_at), as a scan gives them: (row_id, updated_at, raw, plain, n_shared, by)."""
    heads = _heads(index, kind, query)
    found = Read()

    def best(blocks: DataFrame) -> DataFrame:
        scored = _scores(index, kind, blocks).join(keys, "row_id").withColumn("by", F.round(by, digits))
        return scored.orderBy("by", F.desc("updated_at"), "row_id").limit(k)

    if sum(s.slots for s in index.segments) <= first:
        return best(heads), found
    bound = F.sum("bound_f" if by == "raw" else "bound_n").alias("bound")
    slots = cut(heads.groupBy("seg", "slot").agg(bound, F.count("*").alias("n")))  # a row a slot, read three times
    lead = slots.orderBy(F.desc("bound"), "seg", "slot").limit(first)
    seen = best(heads.join(F.broadcast(lead.select("seg", "slot")), ["seg", "slot"]))
    floor = seen.agg(F.count("*").alias("n"), F.max("by").alias("worst")).first()
    least = -floor["worst"] - SLACK if floor["n"] == k else -math.inf
    sums = slots.agg(F.sum("n").alias("all"), F.sum(F.when(F.col("bound") >= least, F.col("n"))).alias("some"), F.count_if(F.col("bound") >= least).alias("slots")).first()
    found.blocks, found.read = sums["all"] or 0, sums["some"] or 0
    if found.read == found.blocks:
        return best(heads), found
    kept = slots.where(F.col("bound") >= least).select("seg", "slot")
    if sums["slots"] > MOST_SLOTS:
        return best(heads.join(kept, ["seg", "slot"], "left_semi")), found
    named: dict[int, list[int]] = {}
    for r in kept.collect():  # at most MOST_SLOTS pairs of numbers
        named.setdefault(r["seg"], []).append(r["slot"])
    wanted = reduce(Column.__or__, [(F.col("seg") == s) & F.col("slot").isin(sorted(those)) for s, those in named.items()], F.lit(False))
    return best(heads.where(wanted)), found


def to_merge(sizes: list[int]) -> int:
    """From which segment on all are merged: those that the newer ones outweigh by half, two at least."""
    at, total = len(sizes) - 1, sizes[-1]
    while at and (sizes[at - 1] < 2 * total or at == len(sizes) - 1):
        at -= 1
        total += sizes[at]
    return at


def merged(index: Index, start: int) -> Segment:
    """One segment in place of all from ``start`` on; without earlier ones it has nothing left to take away."""
    part = Index(index.segments[start:])
    added = sum(s.rows for s in part.segments)
    gone = reduce(DataFrame.unionByName, [s.gone for s in part.segments]).distinct()
    terms = reduce(DataFrame.unionByName, [s.terms for s in part.segments]).groupBy("kind", "term").agg(F.sum("df").alias("df")).where("df <> 0")
    whole = start == 0
    rows = part.n_docs if whole else added
    slots = slots_for(rows)
    # numbers of slots are powers of two, so blocks hold rows of one place: they are dealt as they are, and grouped there
    places = min([slots, *[s.slots for s in part.segments]])
    dealt = part.blocks().select("seg", "kind", "term", F.pmod("slot", F.lit(places)).alias("place"), "posts").repartition("place")
    posts = part.live(dealt.select("seg", "kind", "term", "place", F.explode("posts").alias("p")).select("seg", "kind", "term", "place", "p.*"))
    blocks = to_blocks(posts.withColumn("slot", slot_of(slots)), "place")
    return Segment(
        part.segments[-1].number, slots, rows, part.n_docs, sum(s.words for s in part.segments), sum(s.grams for s in part.segments), 0 if whole else sum(s.n_gone for s in part.segments),
        blocks, terms, gone.limit(0) if whole else gone,
    )
