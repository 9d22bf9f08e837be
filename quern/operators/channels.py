"""The four retrieval channels over a corpus of search rows.

A search row is a chunk with its session's columns, or a memory.  A channel
returns at most :data:`TOP` rows (``row_id, group_key, text, raw, updated_at,
pos``), ``pos`` being its order from 1.  All limits are top-k plans
(``TakeOrderedAndProject``); ranks are numbered on those few rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vectors as V
from . import bm25, segments

TOP = 100
PREFILTER = 200
LEAST_SIMILARITY = 0.25
#: Digits to which scores are compared, so that sums in another order don't reorder rows.
DIGITS = 9


@dataclass(frozen=True)
class CorpusSpec:
    """What differs between the corpora."""

    name: str
    id_col: str
    #: Token columns and their BM25 weights.
    weights: tuple[tuple[str, float], ...]
    #: Token columns that count for the coverage of the query.
    coverage: tuple[str, ...]
    #: Order the lexical channel by the unweighted score.
    unweighted_order: bool = False
    #: Drop the lexical channel when its best row covers under half of a query of three words or more.
    gate: bool = False
    #: One rank per group.
    dedupe: bool = False
    #: The exact channel's rows have no text.
    bare_exact: bool = False


SESSIONS = CorpusSpec(
    "sessions", "native_id",
    (("t_content", 1.0), ("t_name", 3.0), ("t_cwd", 0.5), ("t_native", 4.0), ("t_branch", 1.0)),
    ("t_content", "t_name", "t_cwd"), gate=True, dedupe=True, bare_exact=True,
)
MEMORIES = CorpusSpec(
    "memories", "id",
    (("t_content", 1.0), ("t_source", 0.5), ("t_project", 0.5), ("t_id", 3.0)),
    ("t_content", "t_source", "t_project"), unweighted_order=True,
)


def _ranked(rows: DataFrame, *order: Column, body: tuple[str, ...] = ("text",)) -> DataFrame:
    pos = F.row_number().over(Window.orderBy(*order)).cast("bigint")
    return rows.withColumn("pos", pos).select("row_id", "group_key", *body, F.col("raw").cast("double").alias("raw"), "updated_at", "pos")


def exact(groups: DataFrame, spec: CorpusSpec, query: str, where: Column) -> DataFrame:
    """Rows (one a group) whose identifier is the query."""
    rows = groups.where(where & (F.col(spec.id_col) == query)).orderBy(F.desc("updated_at"), "group_key").limit(TOP)
    body = F.lit("") if spec.bare_exact else F.col("text")
    rows = rows.select(F.col("group_key").alias("row_id"), "group_key", body.alias("text"), F.lit(1.0).alias("raw"), "updated_at")
    return _ranked(rows, F.desc("updated_at"), F.col("group_key"))


def covered(spec: CorpusSpec, query: list[str]) -> Column:
    """Distinct query words that a row has in its coverage columns."""
    wanted = F.array(*[F.lit(t) for t in dict.fromkeys(query)])
    return F.size(F.array_intersect(wanted, F.concat(*[F.col(c) for c in spec.coverage])))


def least_coverage(query: list[str]) -> int:
    n = len(set(query))
    return 1 if n < 3 else -(-n // 3)


def looked_up(rows: DataFrame, top: DataFrame) -> DataFrame:
    """The search rows of at most some hundred keys, with what ``top`` says of them; only those are widened."""
    return rows.drop("updated_at").join(F.broadcast(top), "row_id")


def keys_of(rows: DataFrame, where: Column) -> DataFrame:
    return rows.where(where).select("row_id", "updated_at")


def _least(scored: DataFrame, order: str, most: int) -> DataFrame:
    return scored.withColumn("by", F.round(order, DIGITS)).orderBy("by", F.desc("updated_at"), "row_id").limit(most)


def lexical_rows(rows: DataFrame, spec: CorpusSpec, query: list[str], where: Column, index: segments.Index | None = None) -> DataFrame:
    """The top rows by BM25, then those that cover enough of the query, with ``coverage``.

    With an inverted index keys are scored and filtered first, and rows are looked up for
    what is among the best."""
    order = "plain" if spec.unweighted_order else "raw"
    if index is not None:
        top = looked_up(rows, segments.top(index, segments.WORD, query, keys_of(rows, where), TOP, order, DIGITS)[0])
    else:
        top = _least(bm25.score_scan(rows, dict(spec.weights), query, "raw", where, unweighted="plain"), order, TOP)
    return top.withColumn("coverage", covered(spec, query)).where(F.col("coverage") >= least_coverage(query))


def lexical(rows: DataFrame, spec: CorpusSpec, query: list[str], where: Column, index: segments.Index | None = None) -> DataFrame:
    return _gated(lexical_rows(rows, spec, query, where, index), spec, query)


def _gated(top: DataFrame, spec: CorpusSpec, query: list[str], body: tuple[str, ...] = ("text",)) -> DataFrame:
    n = len(set(query))
    if spec.gate and n >= 3:
        top = top.withColumn("best", F.max("coverage").over(Window.partitionBy(F.lit(0)))).where(F.col("best") * 2 >= n)
    return _ranked(top, F.col("by"), F.desc("updated_at"), F.col("row_id"), body=body)


def fuzzy_prefilter(rows: DataFrame, grams: list[str], where: Column, index: segments.Index | None = None) -> DataFrame:
    """The top rows by BM25 over trigrams, from the inverted index where there is one."""
    if index is not None:
        return looked_up(rows, segments.top(index, segments.GRAM, list(dict.fromkeys(grams)), keys_of(rows, where), PREFILTER, "raw", DIGITS)[0])
    return _least(bm25.score_gram_sets(rows, "grams", grams, "gram_score", where), "gram_score", PREFILTER)


def fuzzy(rows: DataFrame, spec: CorpusSpec, grams: list[str], where: Column, index: segments.Index | None = None) -> DataFrame:
    """Trigram containment of the query in the rows that BM25 over trigrams prefers."""
    return _contained(fuzzy_prefilter(rows, grams, where, index), grams)


def _contained(top: DataFrame, grams: list[str], body: tuple[str, ...] = ("text",)) -> DataFrame:
    top = top.withColumn("raw", F.col("n_shared") / F.lit(float(len(grams)))).where(F.col("raw") >= LEAST_SIMILARITY)
    order = (F.desc("raw"), F.desc("updated_at"), F.col("by"), F.col("row_id"))
    return _ranked(top.orderBy(*order).limit(TOP), *order, body=body)


def semantic(rows: DataFrame, query: list[float], fingerprint: str, threshold: float, where: Column) -> DataFrame:
    """Dot product with the query's unit vector, of rows embedded by the same provider."""
    usable = rows.where(where & _usable(query, fingerprint))
    return _nearest(usable.withColumn("raw", _dot(query)), threshold)


def _usable(query: list[float], fingerprint: str) -> Column:
    return F.col("embedding").isNotNull() & (F.col("embedding_fingerprint") == fingerprint) & (F.size("embedding") == len(query))


def _dot(query: list[float]) -> Column:
    return F.round(V.dot(F.col("embedding"), V.vector(query)), DIGITS)


def _nearest(rows: DataFrame, threshold: float, body: tuple[str, ...] = ("text",)) -> DataFrame:
    order = (F.desc("raw"), F.col("row_id"))
    return _ranked(rows.where(F.col("raw") >= threshold).orderBy(*order).limit(TOP), *order, body=body)


#: What finds the text of a row again, beside its key: keys may repeat.
PRINT = "text_print"


def hits(rows: DataFrame, spec: CorpusSpec, words: list[str], grams: list[str], where: Column, key: str) -> DataFrame:
    """What the channels need of each row, in the size of the query, however long the row's text is; ``ok`` tells
    what ``where`` lets through.  For rows whose tokens are stored nowhere: they are made once, and dropped."""
    ok = F.coalesce(where, F.lit(False)).alias("ok")
    own = [*dict.fromkeys([key, "row_id"]), "group_key", "updated_at", F.xxhash64("text").alias(PRINT), ok]
    if not words:
        return rows.select(*own)
    shared = [F.size("grams").alias("gram_len"), bm25.shared_grams("grams", grams).alias("_shared")]
    return bm25.counted(rows, dict(spec.weights), words, spec.coverage).select(*own, "_len", "_f", "_n", "coverage", *shared)


def similarities(vectors: DataFrame, query: list[float], fingerprint: str, key: str) -> DataFrame:
    """(key, near) of all vectors; null where the semantic channel can't use one."""
    return vectors.select(key, F.when(_usable(query, fingerprint), _dot(query)).alias("near"))


def lexical_hits(kept: DataFrame, spec: CorpusSpec, query: list[str], body: tuple[str, ...]) -> DataFrame:
    """:func:`lexical` of what :func:`hits` kept."""
    scored = bm25.score_counted(kept, query, "raw", F.col("ok"), unweighted="plain")
    top = _least(scored, "plain" if spec.unweighted_order else "raw", TOP)
    return _gated(top.where(F.col("coverage") >= least_coverage(query)), spec, query, body)


def fuzzy_hits(kept: DataFrame, grams: list[str], body: tuple[str, ...]) -> DataFrame:
    """:func:`fuzzy` of what :func:`hits` kept."""
    return _contained(_least(bm25.score_shared(kept, F.col("gram_len"), "gram_score", F.col("ok")), "gram_score", PREFILTER), grams, body)


def semantic_hits(kept: DataFrame, threshold: float, body: tuple[str, ...]) -> DataFrame:
    """:func:`semantic` of what :func:`hits` kept, joined with :func:`similarities`."""
    return _nearest(kept.where("ok").withColumn("raw", F.col("near")), threshold, body)
