"""Hybrid search: four channels, fused."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import channels as C
from ..operators import fusion, segments
from ..operators.filters import MemoryFilters, SessionFilters
from ..operators.lineage import cut


@dataclass(frozen=True)
class QueryVector:
    """The query's unit vector, the provider's fingerprint, and the least similarity."""

    values: list[float]
    fingerprint: str
    threshold: float = 0.8


def run_channels(groups: DataFrame, rows: DataFrame, spec: C.CorpusSpec, query: str, filters: SessionFilters | MemoryFilters, vector: QueryVector | None, index: segments.Index | None = None) -> dict[str, DataFrame]:
    """The channels that the query has something for."""
    query = query.strip()
    if not query:
        raise ValueError("search query is empty")
    words, grams = T.query_tokens(query), T.query_grams(query)
    found = {"exact": C.exact(groups, spec, query, filters.predicate(with_chunk=False))}
    if words:
        found["lexical"] = C.lexical(rows, spec, words, filters.predicate(), index)
    if grams:
        found["fuzzy"] = C.fuzzy(rows, spec, grams, filters.predicate(), index)
    if vector is not None:
        found["semantic"] = C.semantic(rows, vector.values, vector.fingerprint, vector.threshold, filters.predicate())
    return found


def hybrid(groups: DataFrame, rows: DataFrame, spec: C.CorpusSpec, query: str, filters: SessionFilters | MemoryFilters, vector: QueryVector | None = None, index: segments.Index | None = None) -> DataFrame:
    """Fused result rows, best first."""
    return fusion.fuse(run_channels(groups, rows, spec, query, filters, vector, index), filters.limit, spec.dedupe)


def hybrid_scan(groups: DataFrame, rows: DataFrame, spec: C.CorpusSpec, query: str, filters: SessionFilters | MemoryFilters, vector: QueryVector | None = None, vectors: DataFrame | None = None, key: str = "row_id") -> DataFrame:
    """:func:`hybrid` for rows whose tokens are stored nowhere.

    Tokens are made in one pass, and of each row only what the query asks for is kept; texts are
    looked up for the rows that are found.  ``vectors`` (``key``, embedding, embedding_fingerprint)
    come to the rows after that, so neither texts nor vectors are shuffled or held."""
    query = query.strip()
    if not query:
        raise ValueError("search query is empty")
    words, grams = T.query_tokens(query), T.query_grams(query)
    kept = C.hits(rows, spec, words, grams, filters.predicate(), key)
    if vector is not None:
        kept = kept.join(C.similarities(vectors, vector.values, vector.fingerprint, key), key, "left")
    kept = cut(kept)
    body = tuple(c for c in (key, C.PRINT) if c != "row_id")
    few: dict[str, DataFrame] = {}
    if words:
        few["lexical"] = C.lexical_hits(kept, spec, words, body)
        few["fuzzy"] = C.fuzzy_hits(kept, grams, body)
    if vector is not None:
        few["semantic"] = C.semantic_hits(kept, vector.threshold, body)
    found = {"exact": C.exact(groups, spec, query, filters.predicate(with_chunk=False))}
    if few:
        top = cut(fusion.union(few).drop("channel_ord", "weight"))
        same = [key, C.PRINT]
        texts = rows.select(key, "text", F.xxhash64("text").alias(C.PRINT)).join(F.broadcast(top.select(*same).distinct()), same, "left_semi")
        whole = cut(top.join(texts.dropDuplicates(same), same))
        found |= {n: whole.where(F.col("channel") == n).select(found["exact"].columns) for n in few}
    return fusion.fuse(found, filters.limit, spec.dedupe)


def session_results(fused: DataFrame, sessions: DataFrame) -> DataFrame:
    """Result rows with the session's columns, excerpt and resume command; at most
    100 fused rows are broadcast."""
    out = sessions.join(F.broadcast(fused.withColumnRenamed("updated_at", "_u")), sessions["session_key"] == fused["group_key"])
    return out.select(
        "rank", "harness", F.col("native_id").alias("session_id"), "name", "cwd", "started_at", "updated_at", T.excerpt(F.col("text")).alias("excerpt"),
        T.resume_hint(F.col("harness"), F.col("native_id"), F.col("cwd")).alias("resume"), "score", "exact_rank", "lexical_rank", "fuzzy_rank", "semantic_rank", "similarity",
    )
