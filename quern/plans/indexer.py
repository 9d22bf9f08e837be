"""Incremental indexing of session logs and of records."""

from __future__ import annotations

import time
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..functions import text as T
from ..operators import chunking, maintenance
from ..operators.filters import HARNESSES
from ..operators.lineage import cut
from ..sources import adapters
from ..sources.records import RecordStore
from . import embedding
from .snapshot import Snapshot, bucket_of


@dataclass
class Result:
    discovered: int = 0
    updated: int = 0
    unchanged: int = 0
    deleted: int = 0
    errors: int = 0
    embedded: int = 0
    embedding_error: str = ""
    warnings: list[dict] = field(default_factory=list)


def now_ms() -> int:
    return int(time.time() * 1000)


def index_sessions(spark: SparkSession, store: Snapshot, roots: dict[str, str], provider: embedding.Provider | None = None, vectors: embedding.VectorStore | None = None, meta: dict[str, str] | None = None) -> Result:
    """Bring the index up to date with the logs below ``roots`` (harness -> place).

    New and changed sources are parsed; rows of vanished sources and of harnesses
    that are no more supported go; a source that fails keeps its old rows and
    version, so it is tried again.  Harnesses that aren't in ``roots`` are left alone.

    Nothing is written if nothing changed; of the chunks only the buckets of sources
    that were read anew or are gone.  ``meta`` is kept in the manifest of the rows.
    """
    result = Result()
    touched = False
    buckets: set[int] = set()
    stamp = now_ms()
    number = store.buckets("chunks")
    old = {t: store.read(t) for t in ("sources", "sessions", "chunks", "parser_errors")}
    sources, sessions, chunks, errors = old.values()
    supported = F.col("harness").isin(*HARNESSES)
    if not maintenance.removed_harnesses(sources, errors, HARNESSES).isEmpty():
        touched = True
        buckets |= buckets_of(sources.where(~supported), number)
    sources, sessions, errors = (df.where(supported) for df in (sources, sessions, errors))
    found: dict[str, list[dict]] = {}
    for harness, root in roots.items():
        try:
            found[harness] = adapters.discover(harness, root)
        except Exception as e:  # one harness doesn't stop the others
            result.errors += 1
            result.warnings.append({"type": "discovery", "message": f"{harness}: {e}"})
    result.discovered = sum(map(len, found.values()))
    listed = [(s["source_key"], h, s["path"], s["version"]) for h, those in found.items() for s in those]
    table = spark.createDataFrame(listed, "source_key string, harness string, path string, version string")
    seen = F.col("harness").isin(*found) if found else F.lit(False)
    theirs = errors.where(seen)
    status = maintenance.version_diff(sources.where(seen), table).cache()
    counts = {r["status"]: r["count"] for r in status.groupBy("status").count().collect()}
    result.unchanged, result.deleted = counts.get("unchanged", 0), counts.get("missing", 0)
    gone = status.where("status = 'missing'").select("source_key")
    if result.deleted:
        touched = True
        buckets |= buckets_of(gone, number)
        sources = sources.join(gone, "source_key", "left_anti")
    if not maintenance.vanished(theirs, table).isEmpty():
        touched = True
        errors = errors.where(~seen).unionByName(theirs.join(table.select("source_key"), "source_key", "left_semi").select(*errors.columns))
    todo = {r["source_key"] for r in status.where("status in ('new', 'changed')").select("source_key").collect()} if counts.get("new") or counts.get("changed") else set()
    status.unpersist()
    for harness, those in found.items():
        those = [s for s in those if s["source_key"] in todo]
        if not those:
            continue
        parsed = adapters.parse(spark, harness, those)
        warned = parsed.warnings.select("source_key", F.lit(harness).alias("harness"), "path", F.col("message").alias("error"), F.lit(stamp).alias("created_at"))
        said = cut(parsed.errors.select("*", F.lit(stamp).alias("created_at"), F.lit(True).alias("failed")).unionByName(warned.withColumn("failed", F.lit(False))))
        n_failed, n_said = said.agg(F.coalesce(F.sum(F.col("failed").cast("int")), F.lit(0)), F.count("*")).first()
        good = table.join(parsed.sessions.select("source_key").distinct(), "source_key", "left_semi")
        result.errors += n_said
        result.updated += len(those) - n_failed
        if len(those) > n_failed or not said.join(theirs.select("source_key", "error"), ["source_key", "error"], "left_anti").isEmpty():
            touched = True
        buckets |= buckets_of(good, number)
        errors = errors.join(good.select("source_key"), "source_key", "left_anti")
        errors = maintenance.record_errors(errors, said.drop("failed"))
        sources = maintenance.upsert(sources, good.withColumn("indexed_at", F.lit(stamp)), "source_key")
        # two sources with one session: the later path owns it
        new_sessions = parsed.sessions.withColumn("generation", F.lit(stamp))
        new_sessions = chunking.last_writer(new_sessions.select(*schemas.names(schemas.SESSIONS)), "source_path", "session_key")
        sessions = maintenance.upsert(sessions, new_sessions, "session_key")
        made = chunking.chunk_entries(parsed.entries).withColumn("generation", F.lit(stamp))
        made = made.withColumn("embedding", F.lit(None).cast("array<float>")).withColumn("embedding_fingerprint", F.lit(""))
        made = chunking.last_writer(made.select(*schemas.names(schemas.CHUNKS), "ord"), "ord").drop("ord")
        chunks = maintenance.upsert(chunks, made, "chunk_key", keep=("embedding", "embedding_fingerprint"), same="text_hash")
        chunks = maintenance.delete_stale(chunks, good.select("source_key", F.lit(stamp).alias("generation")), "source_key")
    if touched:
        sessions = maintenance.cascade(sessions, sources, "source_key")
        # of a re-read source only the sessions it still has; a session may have moved to another source
        moved = old["sessions"].join(sessions.select("session_key", F.col("source_key").alias("_now")), "session_key").where("source_key <> _now")
        buckets |= buckets_of(moved, number)
        chunks = chunks.join(sessions.select("session_key", "source_key"), ["session_key", "source_key"], "left_semi")
        store.commit({"sources": sources, "sessions": sessions, "chunks": chunks, "parser_errors": errors}, {"last_indexed_at": str(stamp), **(meta or {})}, {"chunks": buckets})
    if provider is not None:
        chunks = store.read("chunks")
        waiting = buckets_of(maintenance.pending(chunks, provider.fingerprint), store.buckets("chunks"))
        table, result.embedded, result.embedding_error = embedding.backfill(chunks, provider, "chunk_key", "text", vectors)
        if result.embedded:
            store.commit({"chunks": table}, {"embedding_fingerprint": provider.fingerprint}, {"chunks": waiting})
    return result


def buckets_of(rows: DataFrame, number: int) -> set[int]:
    """The buckets of the chunks of these sources, of so many."""
    return {r[0] for r in rows.select(bucket_of("source_key", number)).distinct().collect()}


def refresh_memories(spark: SparkSession, store: Snapshot, records: RecordStore, provider: embedding.Provider | None = None, vectors: embedding.VectorStore | None = None) -> Result:
    """Mirror the record files in the index: changed files by hash, vanished ones
    deleted; an invalid file keeps its last good row."""
    scanned, warnings = records.scan(spark)
    scanned = scanned.cache()
    old = store.read("memories")
    good, bad = scanned.where(F.col("error").isNull()), scanned.where(F.col("error").isNotNull())
    warnings = [{"type": "invalid_record", "message": r["error"], "path": r["path"]} for r in bad.orderBy("path").collect()] + warnings
    known = old.select(F.col("canonical_path").alias("path"), F.col("content_hash").alias("version"))
    status = maintenance.version_diff(known, good.select("path", F.col("content_hash").alias("version")), "path").cache()
    kept = bad.select("path")
    gone = status.where("status = 'missing'").join(kept, "path", "left_anti")
    counts = {r["status"]: r["count"] for r in status.groupBy("status").count().collect()}
    result = Result(discovered=good.count(), updated=counts.get("new", 0) + counts.get("changed", 0), unchanged=counts.get("unchanged", 0), deleted=gone.count(), warnings=warnings)
    if result.updated or result.deleted:
        todo = good.join(status.where("status in ('new', 'changed')").select("path"), "path", "left_semi")
        todo = todo.withColumn("tokens", T.tokens(T.normalize(F.col("content"))))
        new = todo.select(
            "id", F.col("path").alias("canonical_path"), "content_hash", "current_revision", "content", "scope", "project_key", "project_remote", "project_name", "source", "created_at", "updated_at", "archived_at",
            "tokens", T.grams_of(F.col("tokens")).alias("grams"), F.lit(None).cast("array<float>").alias("embedding"), F.lit("").alias("embedding_fingerprint"), F.lit(now_ms()).alias("indexed_at"),
        )
        table = old.join(gone.select(F.col("path").alias("canonical_path")), "canonical_path", "left_anti").select(*old.columns)
        table = maintenance.upsert(table, new, "id", keep=("embedding", "embedding_fingerprint"), same="content")
        store.commit({"memories": table}, {"memories_indexed_at": str(now_ms())})
    if provider is not None:
        table, result.embedded, result.embedding_error = embedding.backfill(store.read("memories"), provider, "id", "content", vectors)
        if result.embedded:
            store.commit({"memories": table})
    return result
