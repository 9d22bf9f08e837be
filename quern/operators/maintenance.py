"""Incremental table maintenance: version diffs, upserts, deletes, counts.

All of it is joins and aggregates on the tables' keys; nothing is collected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def version_diff(stored: DataFrame, found: DataFrame, key: str = "source_key", version: str = "version") -> DataFrame:
    """(key, status): new, changed, unchanged or missing."""
    a = stored.select(F.col(key), F.col(version).alias("old"), F.lit(True).alias("was"))
    b = found.select(F.col(key), F.col(version).alias("new"), F.lit(True).alias("now"))
    both = a.join(b, key, "full_outer")
    status = (
        F.when(F.col("was").isNull(), F.lit("new"))
        .when(F.col("now").isNull(), F.lit("missing"))
        .when(F.col("old").eqNullSafe(F.col("new")), F.lit("unchanged"))
        .otherwise(F.lit("changed"))
    )
    return both.select(key, status.alias("status"))


def upsert(old: DataFrame, new: DataFrame, key: str, keep: tuple[str, ...] = (), same: str | None = None) -> DataFrame:
    """Rows by key, the new ones before the old; the columns ``keep`` of an old row
    stay where ``same`` (a hash, say) is equal in both."""
    cols = old.columns
    o = old.select(F.col(key), F.struct(*cols).alias("o"))
    n = new.select(F.col(key), F.struct(*cols).alias("n"))
    both = o.join(n, key, "full_outer")

    def value(c: str) -> Column:
        if c == key:
            return F.col(key)
        if c in keep:
            stays = F.col("o").isNotNull() & F.col(f"o.{same}").eqNullSafe(F.col(f"n.{same}"))
            return F.when(F.col("n").isNull() | stays, F.col(f"o.{c}")).otherwise(F.col(f"n.{c}"))
        return F.when(F.col("n").isNull(), F.col(f"o.{c}")).otherwise(F.col(f"n.{c}"))

    return both.select(*[value(c).alias(c) for c in cols])


def delete_missing(table: DataFrame, present: DataFrame, key: str = "source_key") -> DataFrame:
    return table.join(present.select(key).distinct(), key, "left_semi")


def cascade(children: DataFrame, parents: DataFrame, key: str) -> DataFrame:
    """The children whose parent is left."""
    return children.join(parents.select(key), key, "left_semi")


def delete_stale(table: DataFrame, sources: DataFrame, key: str = "source_key", generation: str = "generation") -> DataFrame:
    """Without the rows of re-read ``sources`` (key, generation) that are of another generation."""
    s = sources.select(F.col(key), F.col(generation).alias("_g"))
    kept = table.join(s, key, "left").where(F.col("_g").isNull() | (F.col(generation) == F.col("_g")))
    return kept.select(*table.columns)


def named_harnesses(*tables: DataFrame) -> DataFrame:
    """The harnesses that any of the tables names, once each."""
    found = tables[0].select("harness")
    for t in tables[1:]:
        found = found.union(t.select("harness"))
    return found.distinct()


def removed_harnesses(sources: DataFrame, errors: DataFrame, supported: tuple[str, ...]) -> DataFrame:
    return named_harnesses(sources, errors).where(~F.col("harness").isin(*supported))


def vanished(known: DataFrame, found: DataFrame, key: str = "source_key") -> DataFrame:
    """Keys that are known but no more found, once each."""
    return known.select(key).distinct().join(found.select(key).distinct(), key, "left_anti")


def sorted_errors(errors: DataFrame) -> DataFrame:
    """All errors by harness and path."""
    return errors.orderBy("harness", "path")


def newest_first(memories: DataFrame) -> DataFrame:
    """All records, the newest first, then by id."""
    return memories.orderBy(F.desc("updated_at"), "id")


def record_errors(errors: DataFrame, new: DataFrame) -> DataFrame:
    """Newest error per source."""
    cols = errors.columns
    rest = [c for c in cols if c != "source_key"]
    best = errors.unionByName(new.select(*cols)).groupBy("source_key").agg(F.max_by(F.struct(*rest), "created_at").alias("r"))
    return best.select("source_key", *[F.col(f"r.{c}").alias(c) for c in rest]).select(*cols)


def pending(table: DataFrame, fingerprint: str, vector: str = "embedding", mark: str = "embedding_fingerprint") -> DataFrame:
    """Rows without a vector of this provider."""
    return table.where(F.col(vector).isNull() | ~F.col(mark).eqNullSafe(F.lit(fingerprint)))


def update_embeddings(table: DataFrame, vectors: DataFrame, key: str, fingerprint: str) -> DataFrame:
    """Set the vectors given as (key, vector)."""
    v = vectors.select(key, F.col("vector").alias("_v"))
    out = table.join(v, key, "left")
    cols = [
        F.coalesce("_v", "embedding").alias(c) if c == "embedding" else F.when(F.col("_v").isNotNull(), F.lit(fingerprint)).otherwise(F.col(c)).alias(c) if c == "embedding_fingerprint" else F.col(c)
        for c in table.columns
    ]
    return out.select(*cols)


def clear_embeddings(table: DataFrame) -> DataFrame:
    return table.withColumn("embedding", F.lit(None).cast(table.schema["embedding"].dataType)).withColumn("embedding_fingerprint", F.lit(""))


def index_stats(sources: DataFrame, sessions: DataFrame, chunks: DataFrame, errors: DataFrame, fingerprint: str) -> DataFrame:
    """One row of counters."""
    done = F.col("embedding").isNotNull() & (F.col("embedding_fingerprint") == fingerprint)
    c = chunks.agg(F.count("*").alias("chunks"), F.count_if(done).alias("embedded"), F.count_if(~F.coalesce(done, F.lit(False))).alias("pending"))
    one = sources.agg(F.count("*").alias("sources")).crossJoin(sessions.agg(F.count("*").alias("sessions")))
    return one.crossJoin(c).crossJoin(errors.agg(F.count("*").alias("parser_errors")))


def memory_stats(memories: DataFrame, fingerprint: str) -> DataFrame:
    done = F.col("embedding").isNotNull() & (F.col("embedding_fingerprint") == fingerprint)
    return memories.agg(
        F.count_if(F.col("archived_at").isNull()).alias("active"), F.count_if(F.col("archived_at").isNotNull()).alias("archived"),
        F.count_if(done).alias("embedded"), F.count_if(~F.coalesce(done, F.lit(False))).alias("pending"),
    )
