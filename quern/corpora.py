"""The engine's tables as views of the driver's tables.

conversations stand for sessions and their entries, documents for memories,
embeddings for vectors; :mod:`quern.corpora_sql` has the same views in SQL.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import text as T
from .operators import chunking
from .operators.filters import path_key
from .operators.lineage import spread

FINGERPRINT = "table:v1"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of users and assistants."""
    rows = read(spark, sf_dir, "conversations").where(F.col("role").isin("user", "assistant"))
    return said(rows)


def said(rows: DataFrame) -> DataFrame:
    return rows.select(
        F.concat(F.lit("e"), F.col("conv_id").cast("string"), F.lit("-"), F.col("turn").cast("string")).alias("entry_key"),
        F.concat(F.lit("s"), F.col("conv_id").cast("string")).alias("session_key"), "conv_id", "turn", "role", T.text_or_empty(F.col("text")).alias("text"),
    )


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = entries(spark, sf_dir).groupBy("conv_id", "session_key").agg(
        F.min_by("text", F.when(F.col("role") == "user", F.col("turn"))).alias("first_user"), F.min("turn").alias("first_turn"), F.max("turn").alias("last_turn")
    )
    return rows.select(
        "session_key", F.concat(F.lit("conv-"), F.col("conv_id").cast("string")).alias("native_id"),
        F.element_at(F.array(*[F.lit(h) for h in ("pi", "codex", "opencode", "claude")]), (F.col("conv_id") % 4 + 1).cast("int")).alias("harness"),
        F.concat(F.lit("/work/p"), (F.col("conv_id") % 5).cast("string")).alias("cwd"), T.first_line_title(F.col("first_user")).alias("name"),
        F.concat(F.lit("topic"), (F.col("conv_id") % 3).cast("string")).alias("git_branch"),
        (F.col("conv_id") * 1000 + F.col("first_turn")).alias("started_at"), (F.col("conv_id") * 1000 + F.col("last_turn")).alias("updated_at"),
    ).withColumn("cwd_key", path_key(F.col("cwd")))


def chunks(spark: SparkSession, sf_dir: str, of_session: DataFrame | None = None, only: DataFrame | None = None) -> DataFrame:
    """Windows of the entries; the first window of an entry may have a vector.

    ``of_session`` (session_key, ...) gives them columns of their session, ``only`` (row_id) names the rows wanted."""
    # what entries are joined with comes before the windows are cut: keys have no nulls, no long text is
    # doubled, and neither words nor trigrams are shuffled
    vectors = read(spark, sf_dir, "embeddings").select(F.col("vec_id"), "embedding")
    turns = spread(read(spark, sf_dir, "conversations")).where(F.col("role").isin("user", "assistant"))
    own = said(turns)
    if only is not None:
        own = own.join(only.select(F.regexp_extract("row_id", "^(.*)-[0-9]+$", 1).alias("entry_key")).distinct(), "entry_key", "left_semi")
    with_vector = own.withColumn("vec_id", F.col("conv_id") * 8 + F.col("turn")).join(vectors, "vec_id", "left")
    others = [] if of_session is None else [c for c in of_session.columns if c != "session_key"]
    out = chunking.chunk_entries(with_vector if of_session is None else with_vector.join(of_session, "session_key")).withColumn("embedding", F.when(F.col("part") == 0, F.col("embedding")))
    row = F.concat(F.col("entry_key"), F.lit("-"), F.col("part").cast("string"))
    return out.select(row.alias("row_id"), "session_key", "entry_key", "part", "role", "text", "text_hash", "tokens", "grams", "embedding", F.when(F.col("embedding").isNotNull(), F.lit(FINGERPRINT)).otherwise("").alias("embedding_fingerprint"), *others)


def session_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions(spark, sf_dir).withColumn("group_key", F.col("session_key"))


def stored(rows: DataFrame) -> DataFrame:
    """Search rows are what indexing stores once and many channels read; here a
    cache (that spills, and is computed again where an executor is lost) stands for
    the table.  It also keeps filters on tokens from being pushed below the
    functions that make them, where every word asked for would tokenise anew."""
    return rows.persist(StorageLevel.MEMORY_AND_DISK)


def passing(rows: DataFrame) -> DataFrame:
    """Rows for a plan that reads their tokens once: made where they are read, kept nowhere."""
    return rows


def session_rows(spark: SparkSession, sf_dir: str, keep=stored, only: DataFrame | None = None) -> DataFrame:
    """Search rows: chunks with their session's columns and token arrays; ``keep`` as for :func:`memory_rows`.
    With ``only`` the rows that it has the row_id of, and perhaps others of their entries."""
    s = sessions(spark, sf_dir)
    s = s.select("session_key", "native_id", "harness", "cwd", "cwd_key", "updated_at", *[T.tokens(T.normalize(F.col(c))).alias(t) for t, c in (("t_name", "name"), ("t_cwd", "cwd"), ("t_native", "native_id"), ("t_branch", "git_branch"))])
    return keep(chunks(spark, sf_dir, s, only).withColumnRenamed("tokens", "t_content").withColumn("group_key", F.col("session_key")))


def memories(spark: SparkSession, sf_dir: str, documents: DataFrame | None = None) -> DataFrame:
    d = read(spark, sf_dir, "documents") if documents is None else documents
    return noted(d.join(note_vectors(spark, sf_dir), "doc_id", "left")).withColumn("embedding_fingerprint", F.coalesce("embedding_fingerprint", F.lit("")))


def note_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    print_ = F.when(F.col("embedding").isNotNull(), F.lit(FINGERPRINT)).otherwise("")
    return read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding", print_.alias("embedding_fingerprint"))


def noted(d: DataFrame) -> DataFrame:
    """Documents as notes, with the columns of their vectors where they have any."""
    is_global = F.col("doc_id") % 5 == 0
    vectors = [c for c in ("embedding", "embedding_fingerprint") if c in d.columns]
    return d.select(
        "doc_id", F.concat(F.lit("m_"), F.lpad(F.col("doc_id").cast("string"), 8, "0")).alias("id"), T.text_or_empty(F.col("text")).alias("text"),
        F.when(is_global, F.lit("global")).otherwise("project").alias("scope"), F.when(is_global, F.lit("")).otherwise(T.text_or_empty(F.col("source"))).alias("project_key"),
        T.text_or_empty(F.col("source")).alias("source"), F.when(F.col("doc_id") % 7 == 0, F.col("doc_id")).alias("archived_at"), F.col("doc_id").alias("updated_at"),
        *vectors,
    )


def memory_rows(spark: SparkSession, sf_dir: str, keep=stored) -> DataFrame:
    """Search rows of all notes; ``keep`` is what becomes of them, for plans that read them once nothing."""
    return keep(note_rows(memories(spark, sf_dir, spread(read(spark, sf_dir, "documents")))))


def memory_rows_alone(spark: SparkSession, sf_dir: str) -> DataFrame:
    """:func:`memory_rows` without vectors, kept nowhere."""
    return note_rows(noted(spread(read(spark, sf_dir, "documents"))))


def note_rows(m: DataFrame) -> DataFrame:
    return m.withColumn("t_content", T.tokens(T.normalize(F.col("text")))).select(
        F.col("id").alias("row_id"), F.col("id").alias("group_key"), "*", T.grams_of(F.col("t_content")).alias("grams"),
        *[T.tokens(T.normalize(F.col(c))).alias(t) for t, c in (("t_source", "source"), ("t_project", "project_key"), ("t_id", "id"))],
    )
