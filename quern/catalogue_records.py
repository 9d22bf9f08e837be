"""Queries over records (made of documents) and log lines (made of events)."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import corpora
from . import corpora_sql as S
from .functions import identity, vectors
from .operators import maintenance
from .plans import embedding
from .sources import jsonl

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


# --- log lines: an event a line, some of them broken ---------------------------------

LINES_SQL = """lines AS (SELECT user_id, event_id,
  row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS line_no, count(*) OVER (PARTITION BY user_id) AS n_lines, event_id % 11 = 0 AS broken FROM events)"""


def log_files(spark, d) -> DataFrame:
    """(user_id, body): a log per user; broken lines lack their end, and so does the file."""
    e = corpora.read(spark, d, "events")
    line = F.when(F.col("event_id") % 11 == 0, F.concat(F.lit('{"id": '), F.col("event_id").cast("string"))).otherwise(F.concat(F.lit('{"id": '), F.col("event_id").cast("string"), F.lit(', "props": '), F.col("props"), F.lit("}")))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("event_id", line.alias("line")))), lambda x: x["line"])
    return e.groupBy("user_id").agg(F.array_join(lines, "\n").alias("body"))


def decoded(spark, d, schema: str, rows_of) -> DataFrame:
    names = [c.split()[0] for c in schema.split(", ")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame([(u, *r) for u, b in zip(frame["user_id"], frame["body"], strict=True) for r in rows_of(b)], columns=names)

    return log_files(spark, d).mapInPandas(run, schema)


@query(f"WITH {LINES_SQL} SELECT user_id, event_id AS id, line_no FROM lines WHERE NOT broken")
def jsonl_salvage(spark, d):
    """The valid lines of tolerant reading, with their numbers."""
    return decoded(spark, d, "user_id bigint, id bigint, line_no bigint", lambda b: [(v["id"], n) for n, v, w in jsonl.decode_lines(b) if not w])


@query(f"WITH {LINES_SQL} SELECT user_id, 'ignored malformed JSONL line ' || line_no AS warning FROM lines WHERE broken AND line_no < n_lines")
def jsonl_warnings(spark, d):
    """Malformed lines; a malformed last line without an end is dropped in silence."""
    return decoded(spark, d, "user_id bigint, warning string", lambda b: [(w,) for _, _, w in jsonl.decode_lines(b) if w])


@query(f"WITH {LINES_SQL} SELECT user_id, count(*) FILTER (WHERE NOT broken) AS n_values FROM lines GROUP BY user_id")
def json_stream(spark, d):
    """Values of concatenated JSON, the broken lines left out and the file cut off at its end."""

    def values(body: str):
        whole = "".join(x for x in body.split("\n") if x.endswith("}"))
        return [(sum(1 for _ in jsonl.decode_stream(whole + '{"id": 1')),)]

    return decoded(spark, d, "user_id bigint, n_values bigint", values)


# --- records --------------------------------------------------------------------------


@query("SELECT doc_id, sha256(coalesce(text, '')) AS content_hash FROM documents")
def content_hash(spark, d):
    return corpora.read(spark, d, "documents").select("doc_id", identity.text_hash(F.coalesce("text", F.lit(""))).alias("content_hash"))




# --- more maintenance and record queries ---------------------------------------------


def weighted_sum(vector):
    """One number that every element of a vector takes part in."""
    return F.aggregate(F.transform(vector, lambda x, i: x.cast("double") * (i + 1)), F.lit(0.0), lambda a, x: a + x, lambda a: a)


@query("SELECT 'k' || user_id AS source_key, event_type AS harness, 'p' || user_id AS path, 'e' || event_id AS error, event_id AS created_at FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1")
def record_source_errors(spark, d):
    """Newest error per source."""
    u = F.col("user_id").cast("string")
    e = corpora.read(spark, d, "events").select(F.concat(F.lit("k"), u).alias("source_key"), F.col("event_type").alias("harness"), F.concat(F.lit("p"), u).alias("path"), F.concat(F.lit("e"), F.col("event_id").cast("string")).alias("error"), F.col("event_id").alias("created_at"))
    return maintenance.record_errors(e.where("created_at % 3 = 0"), e.where("created_at % 3 <> 0"))


@query(
    """SELECT doc_id, round(coalesce(list_sum(list_transform(e.embedding, lambda x, i: x::DOUBLE * i)), CASE WHEN doc_id % 2 = 0 THEN 7.0 END), 5) AS all_values,
  CASE WHEN e.embedding IS NOT NULL THEN 'new' WHEN doc_id % 2 = 0 THEN 'old' ELSE '' END AS embedding_fingerprint
FROM documents LEFT JOIN (SELECT * FROM embeddings WHERE vec_id % 3 = 0) e ON e.vec_id = doc_id"""
)
def update_embeddings(spark, d):
    old = F.col("doc_id") % 2 == 0
    table = corpora.read(spark, d, "documents").select("doc_id", F.when(old, F.array(F.lit(7.0)).cast("array<float>")).alias("embedding"), F.when(old, "old").otherwise("").alias("embedding_fingerprint"))
    made = corpora.read(spark, d, "embeddings").where("vec_id % 3 = 0").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vector"))
    out = maintenance.update_embeddings(table, made, "doc_id", "new")
    return out.select("doc_id", F.round(weighted_sum("embedding"), 5).alias("all_values"), "embedding_fingerprint")


class LengthProvider:
    """A model for tests of the engine's own steps: a unit vector by the length of the text."""

    fingerprint = corpora.FINGERPRINT

    def embed_query(self, text: str) -> list[float]:
        turn = math.radians(len(text) % 90)
        return [math.cos(turn), math.sin(turn)]

    def embed_documents(self, texts: list[str]) -> list[list[float]]:
        return [self.embed_query(t) for t in texts]


@query(
    f"""WITH {S.MEMORIES} SELECT id, embedding IS NULL AS made, len(embedding) IS NULL OR len(embedding) = 64 AS fits,
  round(CASE WHEN embedding IS NULL THEN cos(radians(length(text) % 90))::FLOAT::DOUBLE + 2 * sin(radians(length(text) % 90))::FLOAT::DOUBLE END, 5) AS all_values FROM memories"""
)
def embedding_backfill(spark, d):
    """Rows without a vector get one, the others keep theirs."""
    out, _, _ = embedding.backfill(corpora.memories(spark, d).select("id", "text", "embedding", "embedding_fingerprint"), LengthProvider(), "id", "text")
    made = F.size("embedding") == 2
    return out.select("id", made.alias("made"), (made | (F.size("embedding") == 64)).alias("fits"), F.round(F.when(made, weighted_sum("embedding")), 5).alias("all_values"))


@query("SELECT vec_id, '' AS embedding_fingerprint, true AS cleared FROM embeddings")
def clear_embeddings(spark, d):
    t = corpora.read(spark, d, "embeddings").withColumn("embedding_fingerprint", F.lit("f"))
    return maintenance.clear_embeddings(t).select("vec_id", "embedding_fingerprint", F.col("embedding").isNull().alias("cleared"))


@query(
    """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: (3 * x)::FLOAT::DOUBLE) AS v FROM embeddings),
n AS (SELECT vec_id, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS norm FROM v)
SELECT vec_id, round(list_sum(list_transform(v, lambda x, i: (x / norm)::FLOAT::DOUBLE * i)), 4) AS all_values FROM n"""
)
def l2_normalize(spark, d):
    v = F.transform("embedding", lambda x: (x * 3).cast("float"))
    return corpora.read(spark, d, "embeddings").select("vec_id", F.round(weighted_sum(vectors.normalized(v)), 4).alias("all_values"))


@query(f"WITH {S.MEMORIES} SELECT row_number() OVER (ORDER BY updated_at DESC, id) AS nth, id, updated_at FROM memories WHERE archived_at IS NULL")
def list_memories(spark, d):
    """All records that aren't archived, the newest first."""
    from .catalogue import number_rows

    m = corpora.memories(spark, d).where("archived_at is null").select("id", "updated_at", (-F.col("updated_at")).alias("age"))
    return maintenance.newest_first(number_rows(m, "age", "id")).select((F.col("nth") + 1).cast("bigint").alias("nth"), "id", "updated_at")
