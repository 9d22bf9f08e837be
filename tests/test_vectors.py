"""Vectors by content: each text is asked for once, and what is done before a failure stays."""

import os
import uuid

from pyspark.sql import functions as F

from quern.plans import embedding

from .test_engine import engine, log


class Counting:
    """Writes down what it is asked for; fails for texts with a word in them."""

    def __init__(self, folder, fails="", mark="counting:1", size=2):
        self.folder, self.fails, self.fingerprint, self.size = str(folder), fails, mark, size
        os.makedirs(self.folder, exist_ok=True)

    def embed_query(self, text):
        return [1.0] + [0.0] * (self.size - 1)

    def embed_documents(self, texts):
        if self.fails and any(self.fails in t for t in texts):
            raise OSError("out of service")
        with open(os.path.join(self.folder, uuid.uuid4().hex), "w") as f:
            f.write("\n".join(texts))
        return [[1.0] + [0.0] * (self.size - 1) for _ in texts]

    def asked(self):
        return sorted(t for name in os.listdir(self.folder) for t in open(os.path.join(self.folder, name)).read().split("\n"))


def rows(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "id int, text string").select(F.col("id").cast("string").alias("id"), "text", F.lit(None).cast("array<float>").alias("embedding"), F.lit("").alias("embedding_fingerprint"))


def test_distinct_texts_are_asked_once(spark, tmp_path):
    provider, store = Counting(tmp_path / "asked"), embedding.VectorStore(spark, str(tmp_path / "vectors"))
    out, n, error = embedding.backfill(rows(spark, ["a", "b", "a", "c", None, "a"]), provider, "id", "text", store)
    assert (n, error) == (6, "") and provider.asked() == ["", "a", "b", "c"]
    assert out.where("embedding_fingerprint = 'counting:1' and size(embedding) = 2").count() == 6
    _, n, _ = embedding.backfill(rows(spark, ["c", "d"]), provider, "id", "text", store)  # another corpus
    assert n == 2 and provider.asked() == ["", "a", "b", "c", "d"]
    other = Counting(tmp_path / "other", mark="counting:2")
    assert embedding.backfill(rows(spark, ["a"]), other, "id", "text", store)[1] == 1 and other.asked() == ["a"]


def test_a_failure_keeps_what_is_done(spark, tmp_path):
    """Groups before the failing one are stored; the next run asks for the rest only."""
    texts = [f"text {i}" for i in range(200)] + ["bad text"]
    provider, store = Counting(tmp_path / "asked", "bad"), embedding.VectorStore(spark, str(tmp_path / "vectors"))
    out, n, error = embedding.backfill(rows(spark, texts), provider, "id", "text", store, group=20)
    first = provider.asked()
    assert error == "out of service" and n == len(first) == out.where("embedding is not null").count() < 201
    mended = Counting(tmp_path / "asked")
    out, n, error = embedding.backfill(rows(spark, texts), mended, "id", "text", store, group=20)
    assert (n, error) == (201, "") and mended.asked() == sorted(texts)  # no text twice


def test_dimensions_must_agree(spark, tmp_path):
    store = embedding.VectorStore(spark, str(tmp_path / "vectors"))
    embedding.backfill(rows(spark, ["a"]), Counting(tmp_path / "x"), "id", "text", store)
    out, n, error = embedding.backfill(rows(spark, ["a", "b"]), Counting(tmp_path / "y", size=3), "id", "text", store)
    assert (n, error) == (1, "embedding dimensions differ") and out.where("embedding is null").count() == 1
    assert embedding.backfill(rows(spark, []), Counting(tmp_path / "z"), "id", "text", store)[1:] == (0, "")


def test_vectors_outlive_a_rebuild(spark, tmp_path):
    logs, provider = tmp_path / "logs", Counting(tmp_path / "asked")
    log(logs / "a.jsonl", "s", "words about an owl", "words about a boat")
    e = engine(spark, tmp_path, provider, pi=str(logs))
    e.remember("words about an owl", global_scope=True)
    sessions, _ = e.index()
    assert sessions.embedded == 2 and provider.asked() == ["words about a boat", "words about an owl"]
    again, notes = e.index(rebuild=True)
    assert (again.embedded, notes.embedded) == (2, 1) and len(provider.asked()) == 2
    assert e.index(reembed=True)[0].embedded == 2 and len(provider.asked()) == 4
