"""Embedding providers and the backfill of missing vectors."""

from __future__ import annotations

import hashlib
import json
import math
import urllib.parse
import urllib.request
from collections.abc import Iterator
from functools import reduce
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import maintenance
from ..operators.lineage import cut

BATCH = 32
#: Texts of a group, after which what is done is stored, and batches of a task.
GROUP, BATCHES = 100_000, 16
QUERY_PREFIX = "task: search result | query: "
DOCUMENT_PREFIX = "title: none | text: "


class Provider(Protocol):
    """What a provider offers; it travels to the executors."""

    fingerprint: str

    def embed_query(self, text: str) -> list[float]: ...

    def embed_documents(self, texts: list[str]) -> list[list[float]]: ...


def unit(vector) -> list[float]:
    """L2-normalised float32; the zero vector is an error."""
    v = np.asarray(vector, dtype=np.float32)
    n = math.sqrt(float((v.astype(np.float64) ** 2).sum()))
    if not n:
        raise ValueError("embedding has zero magnitude")
    return (v.astype(np.float64) / n).astype(np.float32).tolist()


class HashProvider:
    """Deterministic vectors without a model: signed counts of hashed words.  For tests."""

    def __init__(self, dimensions: int = 64):
        self.dimensions = dimensions
        self.fingerprint = f"hash:{dimensions}:v1"

    def _embed(self, text: str) -> list[float]:
        v = np.zeros(self.dimensions)
        for word in text.lower().split() or [""]:
            h = hashlib.sha256(word.encode()).digest()
            v[int.from_bytes(h[:4], "big") % self.dimensions] += 1 if h[4] & 1 else -1
        if not v.any():
            v[0] = 1
        return unit(v)

    def embed_query(self, text: str) -> list[float]:
        return self._embed(text)

    def embed_documents(self, texts: list[str]) -> list[list[float]]:
        return [self._embed(t) for t in texts]


class LoopbackProvider:
    """A model server on this machine with an ``/api/embed`` endpoint."""

    def __init__(self, url: str, model: str, timeout: float = 300):
        parts = urllib.parse.urlsplit(url)
        if parts.scheme not in ("http", "https") or parts.hostname not in ("localhost", "127.0.0.1", "::1"):
            raise ValueError("embedding URL must be a loopback http(s) address")
        if "embeddinggemma" not in model:
            raise ValueError("unsupported embedding model")
        self.url, self.model, self.timeout = url.rstrip("/"), model, timeout
        self.fingerprint = f"ollama:{model}:chunks-v2"

    def _embed(self, texts: list[str]) -> list[list[float]]:
        body = json.dumps({"model": self.model, "input": texts, "truncate": True}).encode()
        request = urllib.request.Request(f"{self.url}/api/embed", body, {"Content-Type": "application/json"})
        with urllib.request.urlopen(request, timeout=self.timeout) as answer:
            found = json.load(answer).get("embeddings") or []
        if len(found) != len(texts):
            raise ValueError(f"{len(found)} embeddings for {len(texts)} texts")
        if len({len(v) for v in found}) > 1 or (found and not found[0]):
            raise ValueError("embedding dimensions differ")
        return [unit(v) for v in found]

    def embed_query(self, text: str) -> list[float]:
        return self._embed([QUERY_PREFIX + text])[0]

    def embed_documents(self, texts: list[str]) -> list[list[float]]:
        return self._embed([DOCUMENT_PREFIX + t for t in texts])


class VectorStore:
    """Vectors by the hash of their text and the provider's fingerprint.

    Both corpora share it, and it outlives their indexes: a text that stands in many rows, or
    comes back after a rebuild, is embedded once.  Vectors are appended, a folder of Parquet files
    a fingerprint; a group of batches that is appended stays, whatever fails later."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _folder(self, fingerprint: str):
        path = f"{self.root}/{hashlib.sha256(fingerprint.encode()).hexdigest()[:16]}"
        place = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return path, place, place.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def read(self, fingerprint: str) -> DataFrame:
        """(text_hash, vector), one row a hash."""
        path, place, fs = self._folder(fingerprint)
        if not fs.exists(place):
            return self.spark.createDataFrame([], VECTORS)
        return self.spark.read.schema(VECTORS).parquet(path).dropDuplicates(["text_hash"])

    def append(self, fingerprint: str, vectors: DataFrame) -> None:
        vectors.select("text_hash", "vector").write.mode("append").parquet(self._folder(fingerprint)[0])

    def forget(self, fingerprint: str) -> None:
        _, place, fs = self._folder(fingerprint)
        fs.delete(place, True)


class Kept(VectorStore):
    """The same for one backfill only: nothing is stored beyond the plan's checkpoints."""

    def __init__(self, spark: SparkSession):
        self.spark, self.parts = spark, [spark.createDataFrame([], VECTORS)]

    def read(self, fingerprint: str) -> DataFrame:
        return reduce(DataFrame.unionByName, self.parts)

    def append(self, fingerprint: str, vectors: DataFrame) -> None:
        self.parts.append(vectors.select("text_hash", "vector"))


VECTORS = "text_hash string, vector array<float>"


def embed_texts(texts: DataFrame, provider: Provider, tasks: int, batch: int = BATCH) -> DataFrame:
    """(text_hash, vector, error) of texts (text_hash, body); a task stops at its first error."""
    schema = f"{VECTORS}, error string"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        size = None
        for frame in frames:
            for at in range(0, len(frame), batch):
                part = frame.iloc[at : at + batch]
                try:
                    vectors = provider.embed_documents(list(part["body"]))
                    if len(vectors) != len(part):
                        raise ValueError(f"{len(vectors)} embeddings for {len(part)} texts")
                    if size is not None and vectors and len(vectors[0]) != size:
                        raise ValueError(f"embedding dimensions changed from {size} to {len(vectors[0])}")
                    size = len(vectors[0]) if vectors else size
                except Exception as e:  # reported, not fatal: what is done stays
                    yield pd.DataFrame({"text_hash": [part["text_hash"].iloc[0]], "vector": [None], "error": [str(e)]})
                    return
                yield pd.DataFrame({"text_hash": list(part["text_hash"]), "vector": vectors, "error": None})

    return texts.repartition(tasks).mapInPandas(run, schema)


def backfill(table: DataFrame, provider: Provider, key: str, body: str, store: VectorStore | None = None, group: int = GROUP) -> tuple[DataFrame, int, str]:
    """The table with new vectors, how many rows got one, and the first error ('' if none).

    Distinct texts that the store doesn't have are embedded in groups; each group is stored before
    the next one is asked for, and as many tasks ask as it has batches for."""
    store = store or Kept(table.sparkSession)
    waiting = maintenance.pending(table, provider.fingerprint).select(key, F.sha2(F.coalesce(F.col(body), F.lit("")), 256).alias("text_hash"), F.coalesce(F.col(body), F.lit("")).alias("body"))
    known = store.read(provider.fingerprint)
    todo = cut(waiting.groupBy("text_hash").agg(F.min("body").alias("body")).join(known.select("text_hash"), "text_hash", "left_anti"))
    n = todo.count()
    size, error = known.select(F.size("vector").alias("size")).first(), ""
    groups = max(1, -(-n // group))
    for g in range(groups if n else 0):
        part = todo.where(F.pmod(F.xxhash64("text_hash"), F.lit(groups)) == g)
        made = cut(embed_texts(part, provider, max(1, -(-min(n, group) // (BATCH * BATCHES)))))  # the model is asked once
        sizes = {r[0] for r in made.where("vector is not null").select(F.size("vector")).distinct().limit(2).collect()} | ({size["size"]} if size else set())
        if len(sizes) > 1:
            error = "embedding dimensions differ"
            break
        size = size or ({"size": sizes.copy().pop()} if sizes else None)
        store.append(provider.fingerprint, made.where("vector is not null"))
        if failed := made.where("error is not null").orderBy("text_hash").select("error").first():
            error = failed["error"]
            break
    vectors = cut(waiting.select(key, "text_hash").join(store.read(provider.fingerprint), "text_hash").select(key, "vector"))
    return maintenance.update_embeddings(table, vectors, key, provider.fingerprint), vectors.count(), error
