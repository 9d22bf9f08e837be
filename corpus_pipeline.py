"""A corpus pipeline of five stages over ``documents``.

Each stage is ``(spark, docs, sf_dir) -> DataFrame``; it is written as Parquet and
read again before the next one.  All but the last return the columns of
``documents``, extra ones included, in their order.

In every stage a null text counts as empty, texts of any length are read whole, repeated
rows are rows of their own, and an empty table gives no rows; what else is defined stands
at the stage and in its operator's module.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import decontam, mixing, quality, shard, simhash
from quern.llm.common import checkpoint_dir


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the compression bands reject go.

    Null, empty and blank texts fail the base rules.  The lower limits are learned from
    ``labels.quality``; without labels of both kinds they are the table's.  Of equal rows all
    stay or all go."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.keep_documents(docs, usual=quality.fit(docs, labels))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, that with the smallest id.

    Texts without words have the fingerprint zero and are one group like any other; a null id
    stays only where its group has no other; of rows of the smallest id one stays."""
    return simhash.keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents contaminated with benchmark items go.

    A document goes if a twentieth of its words or more lie in occurrences of items' windows;
    documents and items without words are never contaminated nor contaminate."""
    return decontam.clean_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them; of one at the edge of a quota, its leading words.

    A null source is a source of its own; documents without words take no part; ties of the
    seeded order are broken by the text's hash, so equal rows are interchangeable.  The column
    ``n_chars``, if there is one, is that of the words taken."""
    return mixing.emit(mixing.mix(docs, carry=True))


def shard_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with size, shard and slot.

    Equal texts stand together; null ids come first among them.  Columns of these three names
    that the documents bring along are replaced; all others stay."""
    out = shard.shard_by_bytes(docs, carry=True)
    own = [c for c in docs.columns if c not in ("size", "shard", "slot")]
    return out.select(*[F.col(f"row.`{c}`") for c in own], "size", "shard", "slot")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", quality_rules),
    ("SimHash near-dedup", near_dedup),
    ("benchmark decontamination", decontaminate),
    ("mixing sources", mix_sources),
    ("sharding", shard_documents),
]

#: Compression ratios and XXH64 fingerprints are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; intermediates go to the shared checkpoint folder, and
    each is removed once its successor is written, all of them if a stage fails.  The last
    one's stay there, for the rows returned are read from them."""
    checkpoint_dir(spark)
    at = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    try:
        for n, (_, stage) in enumerate(STAGES):
            path = f"{at}/{n}"
            stage(spark, docs, sf_dir).write.parquet(path)
            docs = spark.read.parquet(path)
            if n:
                remove(spark, f"{at}/{n - 1}")
    except Exception:
        remove(spark, at)
        raise
    return docs


def remove(spark: SparkSession, path: str) -> None:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
