"""Weighted reciprocal rank fusion of channels."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

K = 60
#: Channel weights, in the order of the channels.
WEIGHTS = (("exact", 4.0), ("lexical", 1.0), ("fuzzy", 1.0), ("semantic", 1.0))


def union(channels: dict[str, DataFrame]) -> DataFrame:
    """The channels as one bag with ``channel``, ``channel_ord`` and ``weight``."""
    parts = [channels[n].select(F.lit(n).alias("channel"), F.lit(i).alias("channel_ord"), F.lit(w).alias("weight"), "*") for i, (n, w) in enumerate(WEIGHTS) if n in channels]
    return reduce(DataFrame.unionByName, parts)


def ranked(rows: DataFrame, dedupe: bool, by: tuple[str, ...] = ()) -> DataFrame:
    """With ``rank``: a group's place among the groups of its channel, or just the row's."""
    if dedupe:
        first = Window.partitionBy(*by, "channel", "group_key").orderBy("pos")
        rows = rows.withColumn("nth", F.row_number().over(first)).where("nth = 1").drop("nth")
    place = Window.partitionBy(*by, "channel").orderBy("pos")
    rows = rows.withColumn("rank", F.row_number().over(place).cast("bigint"))
    return rows.withColumn("contribution", F.col("weight") / (K + F.col("rank")))


def fuse(channels: dict[str, DataFrame], limit: int, dedupe: bool, by: tuple[str, ...] = ()) -> DataFrame:
    """One row a group: score, its rank in each channel (null: not there), the text
    of its best row with any, similarity, and the combined ``rank``; all of it for each
    combination of the columns ``by``, such as a query."""
    rows = ranked(union(channels), dedupe, by)
    best = F.min_by(F.struct("row_id", "text"), F.struct((F.col("text") == "").alias("a"), (-F.col("contribution")).alias("b"), F.col("channel_ord").alias("c")))
    place = [F.min(F.when(F.col("channel") == n, F.col("rank"))).alias(f"{n}_rank") for n, _ in WEIGHTS]
    out = rows.groupBy(*by, "group_key").agg(
        F.round(F.sum("contribution"), 12).alias("score"), F.max("updated_at").alias("updated_at"), *place,
        F.min_by(F.when(F.col("channel") == "semantic", F.col("raw")), F.when(F.col("channel") == "semantic", F.col("rank"))).alias("similarity"), best.alias("best"),
    )
    order = (F.desc("score"), F.desc("updated_at"), F.col("group_key"))
    number = F.row_number().over(Window.partitionBy(*by).orderBy(*order)).cast("bigint")
    out = out.withColumn("rank", number).where(F.col("rank") <= limit) if by else out.orderBy(*order).limit(limit).withColumn("rank", number)
    return out.select(*by, "rank", "group_key", "score", "updated_at", *[f"{n}_rank" for n, _ in WEIGHTS], "similarity", F.col("best.row_id").alias("row_id"), F.col("best.text").alias("text"))
