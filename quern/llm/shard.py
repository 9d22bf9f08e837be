"""Sharding by global byte-size prefix sums.

All rows are put in one global order; a row's prefix sum is the number of bytes
before it.  Cutting the line of bytes at equal targets gives contiguous shards
of near equal bytes.

The order is (hash of the text, hash of the id, id), so that equal texts are
neighbours.  The hashes are the leading 60 bits of md5, so any engine can say the
same order.  The prefix sums are made in two steps and never by one task: a row
belongs to a *bucket* of the order (the leading bits of the text's hash, and for
a text that fills more than its share also leading bits of the id's hash);
bucket totals are pre-aggregated on the map side and summed up (there are at
most 2 x ``buckets`` of them); inside a bucket a window gives the rest.

Equal texts stay together as one unit as long as the unit is no larger than the
largest single row or 1/64 of a shard's target, for then it can unbalance the
shards no more than a row may; larger groups are cut like any other rows.

Defined results: a null text has no bytes and counts as empty; null ids sort
first; repeated rows are different rows and each gets its own slot; with fewer
rows than shards some shards stay empty; an empty table gives no rows; columns
other than id and text are not looked at.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

SHARDS = 24
#: Rows that a bucket of the global order should hold, and the fewest and most buckets.
BUCKET_ROWS = 20_000
BUCKETS = (1024, 65_536)
#: Units of equal texts stay whole up to target / WHOLE bytes.
WHOLE = 64

#: Bits of the order's hashes.
HASH_BITS = 60


def order_hash(col: Column) -> Column:
    """The leading 60 bits of a string's md5."""
    return F.conv(F.substring(F.md5(col), 1, HASH_BITS // 4), 16, 10).cast("bigint")


def bits_for(rows: int, per_bucket: int = BUCKET_ROWS, limits: tuple[int, int] = BUCKETS) -> int:
    least, most = limits
    return max(1, (min(most, max(least, rows // per_bucket)) - 1).bit_length())


def placer(narrow: DataFrame, bits: int, total: int) -> Callable[[DataFrame], DataFrame]:
    """Puts rows in the global order of ``narrow`` (doc_id, size, h, k), which the bucket totals are made of.

    The function returned adds ``before`` (bytes), ``rank`` (rows), and of the row's group of
    equal texts ``g_before`` and ``g_bytes``, to the same rows, narrow or with more columns."""
    spark = narrow.sparkSession
    share = max(64, total >> bits)
    # at most 2**bits texts can have more rows than a bucket should, which bounds both collects
    large = {r["h"]: max(1, (r["count"] // share).bit_length()) for r in narrow.groupBy("h").count().where(F.col("count") > share).collect()}
    cuts = spark.createDataFrame([(h, n) for h, n in large.items()], "h bigint, part_bits int")
    # where a large text splits its bucket, the rows after it are a bucket of their own
    after = cuts.select(F.col("h").alias("big_h"), F.shiftright("h", HASH_BITS - bits).alias("b")).groupBy("b").agg(F.sort_array(F.collect_list("big_h")).alias("bigs"))
    key = ["b", "q", "is_big", "p"]

    def keyed(rows: DataFrame) -> DataFrame:
        out = rows.join(F.broadcast(cuts), "h", "left").withColumn("b", F.shiftright("h", HASH_BITS - bits))
        out = out.withColumn("is_big", F.col("part_bits").isNotNull()).withColumn("p", F.expr(f"if(part_bits is null, 0L, shiftright(k, {HASH_BITS} - part_bits))"))
        return out.join(F.broadcast(after), "b", "left").withColumn("q", F.expr("if(bigs is null, 0, size(filter(bigs, x -> x < h)))")).drop("bigs")

    found = sorted(keyed(narrow).groupBy(*key).agg(F.sum("size").alias("bytes"), F.count("*").alias("n")).collect(), key=lambda r: tuple(r[c] for c in key))
    table, at_bytes, at_rows = [], 0, 0
    start: dict[tuple, int] = {}
    size: dict[tuple, int] = {}
    for r in found:
        g = (r["b"], r["q"])
        if r["is_big"]:
            start.setdefault(g, at_bytes)
            size[g] = size.get(g, 0) + r["bytes"]
        table.append((*(r[c] for c in key), at_bytes, at_rows))
        at_bytes += r["bytes"]
        at_rows += r["n"]
    table = [(*x, start.get(x[:2]) if x[2] else None, size.get(x[:2]) if x[2] else None) for x in table]
    offsets = spark.createDataFrame(table, "b bigint, q int, is_big boolean, p bigint, b_bytes bigint, b_rows bigint, l_before bigint, l_bytes bigint")

    def place(rows: DataFrame) -> DataFrame:
        in_bucket = Window.partitionBy(*key).orderBy("h", "k", "doc_id", "size")
        of_text = Window.partitionBy(*key, "h")
        upto = in_bucket.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        out = keyed(rows).withColumn("own", F.sum("size").over(upto) - F.col("size")).withColumn("nth", F.row_number().over(in_bucket) - 1)
        out = out.withColumn("t_before", F.min("own").over(of_text)).withColumn("t_bytes", F.sum("size").over(of_text))
        out = out.join(F.broadcast(offsets), key)
        return out.select(
            *rows.columns,
            (F.col("b_bytes") + F.col("own")).alias("before"),
            (F.col("b_rows") + F.col("nth")).alias("rank"),
            F.coalesce(F.col("l_before"), F.col("b_bytes") + F.col("t_before")).alias("g_before"),
            F.coalesce(F.col("l_bytes"), F.col("t_bytes")).alias("g_bytes"),
        )

    return place


def shard_by_bytes(docs: DataFrame, shards: int = SHARDS, *, id_col: str = "doc_id", text_col: str = "text", carry: bool = False, bucket_rows: int = BUCKET_ROWS, buckets: tuple[int, int] = BUCKETS, whole: int = WHOLE) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot; with ``carry`` also ``row``, a struct of all columns of ``docs``."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    columns = (
        F.col(id_col).cast("bigint").alias("doc_id"),
        (F.octet_length(text) + F.lit(8)).cast("bigint").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
        order_hash(text).alias("h"),
        order_hash(F.coalesce(F.col(id_col).cast("string"), F.lit("-"))).alias("k"),
    )
    narrow = cut(docs.select(*columns))  # all totals come from these: with ``carry`` the text is read twice, else once
    sums = narrow.agg(F.sum("size").alias("bytes"), F.max("size").alias("top"), F.count("*").alias("n")).first()
    target = max(1.0, (sums["bytes"] or 0) / shards)
    unit = max(sums["top"] or 0, int(target / whole))
    place = placer(narrow, bits_for(sums["n"], bucket_rows, buckets), sums["n"])
    # the middle of the unit decides, so a cut is never further away than half a unit
    middle = F.when(F.col("g_bytes") <= unit, F.col("g_before") + F.col("g_bytes") / 2).otherwise(F.col("before") + F.col("size") / 2)
    shard = F.least(F.lit(shards - 1), F.floor(middle / F.lit(target))).cast("int").alias("shard")
    placed = place(narrow).select("*", shard)
    first = placed.groupBy("shard").agg(F.min("rank").alias("first"))  # a row a shard
    if carry:
        placed = place(docs.select(*columns, F.struct("*").alias("row"))).select("*", shard)
    return placed.join(F.broadcast(first), "shard").select("doc_id", "size", "text_crc32", "shard", (F.col("rank") - F.col("first")).cast("bigint").alias("slot"), *(["row"] if carry else []))
