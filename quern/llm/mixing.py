"""Mixing sources to target weights with Sainte-Laguë apportionment.

Targets: sources by code point, null last, take the weights 5, 2, 1 in turn and
share all words; a target stops at three times its source's size, and what is
over is shared again by weight until none is above.

Apportionment: the mix consists of blocks of equal tokens.  The k-th block goes
to the source with the highest quotient target / (2 a + 1), a being the blocks
it has so far (Sainte-Laguë).  The blocks are dealt in that order to the shards
of the mix, equally many to each, so a source gets an integer quota in every
shard and every shard has the same proportions.

Block selection: a source's documents stand in a seeded order (md5 of seed and
id) and are cut into blocks along their running word count.  A quota of q blocks
takes every block ``q // n`` times and the leading ``q % n`` blocks of the
seeded order once more.  A document's ``taken`` is the number of its words in
taken blocks, repeats counted, so at most three times its size.  The taken blocks
go to the shards of the mix in that order, each shard taking its quota of the
source: ``mix_shard`` is the shard of a document's first taken word, and
:func:`deal` gives every document's words shard by shard.

Per-source totals are one row a source and go to the driver, like the targets
that come back; nothing else does.  Running counts are made per bucket of the
seeded order, with bucket totals summed up per source, so that a source with a
third of all rows is no single task.

Defined results: a null text has size 0, and size 0 takes 0; the null source is
a source of its own, ordered last; rows with equal id and text are separate
documents; an empty table gives no rows; other columns are not looked at.
"""

from __future__ import annotations

import heapq
import itertools
from collections.abc import Iterable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, cut

WEIGHTS = (5, 2, 1)
MOST = 3
BLOCK_TOKENS = 16
SHARDS = 24
SEED = "mix-1"
#: A bucket of a source's order holds about 1/2048 of all rows, within these limits.
BUCKET_ROWS = (256, 200_000)
#: Bucket offsets that may be broadcast, some 60 bytes each.
MOST_BUCKETS = 200_000


def targets(sizes: list[int], weights: Iterable[float], most: float = MOST) -> list[float]:
    """Share ``sum(sizes)`` by weight, at most ``most`` times each size."""
    weights = list(weights)
    out = [0.0] * len(sizes)
    open_ = [i for i in range(len(sizes)) if sizes[i] > 0]
    left = float(sum(sizes))
    while open_:
        unit = left / sum(weights[i] for i in open_)
        over = [i for i in open_ if weights[i] * unit >= most * sizes[i]]
        if not over:
            for i in open_:
                out[i] = weights[i] * unit
            break
        for i in over:
            out[i] = float(most * sizes[i])
            left -= out[i]
        gone = set(over)
        open_ = [i for i in open_ if i not in gone]
    return out


def sainte_lague(shares: list[float], seats: int) -> list[int]:
    """Seats by highest quotients share / (2 a + 1); ties go to the earlier one.

    All but a few seats are given at once (a floor that the rule surely
    reaches), the rest one by one from a heap.
    """
    total = sum(shares)
    if not total or seats <= 0:
        return [0] * len(shares)
    # quotients above this bound all win: at bound x a share holds floor(s / x / 2 + 1 / 2) seats
    bound = 0.5 * total / max(0.5, seats - len(shares) / 2 - 1) if seats > len(shares) else None
    got = [int(s / (2 * bound) + 0.5) if bound else 0 for s in shares]
    while sum(got) > seats:  # rounding: take back the lowest quotients
        i = min((i for i in range(len(got)) if got[i]), key=lambda i: (shares[i] / (2 * got[i] - 1), -i))
        got[i] -= 1
    heap = [(-s / (2 * g + 1), i) for i, (s, g) in enumerate(zip(shares, got, strict=True)) if s > 0]
    heapq.heapify(heap)
    for _ in range(seats - sum(got)):
        _, i = heap[0]
        got[i] += 1
        heapq.heapreplace(heap, (-shares[i] / (2 * got[i] + 1), i))
    return got


def shard_quotas(shares: list[float], seats: int, shards: int = SHARDS) -> list[list[int]]:
    """quotas[shard][source]: the order of the apportionment dealt equally to the shards."""
    marks = [sainte_lague(shares, seats * (j + 1) // shards) for j in range(shards)]
    return [[b - a for a, b in zip(old, new, strict=True)] for old, new in zip([[0] * len(shares), *marks], marks, strict=False)]


def plan(sizes: list[int], weights: tuple[float, ...] = WEIGHTS, block: int = BLOCK_TOKENS, most: int = MOST, shards: int = SHARDS) -> list[dict]:
    """Targets and quotas of the sources, listed in their order.

    A source at its limit gets ``most`` times its blocks; the others share the
    remaining blocks of the mix.
    """
    goal = targets(sizes, [weights[i % len(weights)] for i in range(len(sizes))], most)
    blocks = [-(-s // block) for s in sizes]
    full = [g >= most * s for g, s in zip(goal, sizes, strict=True)]
    free = [0.0 if f else g for f, g in zip(full, goal, strict=True)]
    seats = round(sum(free) / block)
    per_shard = shard_quotas(free, seats, shards)
    quota = [most * n if f else min(most * n, sum(s[i] for s in per_shard)) for i, (n, f) in enumerate(zip(blocks, full, strict=True))]
    out = []
    for i, (s, g, n, q, f) in enumerate(zip(sizes, goal, blocks, quota, full, strict=True)):
        dealt = [q * (j + 1) // shards - q * j // shards for j in range(shards)] if f else [x[i] for x in per_shard]
        upto = [min(q, at) for at in itertools.accumulate(dealt)]  # taken blocks of the source up to each shard's end
        out.append({"size": s, "target": g, "blocks": n, "quota": q, "upto": upto})
    return out


def count_words(col):
    return F.regexp_count(F.coalesce(col, F.lit("")), F.lit(WORD)).cast("bigint")


def mix(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = WEIGHTS, block: int = BLOCK_TOKENS, most: int = MOST, shards: int = SHARDS, seed: str = SEED, bucket_rows: tuple[int, int] = BUCKET_ROWS, carry: bool = False) -> DataFrame:
    """doc_id, source, size, source_size, target, taken, mix_shard, and with ``carry``
    ``row``, a struct of all columns, and ``place``, what :func:`deal` needs."""
    spark = docs.sparkSession
    columns = (
        F.col(id_col).alias("doc_id"),
        F.col(source_col).alias("source"),
        count_words(F.col(text_col)).alias("size"),
        F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("-")))).alias("key"),
        F.md5(F.coalesce(F.col(text_col), F.lit(""))).alias("tie"),
    )
    narrow = cut(docs.select(*columns))  # all totals come from these: with ``carry`` the text is read twice, else once
    found = narrow.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("n")).collect()
    found.sort(key=lambda r: (r["source"] is None, (r["source"] or "").encode("utf-8", "surrogatepass")))
    planned = plan([r["size"] for r in found], weights, block, most, shards)
    # hex digits of the seeded key that name a bucket: 16**d buckets of about bucket_rows
    rows_each = min(bucket_rows[1], max(bucket_rows[0], sum(r["n"] for r in found) // 2048))
    digits = [0 if r["n"] <= rows_each else min(8, len(f"{r['n'] // rows_each:x}")) for r in found]
    table = spark.createDataFrame(
        [(r["source"], p["size"], p["target"], p["blocks"], p["quota"], p["upto"], d) for r, p, d in zip(found, planned, digits, strict=True)],
        "s string, source_size bigint, target double, blocks bigint, quota bigint, upto array<bigint>, digits int",
    )
    small = len(found) <= 100_000  # a row of about 300 bytes a source
    keyed = lambda rows: rows.join(F.broadcast(table) if small else table, F.col("source").eqNullSafe(F.col("s"))).withColumn("bucket", F.expr("substring(key, 1, digits)"))
    upto = Window.partitionBy("s").orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    first = keyed(narrow).groupBy("s", "bucket").agg(F.sum("size").alias("b_size")).withColumn("b_before", F.sum("b_size").over(upto) - F.col("b_size"))
    first = first.select(F.col("s").alias("f_s"), F.col("bucket").alias("f_bucket"), "b_before")
    # offsets of at most so many buckets are broadcast, then rows are shuffled once, for the window
    if sum(16**d for d in digits) <= MOST_BUCKETS:
        first = F.broadcast(first)
    in_bucket = Window.partitionBy("s", "bucket").orderBy("key", "tie", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = docs.select(*columns, F.struct("*").alias("row")) if carry else narrow
    out = keyed(rows).withColumn("own", F.sum("size").over(in_bucket) - F.col("size"))
    out = out.join(first, F.col("s").eqNullSafe(F.col("f_s")) & (F.col("bucket") == F.col("f_bucket")))
    begin = F.col("b_before") + F.col("own")
    lead = (F.col("quota") % F.greatest(F.col("blocks"), F.lit(1))) * F.lit(block)  # words of the blocks taken once more
    more = F.greatest(F.lit(0), F.least(begin + F.col("size"), lead) - begin)
    rounds = F.floor(F.col("quota") / F.greatest(F.col("blocks"), F.lit(1)))
    out = out.withColumn("taken", (rounds * F.col("size") + more).cast("bigint")).withColumn("begin", begin)
    first = F.expr(f"size(filter(upto, x -> x <= begin div {block}))")
    out = out.withColumn("mix_shard", F.when(F.col("taken") > 0, first))
    place = F.struct("begin", "blocks", "quota", "upto", F.lit(block).alias("block")).alias("place")
    return out.select("doc_id", "source", "size", "source_size", "target", "taken", "mix_shard", *(["row", place] if carry else []))


def deal(mixed: DataFrame, text_col: str = "text") -> DataFrame:
    """The words of the mix by shard: shard, doc_id, source, round, from_word, n_words
    and their text.  Takes what ``mix(..., carry=True)`` returns; a document whose
    blocks fall into several shards, or are taken more than once, has several rows."""
    names = ("begin", "blocks", "quota", "upto", "block")
    m = mixed.where("taken > 0").select("doc_id", "source", "size", *[F.col(f"place.{n}").alias(n) for n in names], F.col(f"row.`{text_col}`").alias("text"))
    m = m.withColumn("round", F.explode(F.expr("sequence(0L, quota div blocks)")))
    # the shards' ends in words of this round of the source's order
    m = m.withColumn("ends", F.expr("transform(upto, x -> greatest(0L, least(blocks, x - round * blocks)) * block)"))
    m = m.withColumn("part", F.expr("""filter(transform(ends, (e, i) -> struct(i as shard,
        greatest(begin, if(i = 0, 0L, ends[i - 1])) - begin as from_word,
        least(begin + size, e) - greatest(begin, if(i = 0, 0L, ends[i - 1])) as n_words)), x -> x.n_words > 0)"""))
    m = m.select("doc_id", "source", "round", "text", F.inline("part"))
    pieces = F.regexp_extract_all("text", F.lit(WORD), F.lit(0))
    words = F.array_join(F.slice(pieces, (F.col("from_word") + 1).cast("int"), F.col("n_words").cast("int")), " ")
    return m.select("shard", "doc_id", "source", "round", "from_word", "n_words", words.alias("text"))


def emit(mixed: DataFrame, text_col: str = "text") -> DataFrame:
    """The documents of the mix: whole copies, then a copy of the leading words
    that are left.  Takes what ``mix(..., carry=True)`` returns; columns as in ``row``."""
    n, left = F.expr("if(size = 0, 0, taken div size)"), F.expr("if(size = 0, 0, taken % size)")
    names = mixed.schema["row"].dataType.names
    parts = mixed.withColumn("n", n).withColumn("left", left).where("taken > 0")
    parts = parts.withColumn("lengths", F.expr("concat(array_repeat(-1L, cast(n as int)), if(left > 0, array(left), array()))"))
    each = parts.select("row", "left", F.explode("lengths").alias("length"))
    pieces = rf"regexp_extract_all(row.`{text_col}`, '[\\x20\\x09-\\x0D]*{WORD}', 0)".replace(WORD, WORD.replace("\\", "\\\\"))
    head = F.expr(f"array_join(slice({pieces}, 1, cast(length as int)), '')")
    text = F.when(F.col("length") < 0, F.col(f"row.{text_col}")).otherwise(head)
    each = each.withColumn("new_text", text)
    cols = []
    for c in names:
        if c == text_col:
            cols.append(F.col("new_text").alias(c))
        elif c == "n_chars":
            cols.append(F.when(F.col("length") < 0, F.col("row.n_chars")).otherwise(F.char_length("new_text")).cast(mixed.schema["row"].dataType["n_chars"].dataType).alias(c))
        else:
            cols.append(F.col(f"row.`{c}`"))
    return each.select(*cols)
