r"""The trie of conversation prefixes, with totals of its subtrees by leaf peeling.

A node is a sequence of leading turns (role, text) that at least one conversation begins
with; the root is the empty sequence.  Two prefixes are the same node if their depth and
two 64-bit sums agree, of hashes of (position, role, text) that md5 makes; such sums are
running totals, so a conversation with a third of all rows is hashed by many tasks, and
no turn's text is ever shuffled.

Subtree totals come by message passing from the leaves.  A node with one child has
nothing to wait for but that child, so nodes are first put together to vertical paths:
a node is *owned* by the longest of its members (of equal ones the smallest id), which
reaches a leaf below it; the nodes that a conversation owns are a path that ends at that
leaf.  A path holds a counter of the paths hanging from its nodes that aren't finished;
with the counter at 0 it sends its totals (leaves, saved) to the path that its top hangs
from and lowers the counter there, until only the root's path finishes.  As the longest
goes on, a path is at least a turn longer than any that hangs from it, so k rounds take
k * k / 2 nodes at least; a conversation of 10,000 turns with a branch at every turn takes
two.  Messages keep the depth that they came in at, and a running total along each path
from its leaf upwards gives the totals of all its nodes.

Defined results: null roles and texts are empty; a null turn comes first, rows of equal
turns are ordered by the md5 of (role, text), repeated rows are turns of their own; rows
without a conversation id belong to no conversation and make no node; an empty table has
no node, not even a root; other columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.running import running_totals
from .common import cut

#: Characters of ids hashed at a time where a node's members lie in several tasks.
PIECE = 1 << 20

NODE = ("depth", "k1", "k2")


def _half(digest, first: int):
    """60 bits of a hexadecimal digest."""
    return F.conv(F.substring(digest, first, 15), 16, 10).cast("bigint")


def ordered_turns(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv_id, idx (from 0), t1 and t2 (hash of role and text), chars."""
    role_, text_ = F.coalesce(F.col(role), F.lit("")), F.coalesce(F.col(text), F.lit(""))
    narrow = rows.where(F.col(conv).isNotNull()).select(
        F.col(conv).cast("bigint").alias("conv_id"), F.col(turn).cast("bigint").alias("turn"), F.length(text_).cast("bigint").alias("chars"),
        F.md5(F.concat(F.octet_length(role_).cast("string"), F.lit(":"), role_, text_)).alias("digest"),
    )
    narrow = narrow.select("conv_id", "turn", "chars", _half(F.col("digest"), 1).alias("t1"), _half(F.col("digest"), 16).alias("t2"), F.lit(1).cast("bigint").alias("one"))
    return running_totals(narrow, ["conv_id"], ["turn", "t1", "t2"], {}, before={"idx": "one"}).select("conv_id", "idx", "t1", "t2", "chars")


def share_prefixes(turns: DataFrame, group: int = 100, most: int = 6) -> tuple[DataFrame, DataFrame]:
    """Conversations rebuilt: the first h turns of the first of their ``group``, then their own after their first h.

    Gives (conv_id, len) of all conversations and (conv_id, len, d, t1, t2, chars) of their turns, d from 1."""
    h = F.crc32(F.encode(F.col("conv_id").cast("string"), "UTF-8")) % most
    first = F.col("conv_id") - F.col("conv_id") % group
    counts = cut(turns.groupBy("conv_id").agg(F.count("*").alias("n")).select("conv_id", "n", h.alias("h"), first.alias("base")))
    # at most ``group`` conversations have the same base
    bases = counts.where("conv_id = base").select(F.col("conv_id").alias("base"), F.col("n").alias("n_base"))
    convs = counts.join(bases, "base", "left").withColumn("taken", F.least("h", F.coalesce("n_base", F.lit(0))))
    convs = cut(convs.select("conv_id", "h", "base", "taken", (F.col("taken") + F.greatest(F.lit(0), F.col("n") - F.col("h"))).alias("len")))
    heads = turns.where((F.col("conv_id") % group == 0) & (F.col("idx") < most)).withColumnRenamed("conv_id", "base")
    inherited = convs.where("h > 0").join(heads, "base").where("idx < h").select("conv_id", "len", (F.col("idx") + 1).alias("d"), "t1", "t2", "chars")
    own = turns.where(F.col("idx") >= h).join(convs, "conv_id").select("conv_id", "len", (F.col("taken") + F.col("idx") - F.col("h") + 1).alias("d"), "t1", "t2", "chars")
    return convs.select("conv_id", "len"), inherited.unionByName(own)


def whole_conversations(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The same of conversations as they are."""
    counts = cut(turns.groupBy("conv_id").agg(F.count("*").alias("len")))
    return counts, turns.join(counts, "conv_id").select("conv_id", "len", (F.col("idx") + 1).alias("d"), "t1", "t2", "chars")


def _nodes(convs: DataFrame, paths: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All nodes, and (depth, k1, k2, conv_id) of the conversations that end at them."""
    place = lambda salt: F.xxhash64(F.lit(salt), F.col("d"), F.col("t1"), F.col("t2"))
    paths = paths.withColumn("p1", place(1)).withColumn("p2", place(2)).drop("t1", "t2")
    paths = running_totals(paths, ["conv_id"], ["d"], {"k1": "p1", "k2": "p2"}, before={"b1": "p1", "b2": "p2"}).drop("p1", "p2").withColumnRenamed("d", "depth")
    longest = F.max(F.struct(F.col("len"), F.bitwise_not("conv_id").alias("no"))).alias("best")
    members = [F.count("*").alias("n_convs"), F.min("conv_id").alias("conv_id"), longest]
    nodes = paths.groupBy(*NODE).agg(*members, F.first("b1").alias("b1"), F.first("b2").alias("b2"), F.first("chars").alias("chars"))
    zero = F.lit(0).cast("bigint")
    root = convs.agg(*members).where("n_convs > 0").select(*(zero.alias(c) for c in NODE), "n_convs", "conv_id", "best", F.lit(None).cast("bigint").alias("b1"), F.lit(None).cast("bigint").alias("b2"), zero.alias("chars"))
    nodes = nodes.select(root.columns).unionByName(root)
    nodes = nodes.select(*NODE, "b1", "b2", "conv_id", "n_convs", ((F.col("n_convs") - 1) * F.col("chars")).alias("own_saved"), F.bitwise_not("best.no").alias("owner"), (F.col("depth") == F.col("best.len")).alias("childless"))
    ends = paths.where("depth = len").select(*NODE, "conv_id").unionByName(convs.where("len = 0").select(*(zero.alias(c) for c in NODE), "conv_id"))
    return cut(nodes), ends


def _with_parents(nodes: DataFrame) -> DataFrame:
    """parent_conv_id and parent_owner; a parent of very many children is a side of the join that Spark can split."""
    above = nodes.select(F.col("depth").alias("p_depth"), F.col("k1").alias("p_k1"), F.col("k2").alias("p_k2"), F.col("conv_id").alias("parent_conv_id"), F.col("owner").alias("parent_owner"))
    on = (F.col("depth") - 1 == F.col("p_depth")) & (F.col("b1") == F.col("p_k1")) & (F.col("b2") == F.col("p_k2"))
    below = nodes.where("depth > 0").join(above, on).drop("p_depth", "p_k1", "p_k2", "b1", "b2")
    root = nodes.where("depth = 0").drop("b1", "b2").withColumn("parent_conv_id", F.lit(None).cast("bigint")).withColumn("parent_owner", F.lit(None).cast("bigint"))
    return cut(below.unionByName(root))


def peel(paths: DataFrame) -> DataFrame:
    """Messages (up, at, leaves, saved) of all paths (path, up, at, saved); ``up`` is null of the root's path, whose message is the last.

    A round takes the paths whose counter is 0; the others stay, with what these send them."""
    waiting = paths.where("up is not null").groupBy("up").agg(F.count("*").alias("waiting")).withColumnRenamed("up", "path")
    state = cut(paths.join(waiting, "path", "left").select("path", "up", "at", "saved", F.lit(1).cast("bigint").alias("leaves"), F.coalesce("waiting", F.lit(0)).alias("waiting")))
    sent = []
    while True:
        done = state.where("waiting = 0").select("up", "at", "leaves", "saved")
        sent.append(done)
        rest = state.where("waiting > 0")
        if rest.isEmpty():
            return reduce(DataFrame.unionByName, sent)
        got = done.groupBy("up").agg(F.count("*").alias("n"), F.sum("leaves").alias("more_leaves"), F.sum("saved").alias("more_saved")).withColumnRenamed("up", "path")
        nought = lambda c: F.coalesce(F.col(c), F.lit(0))
        state = cut(rest.join(got, "path", "left").select("path", "up", "at", (F.col("saved") + nought("more_saved")).alias("saved"), (F.col("leaves") + nought("more_leaves")).alias("leaves"), (F.col("waiting") - nought("n")).alias("waiting")))


_PIECES = "depth bigint, k1 bigint, k2 bigint, seq bigint, done boolean, ids string"


def hash_members(ends: DataFrame) -> DataFrame:
    """depth, k1, k2, ends_sha256: SHA-256 over each node's ids, in order, with commas.

    Rows are dealt by ranges of (node, id), so a node where a third of all conversations
    end lies in many tasks; each makes its part of the string, and the parts are hashed in
    order with a running state.  A node that lies in one task is finished there."""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, ids, size, seq, first = None, [], 0, 0, True
        out: list[tuple] = []

        def close(last: bool) -> None:
            nonlocal ids, size, seq, first
            text = ",".join(ids)
            done = last and not first and not seq
            out.append((*node, seq, done, hashlib.sha256(text.encode()).hexdigest() if done else text))
            ids, size, seq = [], 0, seq + 1

        def flush() -> pa.RecordBatch:
            kinds = [pa.int64()] * 4 + [pa.bool_(), pa.string()]
            made = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=["depth", "k1", "k2", "seq", "done", "ids"])
            out.clear()
            return made

        for batch in batches:
            for *key, conv in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if node != key:
                    if node is not None:
                        close(True)
                        first = False
                    node, seq = key, 0
                elif size > PIECE:
                    close(False)
                ids.append(str(conv))
                size += len(ids[-1]) + 1
            if len(out) > 2000:
                yield flush()
        if node is not None:
            close(False)
        if out:
            yield flush()

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, state = None, None
        out: list[tuple] = []

        def flush() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), [pa.int64()] * 3 + [pa.string()], strict=True)], names=["depth", "k1", "k2", "ends_sha256"])
            out.clear()
            return made

        for batch in batches:
            for d, k1, k2, done, ids in zip(*(batch.column(c).to_pylist() for c in ("depth", "k1", "k2", "done", "ids")), strict=True):
                if done:
                    out.append((d, k1, k2, ids))
                elif (d, k1, k2) == node:
                    state.update(f",{ids}".encode())
                else:
                    if node is not None:
                        out.append((*node, state.hexdigest()))
                    node, state = (d, k1, k2), hashlib.sha256(ids.encode())
            if out:
                yield flush()
        if node is not None:
            out.append((*node, state.hexdigest()))
            yield flush()

    dealt = ends.repartitionByRange(*NODE, "conv_id").sortWithinPartitions(*NODE, "conv_id").select(*NODE, "conv_id")
    parts = dealt.mapInArrow(pieces, _PIECES).withColumn("task", F.spark_partition_id())
    return parts.repartition(*NODE).sortWithinPartitions(*NODE, "task", "seq").mapInArrow(join, "depth bigint, k1 bigint, k2 bigint, ends_sha256 string")


def prefix_trie(convs: DataFrame, paths: DataFrame) -> DataFrame:
    """A row a node: conv_id (its smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    ``convs`` and ``paths`` are what :func:`share_prefixes` or :func:`whole_conversations` give."""
    nodes, ends = _nodes(convs, paths)
    tree = _with_parents(nodes)
    top = F.col("parent_owner").isNull() | (F.col("parent_owner") != F.col("owner"))
    heads = tree.groupBy(F.col("owner").alias("path")).agg(F.max(F.when(top, F.col("parent_owner"))).alias("up"), F.max(F.when(top & F.col("parent_owner").isNotNull(), F.col("depth") - 1)).alias("at"), F.sum("own_saved").alias("saved"))
    sent = peel(heads).where("up is not null").groupBy(F.col("up").alias("owner"), F.col("at").alias("depth")).agg(F.count("*").alias("n_paths"), F.sum("leaves").alias("got_leaves"), F.sum("saved").alias("got_saved"))
    nought = lambda c: F.coalesce(F.col(c), F.lit(0))
    each = tree.join(sent, ["owner", "depth"], "left").select(
        *NODE, "owner", (-F.col("depth")).alias("rise"), "conv_id", "parent_conv_id", "n_convs", (nought("n_paths") + (~F.col("childless")).cast("bigint")).alias("n_children"),
        (nought("got_leaves") + F.col("childless").cast("bigint")).alias("leaves"), (F.col("own_saved") + nought("got_saved")).alias("saved"),
    )
    summed = running_totals(each, ["owner"], ["rise"], {"n_leaves": "leaves", "saved_tokens": "saved"})
    out = summed.join(hash_members(ends), list(NODE), "left")
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"))
