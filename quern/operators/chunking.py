"""Overlapping word windows of long texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import identity, text

WORDS, OVERLAP = 250, 40


def let(value: Column, use) -> Column:
    """``use(value)`` with the value made once, however often ``use`` refers to it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def windows(body: Column, words: int = WORDS, overlap: int = OVERLAP) -> Column:
    """Windows of ``words`` words at steps of ``words - overlap``, inner white space
    kept; a text of no more words is one window as a whole; blank: none.

    The words are cut once a text, so the work is linear in its length."""
    if overlap >= words:
        overlap = words // 5
    step = words - overlap
    trimmed = F.regexp_replace(body, rf"^{text.BLANK}+|{text.BLANK}+$", "")
    pieces = F.regexp_extract_all(trimmed, F.lit(rf"{text.NOT_BLANK}+{text.BLANK}*"), F.lit(0))

    def cut(ws: Column) -> Column:
        n = F.size(ws)
        last = F.when(n <= words, F.lit(0)).otherwise(F.ceil((n - words) / F.lit(step)).cast("int"))
        one = lambda p: F.regexp_replace(F.array_join(F.slice(ws, p * step + 1, F.lit(words)), ""), rf"{text.BLANK}+$", "")
        return F.transform(F.sequence(F.lit(0), last), one)

    return F.when(F.coalesce(trimmed, F.lit("")) == "", F.array().cast("array<string>")).otherwise(let(pieces, cut))


def chunk_entries(entries: DataFrame, *, key: str = "entry_key", body: str = "text") -> DataFrame:
    """One row a window: ``part``, ``text``, ``chunk_key``, ``text_hash``, ``tokens``, ``grams``."""
    others = [c for c in entries.columns if c != body]
    parts = entries.select(*others, F.posexplode(windows(F.col(body))).alias("part", "text"))
    parts = parts.withColumn("tokens", text.tokens(text.normalize(F.col("text"))))
    return parts.select("*", identity.chunk_key(F.col(key), F.col("part")).alias("chunk_key"), identity.text_hash(F.col("text")).alias("text_hash"), text.grams_of(F.col("tokens")).alias("grams"))


def last_writer(chunks: DataFrame, order: str, key: str = "chunk_key") -> DataFrame:
    """Of the rows with one key, that with the greatest ``order``; by an aggregate, so
    rows are combined before the shuffle."""
    rest = [c for c in chunks.columns if c != key]
    best = chunks.groupBy(key).agg(F.max_by(F.struct(*rest), F.col(order)).alias("r"))
    return best.select(*[F.col(key) if c == key else F.col(f"r.{c}") for c in chunks.columns])
