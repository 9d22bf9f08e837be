"""Benchmark decontamination, in DataFrame functions only.

A *window* is 13 consecutive words of a benchmark item (an item of fewer words,
but not none, is one window).  The set of windows is a hash relation that is
broadcast to the scan of the training documents:

1. *Anchors.*  A window of w words holds exactly one run of k words that starts
   at a multiple of w - k + 1.  So a document hashes only its runs at those
   places (every ninth word for w = 13, k = 5) and looks them up in the broadcast
   set of all k-word runs of the items.  Documents without a known run can hold no
   window.  This step folds case with ``lower``, which is fast and folds more
   than A-Z, so it lets through at least what it must.
2. *Windows.*  The texts that remain, each once, are normalised exactly (A-Z only)
   and every window string is looked up in the set: whole strings are compared, so
   a hit is verified.  Hit windows give the covered words.
3. *Items.*  Windows with the same items share the number of an item set, so what is
   joined with items are the combinations of sets that texts have, not every text
   with every item.

Both relations are broadcast up to ``most_bytes``, measured before; a larger benchmark
is joined by shuffles, over the same steps.  Equal texts are one text throughout,
named by their MD5, so copies cost no more than one hash.

Defined results: a null or wordless text has no words, no hits, no items and is
not contaminated; a null item or one without words has no window; items with
equal windows are all reported, also with equal ids (once); repeated documents
get equal results; documents of any length are scanned whole; an empty table
gives no rows, an empty benchmark no hits; other columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

WINDOW = 13
#: Bytes of the windows, with what a hash relation adds, up to which they are broadcast.
MOST_BYTES, ROW_BYTES = 64 << 20, 64
#: Keys of texts that are broadcast, some 100 bytes each.
MOST_KEYS = 500_000

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What separates words once A-Z are lower-cased.
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The same on text in which A-Z may be left.
GAP_ANY_CASE = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.translate(text, UPPER, LOWER), GAP), "")


def folded_words(text: Column) -> Column:
    """As :func:`words` with all letters folded; positions are the same.

    The final sigma is put back, since its choice depends on the neighbours."""
    return F.array_remove(F.split(F.replace(F.lower(text), F.lit("ς"), F.lit("σ")), GAP), "")


def runs(ws: str, k: int, step: int = 1) -> Column:
    """Hashes of the k-word runs of the array column ``ws`` that start at multiples of ``step``."""
    starts = F.sequence(F.lit(1), F.size(ws) - F.lit(k - 1), F.lit(step))
    found = F.transform(starts, lambda i: F.xxhash64(F.concat_ws(" ", F.slice(ws, i, F.lit(k)))))
    return F.when(F.size(ws) >= k, found).otherwise(F.array().cast("array<bigint>"))


def run_length(w: int) -> int:
    """Words of an anchor of windows of w words."""
    return 5 if w == WINDOW else (w + 1) // 2


def windows_of(benchmark: DataFrame, id_col: str, text_col: str, w: int) -> DataFrame:
    """(item, m, win): the windows of all items, m being their length in words."""
    b = benchmark.select(F.col(id_col).cast("string").alias("item"), words(F.coalesce(F.col(text_col), F.lit(""))).alias("ws"))
    b = b.where(F.size("ws") > 0).withColumn("m", F.least(F.size("ws"), F.lit(w)))
    starts = F.sequence(F.lit(1), F.size("ws") - F.col("m") + 1)
    return b.select("item", "m", F.explode(F.transform(starts, lambda i: F.concat_ws(" ", F.slice("ws", i, F.col("m"))))).alias("win")).distinct()


def covered(hits: str) -> Column:
    """Words covered by an array of (pos, m) sorted by pos."""
    start = F.struct(F.lit(0).alias("upto"), F.lit(0).alias("n"))

    def step(a, x):
        end = F.greatest(a["upto"], x["pos"] + x["m"] - 1)
        return F.struct(end.alias("upto"), (a["n"] + F.greatest(F.lit(0), end - F.greatest(a["upto"], x["pos"] - 1))).alias("n"))

    return F.aggregate(hits, start, step)["n"].cast("bigint")


def window_positions(ws: str, m: int) -> Column:
    """(pos, m, win) of all windows of m words of the array column ``ws``."""
    starts = F.sequence(F.lit(1), F.size(ws) - F.lit(m - 1))
    made = F.transform(starts, lambda i: F.struct(i.alias("pos"), F.lit(m).alias("m"), F.concat_ws(" ", F.slice(ws, i, F.lit(m))).alias("win")))
    return F.when(F.size(ws) >= m, made).otherwise(F.array().cast("array<struct<pos:int,m:int,win:string>>"))


def small(df: DataFrame, most: int = MOST_KEYS) -> DataFrame:
    """Broadcast a checkpointed table if it has few rows; else joins shuffle it."""
    return F.broadcast(df) if df.count() <= most else df


def text_key(text: Column) -> Column:
    return F.md5(F.coalesce(text, F.lit("")))


def scan(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", w: int = WINDOW, most_bytes: int = MOST_BYTES) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(doc_id, key, n_words) of every document; (key, hits) of the texts with hits, hits being
    an array of (pos, m, set); and (set, items) of the benchmark."""
    wins = windows_of(benchmark, item_id, item_text, w)
    by_win = cut(wins.groupBy("m", "win").agg(F.sort_array(F.collect_set("item")).alias("items")).withColumn("set", F.md5(F.array_join("items", ","))))
    sizes = by_win.groupBy("m").agg(F.sum(F.octet_length("win") + F.lit(ROW_BYTES)).alias("bytes")).collect()  # at most w rows
    hint = F.broadcast if sum(r["bytes"] for r in sizes) <= most_bytes else lambda df: df
    lengths = sorted(r["m"] for r in sizes)

    folded = folded_words(F.coalesce(F.col(text_col), F.lit("")))
    rows = docs.select(F.col(id_col).alias("doc_id"), text_key(F.col(text_col)).alias("key"), folded.alias("ws"))
    places = [runs("ws", run_length(m), m - run_length(m) + 1) for m in lengths]
    none = F.array().cast("array<bigint>")
    rows = cut(rows.select("doc_id", "key", F.size("ws").cast("bigint").alias("n_words"), F.concat(none, *places).alias("runs")))

    known = None
    of = windows_folded(benchmark, item_text, w)
    for m in lengths:
        t = of.where(F.col("m") == m).select(F.explode(runs("ws", run_length(m))).alias("run"))
        known = t if known is None else known.unionByName(t)
    none = F.array().cast("array<struct<pos:int,m:int,set:string>>")
    if known is None:
        return rows.drop("runs"), rows.select("key", none.alias("hits")).where("false"), by_win.select("set", "items")
    suspects = rows.select("key", F.explode("runs").alias("run")).join(hint(known.distinct()), "run", "left_semi").select("key").distinct()
    suspects = small(cut(suspects))

    texts = docs.select(text_key(F.col(text_col)).alias("key"), F.col(text_col).alias("text")).join(suspects, "key", "left_semi")
    # one text a key; cut off here, so that the words are made once and not inside every lambda that reads them
    exact = cut(texts.groupBy("key").agg(F.min("text").alias("text")).select("key", words(F.col("text")).alias("ws")))
    spots = None
    for m in lengths:
        s = exact.select("key", F.inline(window_positions("ws", m)))
        spots = s if spots is None else spots.unionByName(s)
    hits = spots.join(hint(by_win.select("m", "win", "set")), ["m", "win"])
    hits = hits.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("pos", "m", "set"))).alias("hits"))
    return rows.drop("runs"), cut(hits), by_win.select("set", "items")


def windows_folded(benchmark: DataFrame, text_col: str, w: int) -> DataFrame:
    b = benchmark.select(folded_words(F.coalesce(F.col(text_col), F.lit(""))).alias("ws"))
    return b.where(F.size("ws") > 0).withColumn("m", F.least(F.size("ws"), F.lit(w)))


def contaminated(n_hit: str = "n_hit", n_words: str = "n_words") -> Column:
    return (F.col(n_hit) > 0) & (20 * F.col(n_hit) >= F.col(n_words))


def decontaminate(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items (ids sorted as strings), contaminated."""
    rows, hits, sets = scan(docs, benchmark, **options)
    hits = hits.select("key", covered("hits").alias("n_hit"), F.array_sort(F.array_distinct(F.transform("hits", lambda x: x["set"]))).alias("combo"))
    combos = hits.select("combo").distinct()
    of = combos.select("combo", F.explode("combo").alias("set")).join(sets.distinct(), "set").select("combo", F.explode("items").alias("item"))
    of = of.groupBy("combo").agg(F.sort_array(F.collect_set("item")).alias("items"))
    found = small(cut(hits.join(of, "combo").select("key", "n_hit", "items")))
    out = rows.join(found, "key", "left").withColumn("n_hit", F.coalesce("n_hit", F.lit(0).cast("bigint"))).withColumn("items", F.coalesce("items", F.array().cast("array<string>")))
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"), "items", contaminated().alias("contaminated"))


def clean_documents(docs: DataFrame, benchmark: DataFrame, how: str = "documents", **options) -> DataFrame:
    """``docs`` without contaminated documents, or (``how="spans"``) with the hit
    words of contaminated documents cut out of their texts."""
    rows, hits, _ = scan(docs, benchmark, **options)
    text = options.get("text_col", "text")
    key = text_key(F.col(text))
    # keys and counts only are broadcast, not the hits; a row a text, whose words and hits don't depend on the document
    counts = small(cut(hits.select("key", covered("hits").alias("n_hit"))))
    flagged = cut(rows.select("key", "n_words").join(counts, "key").where(contaminated()).select(F.col("key").alias("bad_key")).distinct())
    whole = docs.select(F.struct("*").alias("row"), key.alias("row_key"))
    names = [F.col(f"row.`{c}`") for c in docs.columns]
    if how == "documents":
        return whole.join(small(flagged), F.col("row_key") == F.col("bad_key"), "left_anti").select(*names)
    spots = hits.select("key", F.transform("hits", lambda x: F.struct(x["pos"], x["m"])).alias("hits"))
    both = whole.join(flagged.join(spots, F.col("key") == F.col("bad_key")).drop("key"), F.col("row_key") == F.col("bad_key"), "left")
    gap, word = GAP_ANY_CASE[:-1], r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
    # a piece is a word with what stands before it; the last piece may have no word
    pieces = F.regexp_extract_all(F.col(f"row.`{text}`"), F.lit(f"{gap}*{word}|{gap}+"), F.lit(0))
    both = both.withColumn("pieces", F.when(F.col("bad_key").isNotNull(), pieces))
    kept = F.filter("pieces", lambda _, i: ~F.exists("hits", lambda x: (x["pos"] <= i + 1) & (i + 1 < x["pos"] + x["m"])))
    both = both.withColumn("new", F.when(F.col("bad_key").isNotNull(), F.array_join(kept, "")).otherwise(F.col(f"row.`{text}`")))
    return both.select(*[F.col("new").alias(c) if c == text else F.col(f"row.`{c}`") for c in docs.columns])
