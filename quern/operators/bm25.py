"""BM25 over token arrays with column weights.

score = - sum over query terms of IDF * f * (k1 + 1) / (f + k1 * (1 - b + b * |D| / avgdl)),
f = sum of weight * occurrences over the columns, |D| the tokens of all columns,
IDF = ln((N - n + 0.5) / (n + 0.5)), at least 1e-6.  Statistics cover all rows,
whatever is filtered.  Lower scores are better.

:func:`score_scan` picks the query's words from the token arrays (for statistics and for
scores) and shuffles nothing but one row of statistics a task; :func:`counted` keeps numbers only, for rows whose
tokens are stored nowhere; :mod:`.segments` has an inverted index for the same scores.
"""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

K1, B = 1.2, 0.75
LEAST_IDF = 1e-6


def _count(col: str, term: str) -> Column:
    """Occurrences of a term in a token array, without a lambda."""
    return F.size(col) - F.size(F.array_remove(F.col(col), F.lit(term)))


def frequency(weights: dict[str, float], term: str) -> Column:
    total = F.lit(0.0)
    for c, w in weights.items():
        total = total + F.lit(float(w)) * _count(c, term)
    return total


def length(columns) -> Column:
    total = F.lit(0)
    for c in columns:
        total = total + F.size(c)
    return total


def idf(n_docs: Column, df: Column) -> Column:
    v = F.log((n_docs - df + 0.5) / (df + 0.5))
    return F.when(v <= 0, F.lit(LEAST_IDF)).otherwise(v)


def term_score(f: Column, doc_len: Column, avg_len: Column, weight: Column) -> Column:
    return weight * f * (K1 + 1) / (f + K1 * (1 - B + B * doc_len / avg_len))


def statistics(docs: DataFrame, columns, terms: list[str]) -> DataFrame:
    """One row: n_docs, avg_len, and df_i of each term."""
    has = [F.count_if(F.greatest(F.lit(False), *[F.array_contains(c, t) for c in columns])).cast("double").alias(f"df_{i}") for i, t in enumerate(terms)]
    return docs.agg(F.count("*").cast("double").alias("n_docs"), F.avg(length(columns)).alias("avg_len"), *has)


def term_stats(docs: DataFrame, columns, terms: list[str]) -> DataFrame:
    """(term, df, n_docs, avg_len, idf) of each term."""
    s = statistics(docs, columns, terms)
    rows = F.array(*[F.struct(F.lit(t).alias("term"), F.col(f"df_{i}").alias("df")) for i, t in enumerate(terms)])
    out = s.select("n_docs", "avg_len", F.inline(rows))
    return out.select("term", F.col("df").cast("bigint").alias("df"), F.col("n_docs").cast("bigint").alias("n_docs"), "avg_len", idf(F.col("n_docs"), F.col("df")).alias("idf"))


def _picked(docs: DataFrame, columns, terms: list[str]) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with its asked words of each token column, in one pass over it, and ``_len``; the names of those columns."""
    asked = F.array(*[F.lit(t) for t in terms])
    own = {c: f"_has_{i}" for i, c in enumerate(columns)}
    return docs.withColumns({h: F.filter(c, lambda t: F.array_contains(asked, t)) for c, h in own.items()}).withColumn("_len", length(columns)), own


def _total(times: dict[str, int], f: list[Column]) -> Column:
    """The score of rows with their frequencies of each term, beside ``_len`` and the statistics."""
    s = F.lit(0.0)
    for i, (t, x) in enumerate(zip(times, f, strict=True)):
        s = s + F.lit(float(times[t])) * term_score(x, F.col("_len"), F.col("avg_len"), idf(F.col("n_docs"), F.col(f"df_{i}")))
    return -s


def score_scan(docs: DataFrame, weights: dict[str, float], query: list[str], name: str = "bm25", where: Column | None = None, unweighted: str | None = None) -> DataFrame:
    """Rows of ``docs`` with any query term (and ``where``), with their score; a repeated
    query word counts as often.  ``unweighted``: also the score with all weights one.

    Of each token array only the query's words are kept, in one pass over it; statistics and
    scores are made of these few."""
    times = Counter(query)
    terms = list(times)
    kept, own = _picked(docs, weights, terms)
    has = [F.count_if(F.greatest(F.lit(False), *[F.array_contains(h, t) for h in own.values()])).cast("double").alias(f"df_{i}") for i, t in enumerate(terms)]
    stats = kept.agg(F.count("*").cast("double").alias("n_docs"), F.avg("_len").alias("avg_len"), *has)
    hit = F.greatest(F.lit(False), *[F.size(h) > 0 for h in own.values()])
    rows = kept.where(hit if where is None else where & hit).crossJoin(F.broadcast(stats))

    def total(w: dict[str, float]) -> Column:
        return _total(times, [frequency({own[c]: x for c, x in w.items()}, t) for t in terms])

    rows = rows.withColumn(name, total(weights))
    if unweighted:
        rows = rows.withColumn(unweighted, total(dict.fromkeys(weights, 1.0)))
    return rows.drop("n_docs", "avg_len", "_len", *own.values(), *[f"df_{i}" for i in range(len(terms))])


def counted(docs: DataFrame, weights: dict[str, float], query: list[str], coverage) -> DataFrame:
    """``docs`` with what :func:`score_counted` needs of its token arrays, in numbers: ``_len``, weighted and plain
    frequency of each query word (``_f``, ``_n``), and ``coverage``, the query words in the columns of that name."""
    terms = list(dict.fromkeys(query))
    kept, own = _picked(docs, weights, terms)
    f = lambda w: F.array(*[frequency({own[c]: x for c, x in w.items()}, t) for t in terms])
    covers = F.size(F.array_distinct(F.concat(*[F.col(own[c]) for c in coverage])))
    return kept.withColumns({"_f": f(weights), "_n": f(dict.fromkeys(weights, 1.0)), "coverage": covers}).drop(*own.values())


def score_counted(kept: DataFrame, query: list[str], name: str = "bm25", where: Column | None = None, unweighted: str | None = None) -> DataFrame:
    """:func:`score_scan` of what :func:`counted` kept for the same query."""
    times = Counter(query)
    at = range(len(times))
    has = [F.count_if(F.col("_n")[i] > 0).cast("double").alias(f"df_{i}") for i in at]
    stats = kept.agg(F.count("*").cast("double").alias("n_docs"), F.avg("_len").alias("avg_len"), *has)
    hit = F.exists("_n", lambda n: n > 0)
    rows = kept.where(hit if where is None else where & hit).crossJoin(F.broadcast(stats))
    rows = rows.withColumn(name, _total(times, [F.col("_f")[i] for i in at]))
    if unweighted:
        rows = rows.withColumn(unweighted, _total(times, [F.col("_n")[i] for i in at]))
    return rows.drop("n_docs", "avg_len", *[f"df_{i}" for i in at])


def score_gram_sets(docs: DataFrame, grams_col: str, query: list[str], name: str = "gram_bm25", where: Column | None = None) -> DataFrame:
    """BM25 over sets (every frequency is one): rows that share a gram with the query,
    with the score and ``n_shared``.

    The document part of the score is one factor, so a row only adds up the IDFs
    of its shared grams; their counts come from an explode of shared grams alone.
    """
    return score_shared(docs.withColumn("_shared", shared_grams(grams_col, query)), F.size(grams_col), name, where).drop("_shared")


def shared_grams(grams_col: str, query: list[str]) -> Column:
    return F.array_intersect(F.col(grams_col), F.array(*[F.lit(g) for g in dict.fromkeys(query)]))


def score_shared(shared: DataFrame, size: Column, name: str = "gram_bm25", where: Column | None = None) -> DataFrame:
    """:func:`score_gram_sets` of rows with their grams of the query in ``_shared``; ``size`` counts all of a row's."""
    sizes = shared.agg(F.count("*").cast("double").alias("n_docs"), F.avg(size).alias("avg_len"))
    df = shared.select(F.explode("_shared").alias("gram")).groupBy("gram").agg(F.count("*").cast("double").alias("df"))
    table = df.crossJoin(F.broadcast(sizes)).agg(
        F.map_from_entries(F.collect_list(F.struct("gram", idf(F.col("n_docs"), F.col("df")).alias("idf")))).alias("_idf"), F.any_value("avg_len").alias("_avg")
    )  # at most one entry a query gram
    rows = shared.where(F.size("_shared") > 0 if where is None else where & (F.size("_shared") > 0)).crossJoin(F.broadcast(table))
    factor = (K1 + 1) / (1 + K1 * (1 - B + B * size / F.col("_avg")))
    added = F.aggregate(F.array_sort("_shared"), F.lit(0.0), lambda s, g: s + F.element_at(F.col("_idf"), g))
    return rows.withColumn(name, -(added * factor)).withColumn("n_shared", F.size("_shared")).drop("_idf", "_avg")
