"""Tables of queries scored in one pass: the scores of single searches, and how little is dealt."""

import pytest
from pyspark.sql import functions as F

from quern.operators import bm25, forward
from quern.operators.segments import GRAM, WORD

from .test_segments import WEIGHTS, corpus


@pytest.fixture(scope="module")
def rows(spark):
    return corpus(spark, 1500, 11)


ASKED = {1: ["w0", "w390", "w0"], 2: ["w1", "w2", "none"], 3: ["none"], 4: [f"w{i}" for i in range(50)]}


def terms_of(spark):
    words = [(WORD, q, t, ts.count(t)) for q, ts in ASKED.items() for t in dict.fromkeys(ts)]
    grams = [(GRAM, q, t, 1) for q, ts in ASKED.items() for t in dict.fromkeys(ts)]
    return spark.createDataFrame(words + grams, "kind string, query int, term string, times bigint")


@pytest.mark.parametrize("order,block,slice_", [("raw", 64, 16384), ("plain", 1, 50)])
def test_many_equal_single_scans(spark, rows, monkeypatch, order, block, slice_):
    monkeypatch.setattr(forward, "SLICE", slice_)
    where = F.col("updated_at") > 20
    found = forward.top_many(rows, where, WEIGHTS, ("body",), terms_of(spark), {WORD: 30, GRAM: 40}, order, block=block).collect()
    for q, query in ASKED.items():
        scored = bm25.score_scan(rows, WEIGHTS, query, "raw", where, unweighted="plain").withColumn("by", F.round(order, 9))
        has = F.size(F.array_intersect(F.array(*[F.lit(t) for t in dict.fromkeys(query)]), F.col("body")))
        want = [(r["row_id"], round(r["raw"], 9), round(r["plain"], 9), r["has"]) for r in scored.orderBy("by", F.desc("updated_at"), "row_id").limit(30).select("*", has.alias("has")).collect()]
        got = sorted((r for r in found if r["query"] == q and r["kind"] == WORD), key=lambda r: r["pos"])
        assert [(r["row_id"], round(r["raw"], 9), round(r["plain"], 9), r["coverage"]) for r in got] == want
        scored = bm25.score_gram_sets(rows, "grams", query, "raw", where).withColumn("by", F.round("raw", 9))
        want = [(r["row_id"], round(r["raw"], 9), r["n_shared"]) for r in scored.orderBy("by", F.desc("updated_at"), "row_id").limit(40).collect()]
        got = sorted((r for r in found if r["query"] == q and r["kind"] == GRAM), key=lambda r: r["pos"])
        assert [(r["row_id"], round(r["raw"], 9), r["n_shared"]) for r in got] == want


def test_only_asked_terms_are_kept(spark, rows):
    """A row keeps numbers of the terms that are asked for, so what is stored is no multiple of the texts."""
    held = forward.hits(rows, F.lit(True), WEIGHTS, ("body",), ["w0", "w1"], ["w0"])
    assert held.count() == rows.count() and held.select(F.max(F.size("word")), F.max(F.size("gram"))).first() == (2, 1)


def test_no_rows_and_no_queries(spark, rows):
    most = {WORD: 3, GRAM: 3}
    assert forward.top_many(rows.limit(0), F.lit(True), WEIGHTS, (), terms_of(spark), most).count() == 0
    assert forward.top_many(rows, F.lit(True), WEIGHTS, (), terms_of(spark).limit(0), most).count() == 0


def test_sessions_are_made_once_and_kept_nowhere(spark):
    """A table of queries leaves no cached rows behind."""
    from quern import catalogue

    before = spark.sparkContext._jsc.getPersistentRDDs().size()
    assert catalogue.hybrid_many_sessions(spark, "/root/testdata/sf0.001").count() > 0
    assert spark.sparkContext._jsc.getPersistentRDDs().size() <= before


def test_trigrams_of_words(spark):
    """Trigrams of a column of words need not be written out: their numbers and counts are those of the written ones."""
    from quern.functions import text as T

    texts = [("a", "Zażółć gęślą 😀😀😀😀 banana ab c"), ("b", ""), ("c", "ab abab banana the then"), ("d", "x ab ć"), ("e", None)]
    words = T.tokens(T.normalize(F.coalesce("text", F.lit(""))))
    table = spark.createDataFrame(texts, "row_id string, text string").select("row_id", words.alias("body"), words.alias("head"), F.lit(1).alias("updated_at")).withColumn("grams", T.grams_of(F.col("body")))
    asked = ["ban", "ab", "zaz", "the", "none", "c", "ana"]
    held = lambda **more: sorted(map(tuple, forward.hits(table, F.lit(True), WEIGHTS, ("body",), ["ab", "banana"], asked, **more).collect()))
    assert held(grams_of="body") == held() and sum(len(r[-1]) for r in held()) == 11  # a has five, c four, d two
    kept = forward.hits(table, F.lit(True), WEIGHTS, ("body",), [], [], "body", {"own": F.upper("row_id")})
    assert {r["own"] for r in kept.collect()} == set("ABCDE")


def test_sessions_are_joined_before_windows_are_cut(spark):
    """Neither words nor trigrams of a window are shuffled: all joins lie below the windows; named rows are those of all."""
    from quern import corpora

    rows = corpora.session_rows(spark, "/root/testdata/sf0.001", corpora.passing)
    plan = rows._jdf.queryExecution().optimizedPlan().toString().splitlines()
    assert all("Join" not in line for line in plan[: next(i for i, line in enumerate(plan) if "Generate" in line)])
    some = rows.orderBy("row_id").limit(7).select("row_id")
    found = corpora.session_rows(spark, "/root/testdata/sf0.001", corpora.passing, some).join(some, "row_id", "left_semi")
    assert sorted(map(repr, found.collect())) == sorted(map(repr, rows.orderBy("row_id").limit(7).select(*found.columns).collect()))
