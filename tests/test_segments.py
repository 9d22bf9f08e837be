"""Segments and block bounds against scans and against an index made anew."""

import random

import pytest
from pyspark.sql import functions as F

from quern.operators import bm25, segments

WEIGHTS = {"body": 1.0, "head": 3.0}


def corpus(spark, n, seed, words=400):
    """Rows whose words have frequencies as in natural texts, one of them in most rows."""
    rng = random.Random(seed)
    names = [f"w{i}" for i in range(words)]
    odds = [1 / (i + 1) for i in range(words)]
    rows = [(f"r{i:05d}", rng.choices(names, odds, k=rng.randint(3, 60)), rng.choices(names, k=2), rng.sample(names[:50], 5), i % 97) for i in range(n)]
    return spark.createDataFrame(rows, "row_id string, body array<string>, head array<string>, grams array<string>, updated_at bigint").repartition(4).cache()


def index_of(spark, *parts):
    made = [segments.segment(added, removed, WEIGHTS, i + 1) for i, (added, removed) in enumerate(parts)]
    return segments.Index([segments.Segment(**s.sums(), blocks=s.blocks.cache(), terms=s.terms.cache(), gone=s.gone.cache()) for s in made])


def scan(rows, query, k, where=None):
    scored = bm25.score_scan(rows, WEIGHTS, query, "raw", F.lit(True) if where is None else where, unweighted="plain").withColumn("by", F.round("raw", 9))
    return [(r["row_id"], round(r["raw"], 9)) for r in scored.orderBy("by", F.desc("updated_at"), "row_id").limit(k).collect()]


@pytest.fixture(scope="module")
def rows(spark):
    return corpus(spark, 6000, 1)


@pytest.fixture(scope="module")
def index(spark, rows):
    return index_of(spark, (rows, None))


@pytest.mark.parametrize("query", [["w0", "w200"], ["w0", "w1", "w2"], ["w350", "w351", "w0", "w0"], ["w399"], ["none"]])
def test_top_equals_scan(rows, index, query):
    keys = rows.select("row_id", "updated_at")
    top, read = segments.top(index, segments.WORD, query, keys, 20, first=4)
    assert [(r["row_id"], round(r["raw"], 9)) for r in top.collect()] == scan(rows, query, 20)
    assert read.read <= read.blocks


def test_blocks_are_skipped(rows, index):
    """A rare word beside one of most rows: slots without the rare one can't reach the floor."""
    assert index.segments[0].slots == 64
    _, read = segments.top(index, segments.WORD, ["w0", "w390"], rows.select("row_id", "updated_at"), 10, first=8)
    assert 0 < read.read < 0.6 * read.blocks


def test_filtered_top(rows, index):
    """The floor is that of rows that pass the filter; few of them mean that all is read."""
    for where in (F.col("updated_at") < 30, F.col("updated_at") == 96, F.lit(False)):
        keys = rows.where(where).select("row_id", "updated_at")
        top, _ = segments.top(index, segments.WORD, ["w3", "w300"], keys, 25, first=4)
        assert [(r["row_id"], round(r["raw"], 9)) for r in top.collect()] == scan(rows, ["w3", "w300"], 25, where)


def test_unweighted_order(rows, index):
    top, _ = segments.top(index, segments.WORD, ["w5", "w100"], rows.select("row_id", "updated_at"), 15, by="plain", first=4)
    scored = bm25.score_scan(rows, WEIGHTS, ["w5", "w100"], "raw", unweighted="plain").withColumn("by", F.round("plain", 9))
    assert [r["row_id"] for r in top.collect()] == [r["row_id"] for r in scored.orderBy("by", F.desc("updated_at"), "row_id").limit(15).collect()]


def test_many_slots_are_joined(rows, index, monkeypatch):
    monkeypatch.setattr(segments, "MOST_SLOTS", 0)
    top, _ = segments.top(index, segments.WORD, ["w0", "w390"], rows.select("row_id", "updated_at"), 10, first=8)
    assert [(r["row_id"], round(r["raw"], 9)) for r in top.collect()] == scan(rows, ["w0", "w390"], 10)


def test_changes_as_segments(spark, rows):
    """Three changes, each a segment: the state after them, before and after merging, is that of an index made anew."""
    later = corpus(spark, 500, 7)
    states = [rows, rows.where("updated_at > 5")]
    states.append(states[-1].where("row_id >= 'r00500'").unionByName(later))  # 500 rows with other words under used keys, or new
    states.append(states[-1].withColumn("head", F.when(F.col("row_id").endswith("7"), F.slice("head", 1, 1)).otherwise(F.col("head"))))
    parts = [(rows, None), *(segments.difference(a, b, WEIGHTS) for a, b in zip(states, states[1:], strict=False))]
    index, now = index_of(spark, *parts), states[-1].cache()
    assert index.n_docs == now.count() and index.segments[1].rows == 0 and 0 < index.segments[3].rows < 800
    anew = index_of(spark, (now, None))
    both = (lambda i: sorted((r["kind"], r["term"], r["df"]) for r in i.terms().collect()))
    assert both(index) == both(anew) and index.average(segments.WORD) == anew.average(segments.WORD) and index.average(segments.GRAM) == anew.average(segments.GRAM)
    query = ["w0", "w77", "w300"]
    score = lambda i, kind=segments.WORD: sorted((r["row_id"], round(r["raw"], 9), r["n_shared"]) for r in segments.scores(i, kind, query).collect())
    want, grams = score(anew), score(anew, segments.GRAM)
    assert len(want) > 3000 and score(index) == want and score(index, segments.GRAM) == grams
    for start in (0, 1, 2):
        less = segments.Index([*index.segments[:start], segments.merged(index, start)])
        assert less.n_docs == index.n_docs and score(less) == want
    top, _ = segments.top(index, segments.WORD, query, now.select("row_id", "updated_at"), 30, first=4)
    assert [(r["row_id"], round(r["raw"], 9)) for r in top.collect()] == scan(now, query, 30)


def test_which_segments_are_merged():
    assert segments.to_merge([1000, 10, 5]) == 1 and segments.to_merge([1000, 900, 10, 5]) == 2
    assert segments.to_merge([10, 10, 10]) == 0 and segments.to_merge([1000, 1]) == 0 and segments.to_merge([5000, 100, 60, 1]) == 1


def test_empty_index(spark, rows):
    empty = rows.limit(0)
    index = index_of(spark, (empty, None))
    assert segments.scores(index, segments.WORD, ["w1"]).count() == 0
    assert segments.top(index, segments.WORD, ["w1"], empty.select("row_id", "updated_at"), 5)[0].count() == 0


def test_no_posting_is_shuffled(spark, rows, index):
    """Blocks are made where rows are dealt by slot, merged ones where blocks are; document counts are sums of blocks."""
    import re

    def exchanges(df):
        return re.findall(r"Exchange hashpartitioning\((.*?), \d+\)", df._jdf.queryExecution().executedPlan().toString())

    made = segments.segment(rows, None, WEIGHTS)
    dealt = exchanges(made.blocks)
    assert dealt and all(re.fullmatch(r"slot#\d+", by) for by in dealt)
    dealt = exchanges(segments.merged(segments.Index([index.segments[0], index.segments[0]]), 0).blocks)
    assert dealt and all(re.fullmatch(r"(place|slot)#\d+", by) for by in dealt)  # those of the cached blocks are shown, too
    stored = made.stored(index.segments[0].blocks)
    counts = lambda df: sorted(map(tuple, df.collect()))
    assert counts(stored.terms) == counts(segments.counted(rows, WEIGHTS))


def test_blocks_are_made_of_rows(spark, monkeypatch):
    """No posting is a row of the plan; blocks are those that counting word by word gives, however rows are grouped."""
    monkeypatch.setattr(segments, "GROUP_TERMS", 100)
    monkeypatch.setattr(segments, "GROUP_ROWS", 7)
    table = corpus(spark, 300, 3, 40).drop("updated_at").unionByName(
        spark.createDataFrame([("none", [], [], []), ("null", None, ["w1"], ["w1"]), ("only head", [], ["ż", "w1", "w1"], [])], "row_id string, body array<string>, head array<string>, grams array<string>")
    )
    made = segments.blocks_of(table, WEIGHTS, 4)
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "Aggregate" not in plan
    want = {}
    for r in table.withColumn("slot", segments.slot_of(4)).collect():
        body = [] if r["body"] is None else [(t, 1.0) for t in r["body"]] + [(t, 3.0) for t in r["head"]]  # a row without a column has no words
        for t in {t for t, _ in body}:
            own = [w for term, w in body if term == t]
            want.setdefault((segments.WORD, t, r["slot"]), []).append((r["row_id"], sum(own), float(len(own)), len(body)))
        for g in r["grams"]:
            want.setdefault((segments.GRAM, g, r["slot"]), []).append((r["row_id"], 1.0, 1.0, len(r["grams"])))
    got = made.collect()
    assert len(got) == len(want)
    for b in got:
        posts = sorted(want[b["kind"], b["term"], b["slot"]])
        assert [tuple(p) for p in b["posts"]] == posts and b["n_posts"] == len(posts)
        assert (b["most_f"], b["most_n"], b["least_len"]) == (max(p[1] for p in posts), max(p[2] for p in posts), min(p[3] for p in posts))


def test_difference_compares_once(spark, rows):
    """Both sides are hashed once for what comes and what goes: each then reads its own rows and the keys that changed."""
    new = rows.where("updated_at > 5").withColumn("head", F.when(F.col("row_id").endswith("7"), F.slice("head", 1, 1)).otherwise(F.col("head")))
    added, removed = segments.difference(rows, new, WEIGHTS)
    assert [df._jdf.queryExecution().optimizedPlan().collectLeaves().size() for df in (added, removed)] == [2, 2]
    assert {r["row_id"] for r in added.collect()} == {r["row_id"] for r in new.where("row_id like '%7'").collect()}
    assert removed.count() == rows.where("updated_at <= 5 or row_id like '%7'").count()


def test_bounds_of_slots_are_summed_once(spark, rows, index):
    """A search goes over its terms' blocks for the bounds, for the floor and for the result, and no more."""
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        read.add(1)
        yield from batches

    blocks = index.segments[0].blocks.coalesce(1)
    whole = segments.Index([segments.Segment(**index.segments[0].sums(), blocks=blocks.mapInArrow(counted, blocks.schema), terms=index.segments[0].terms, gone=index.segments[0].gone)])
    top, _ = segments.top(whole, segments.WORD, ["w0", "w390"], rows.select("row_id", "updated_at"), 10, first=8)
    assert [(r["row_id"], round(r["raw"], 9)) for r in top.collect()] == scan(rows, ["w0", "w390"], 10)
    assert read.value <= 3
