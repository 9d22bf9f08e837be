"""Running totals over ranges equal a window's, whatever the keys' sizes."""

import random

from pyspark.sql import functions as F

from quern.operators.running import running_totals


def brute(rows):
    """(key, place) to the sums of n and of 1 in the key's order."""
    out, sums = {}, {}
    for k, o, n in sorted(rows, key=lambda r: (r[0] is not None, r[0] or "", r[1])):
        a, b = sums.get(k, (0, 0))
        sums[k] = a + (n or 0), b + 1
        out[k, o] = sums[k]
    return out


def test_running_totals(spark):
    rng = random.Random(4)
    rows = [("hot", i, rng.randint(-5, 9)) for i in range(4000)]
    rows += [(rng.choice(["a", "b", "", None, "z"]), 10_000 + i, rng.choice([None, 1, 2])) for i in range(1500)]
    rows += [(f"one{i}", i, 7) for i in range(500)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "k string, o bigint, n bigint").withColumn("one", F.lit(1).cast("bigint"))
    want = brute(rows)
    for parts in (1, 7, 40):
        got = running_totals(df, ["k"], ["o"], {"sum": "n", "nth": "one"}, parts, before={"ahead": "n"})
        found = got.collect()
        assert all(r["ahead"] == r["sum"] - (r["n"] or 0) for r in found)
        assert {(r["k"], r["o"]): (r["sum"], r["nth"]) for r in found} == want and len(found) == len(rows)
    # no task has the third of the rows that are the hot key's
    sizes = [r["count"] for r in got.groupBy(F.spark_partition_id()).count().collect()]
    assert max(sizes) < len(rows) / 6


def test_running_totals_of_small_tables(spark):
    empty = spark.createDataFrame([], "k string, o bigint, n bigint")
    assert running_totals(empty, ["k"], ["o"], {"s": "n"}).collect() == []
    big = 2**63 - 1
    df = spark.createDataFrame([(1, 1, big), (1, 2, 1)], "k int, o bigint, n bigint")
    assert [r["s"] for r in running_totals(df, ["k"], ["o"], {"s": "n"}).orderBy("o").collect()] == [big, -(2**63)]
    two = spark.createDataFrame([(1, "x", 1, 2), (1, "x", 2, 3), (1, "y", 1, 5), (2, "x", 1, 7)], "a int, b string, o int, n bigint")
    assert sorted((r["a"], r["b"], r["o"], r["s"]) for r in running_totals(two, ["a", "b"], ["o"], {"s": "n"}).collect()) == [(1, "x", 1, 2), (1, "x", 2, 5), (1, "y", 1, 5), (2, "x", 1, 7)]
