"""Cells of vectors: the result of reading all of them, of which part is read."""

import tracemalloc

import numpy as np
import pytest

from quern.operators import blocks, cells


@pytest.fixture(scope="module")
def clustered(spark):
    rng = np.random.default_rng(3)
    middle = rng.normal(size=(30, 24))
    x = (middle[rng.integers(0, 30, 4000)] + 0.15 * rng.normal(size=(4000, 24))).astype(np.float32)
    x[77] = x[76]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(9999, None)]
    return spark.createDataFrame(rows, "key bigint, v array<float>").repartition(4).cache()


def same(a, b):
    assert sorted((r["query"], r["key"], r["place"]) for r in a.collect()) == sorted((r["query"], r["key"], r["place"]) for r in b.collect())


@pytest.mark.parametrize("k,least", [(20, None), (500, None), (50, 20.0)])
def test_cells_equal_all_rows(clustered, k, least):
    queries = clustered.where("key % 200 = 0 or key = 76")
    index = cells.build(clustered, "key", "v", cells=60)
    assert index.count.sum() == 4000 and index.rows.count() == 4000
    found, read = cells.search(index, queries, query="key", vector="v", k=k, least=least)
    same(found, blocks.nearest(clustered, queries, key="key", vector="v", k=k, least=least))
    assert 0 < read.read <= read.pairs
    if k == 20:
        assert read.read < 0.4 * read.pairs


def test_blocks_of_queries(clustered):
    queries = clustered.where("key < 50")
    index = cells.build(clustered, "key", "v", cells=40, sample=500)
    found, _ = cells.search(index, queries, query="key", vector="v", k=5, block=7)
    same(found, blocks.nearest(clustered, queries, key="key", vector="v", k=5))


def test_odd_tables(spark, clustered):
    none = clustered.limit(0)
    index = cells.build(none, "key", "v")
    assert cells.search(index, clustered.limit(3), query="key", vector="v")[0].count() == 0
    one = cells.build(clustered.where("key = 5"), "key", "v")
    assert [r["key"] for r in cells.search(one, clustered.where("key = 6 or key = 9999"), query="key", vector="v")[0].collect()] == [5]
    mixed = spark.createDataFrame([(1, [1.0]), (2, [1.0, 2.0])], "key bigint, v array<float>")
    with pytest.raises(ValueError, match="vectors of"):
        cells.build(mixed, "key", "v")
    with pytest.raises(ValueError, match="types"):
        blocks.nearest(mixed.selectExpr("double(key) as key", "v"), mixed, key="key", vector="v")


def test_distances_take_one_size():
    """However many rows a batch has, the table of distances that is held stays as it is."""
    rng = np.random.default_rng(5)
    x, c = rng.normal(size=(20_000, 8)).astype(np.float32), rng.normal(size=(1000, 8))
    tracemalloc.start()
    near = cells.nearest_centroid(x, c)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 40e6
    some = rng.integers(0, len(x), 200)
    assert (near[some] == ((x[some, None, :] - c[None]) ** 2).sum(axis=2).argmin(axis=1)).all()
