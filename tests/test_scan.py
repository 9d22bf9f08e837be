"""Searches over rows whose tokens are stored nowhere hold numbers of the rows, not texts, words or trigrams."""

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from quern import catalogue, corpora
from quern.functions import text as T
from quern.operators import channels, filters
from quern.plans import search

from .oracle import connect, same

SF = "/root/testdata/sf0.001"
LONG = "the mentoi thtion " * 20_000


@pytest.fixture(scope="module")
def odd(tmp_path_factory):
    """Documents with a long text, no text, a blank one, none of a source, and a key three times."""
    folder = tmp_path_factory.mktemp("odd")
    word = ["erleaux", "the", "mentoi", "thtion", "other", "Größe", "x"]
    texts = {i: " ".join(word[(i * k) % 7] for k in range(1, 3 + i % 9)) for i in range(1, 260)}
    texts |= {3: LONG, 4: None, 6: "", 8: "?!", 10: "erleaux the thtion the mentoi"}
    rows = [(i, t, None if i % 11 == 0 else f"src{i % 3}") for i, t in texts.items()] + [(12, "the other mentoi", "src1"), (12, "erleaux the mentoi", "src1")]
    keys, said, sources = zip(*rows, strict=True)
    pq.write_table(pa.table({"doc_id": pa.array(keys, pa.int64()), "text": said, "source": sources}), folder / "documents.parquet")
    vectors = [[1.0, i / 100] for i in range(200)]
    vectors[5], vectors[7] = None, [1.0]
    pq.write_table(pa.table({"vec_id": pa.array(range(200), pa.int64()), "embedding": pa.array(vectors, pa.list_(pa.float32()))}), folder / "embeddings.parquet")
    return str(folder)


@pytest.mark.parametrize(("query", "with_vector"), [("erleaux the thtion the mentoi", True), ("größe m_00000010", False), ("m_00000010", True), ("?!", True)])
def test_scan_finds_what_the_channels_find(spark, odd, query, with_vector):
    vector = search.QueryVector([1.0, 0.5], corpora.FINGERPRINT, 0.1) if with_vector else None
    groups = corpora.memories(spark, odd).withColumn("group_key", corpora.F.col("id"))
    rows = corpora.memory_rows(spark, odd, corpora.passing)
    alone = corpora.memory_rows_alone(spark, odd)
    for f in (filters.MemoryFilters(all_projects=True, limit=100), filters.MemoryFilters(project_key="src1", limit=20)):
        want = search.hybrid(groups, rows, channels.MEMORIES, query, f, vector).orderBy("rank").collect()
        got = search.hybrid_scan(groups, alone, channels.MEMORIES, query, f, vector, corpora.note_vectors(spark, odd), "doc_id").orderBy("rank").collect()
        assert got == want and len(want) > 5


def test_kept_rows_are_as_large_as_the_query(spark, odd):
    query = "erleaux the thtion the mentoi"
    kept = channels.hits(corpora.memory_rows_alone(spark, odd), channels.MEMORIES, T.query_tokens(query), T.query_grams(query), filters.MemoryFilters(all_projects=True).predicate(), "doc_id")
    rows = {r["doc_id"]: r for r in kept.where("doc_id in (3, 10)").collect()}
    assert rows[3]["_n"] == [0.0, 20_000.0, 20_000.0, 20_000.0] and rows[3]["coverage"] == 3
    assert len(repr(rows[3])) < len(repr(rows[10])) + 100


def search_keeps_no_rows(spark, name):
    spark.catalog.clearCache()
    same(catalogue.queries()[name](spark, SF), connect(SF), catalogue.oracle_sql()[name])
    assert spark._jsparkSession.sharedState().cacheManager().isEmpty()


def test_rrf_fusion_memories_keeps_no_rows(spark):
    search_keeps_no_rows(spark, "rrf_fusion_memories")


def test_memory_search_keeps_no_rows(spark):
    search_keeps_no_rows(spark, "memory_search")
