"""Queries give every row and whole texts, and so do their SQL twins."""

import pytest

from quern import catalogue

from .oracle import connect, same

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


def run(spark, name):
    return catalogue.queries()[name](spark, SF)


def test_list_memories(spark, con):
    sql = "SELECT row_number() OVER (ORDER BY doc_id DESC) AS nth, 'm_' || lpad(doc_id::VARCHAR, 8, '0') AS id, doc_id AS updated_at FROM documents WHERE doc_id % 7 <> 0"
    got = run(spark, "list_memories")
    same(got, con, sql)
    nth = [r["nth"] for r in got.collect()]
    assert nth == list(range(1, len(nth) + 1)) and len(nth) > 100


def test_parser_errors_sorted(spark, con):
    sql = "SELECT row_number() OVER (ORDER BY event_type, 'k' || event_id) AS nth, event_type AS harness, 'k' || event_id AS path FROM events WHERE event_type = 'error' OR event_id % 97 = 0"
    got = run(spark, "parser_errors_sorted")
    same(got, con, sql)
    nth = [r["nth"] for r in got.collect()]
    assert nth == list(range(1, len(nth) + 1)) and len(nth) > 100


def test_doctor_has_every_parser_error(spark, tmp_path):
    from quern import config as cfg
    from quern import schemas
    from quern.plans.engine import Engine

    base = str(tmp_path)
    e = Engine(spark, cfg.Config(index=f"{base}/index", memory_directory=f"{base}/notes", memory_index=f"{base}/notes-index"))
    rows = spark.range(150).selectExpr("concat('k', id) source_key", "'pi' harness", "concat('p', id) path", "'broken' error", "id created_at")
    e.sessions_store.commit({"parser_errors": rows.select(*schemas.names(schemas.PARSER_ERRORS))})
    assert e.doctor().where("check like 'parser error %'").count() == 150


def test_whole_texts(spark, con, tmp_path):
    import pyarrow as pa
    import pyarrow.parquet as pq

    texts = {13: " " * 40 + "late", 26: "x" * 70 + " it's", 39: " " * 50}
    cols = {"doc_id": pa.array(list(texts)), "text": list(texts.values()), "lang": ["en"] * 3, "source": ["s"] * 3, "n_chars": pa.array([len(t) for t in texts.values()])}
    pq.write_table(pa.table(cols), tmp_path / "documents.parquet")
    rows = lambda name: catalogue.queries()[name](spark, str(tmp_path)).collect()
    assert {r["doc_id"]: r["error"] for r in rows("record_validate")} == {13: None, 26: None, 39: "a revision is empty"}
    assert {r["type"]: r["n"] for r in rows("warning_counts")} == {"a revision is empty": 1}
    assert {r["doc_id"]: r["content"] for r in rows("revision_history") if r["revision"] == 2} == {13: texts[13], 26: texts[26]}
    mark = "'\"'\"'"
    assert {r["doc_id"]: r["quoted"] for r in rows("shell_quote")}[26] == "'" + "x" * 70 + mark + "it" + mark + "s'"


def test_whole_texts_of_the_tables(spark, con):
    same(run(spark, "shell_quote"), con, f"SELECT doc_id, {catalogue.QUOTE.format('replace(text, chr(32), chr(39))')} AS quoted FROM documents")
