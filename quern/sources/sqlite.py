"""A session database in SQLite as a source: discovery, schema check, and its messages.

Every task opens the file read-only and reads the messages and parts of its own
sessions; joins, filters and aggregates are DataFrame operations.
"""

from __future__ import annotations

import os
import sqlite3
from collections.abc import Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..functions.identity import stable_key_of
from ..operators.running import running_totals

#: Columns that must be there (fixed values).
REQUIRED = {
    "session": ("id", "parent_id", "directory", "title", "time_created", "time_updated"),
    "message": ("id", "session_id", "time_created", "data"),
    "part": ("id", "message_id", "session_id", "time_created", "data"),
}


def connect(path: str) -> sqlite3.Connection:
    con = sqlite3.connect(f"{Path(path).absolute().as_uri()}?mode=ro", uri=True)
    con.execute("PRAGMA query_only = 1")
    return con


def require_columns(con: sqlite3.Connection, table: str, columns: tuple[str, ...]) -> None:
    there = {r[1] for r in con.execute(f"PRAGMA table_info({table})")}
    if missing := sorted(set(columns) - there):
        raise ValueError(f"table {table} lacks columns: {', '.join(missing)}")


def discover(path: str) -> list[dict]:
    """One source a session, by id; a missing file has none."""
    if not path or not os.path.exists(path):
        return []
    con = connect(path)
    try:
        for table, columns in REQUIRED.items():
            require_columns(con, table, columns)
        rows = con.execute("SELECT id, coalesce(parent_id, ''), coalesce(directory, ''), coalesce(title, ''), coalesce(time_created, 0), coalesce(time_updated, 0) FROM session ORDER BY id").fetchall()
    finally:
        con.close()
    return [
        {"source_key": stable_key_of("opencode", r[0]), "harness": "opencode", "path": path, "version": f"opencode-v1:{r[5]}", "native_id": r[0], "parent_id": r[1], "cwd": r[2], "name": r[3], "started_at": r[4], "updated_at": r[5]}
        for r in rows
    ]


#: What a session says of itself.
ABOUT = "source_key string, path string, session_id string, cwd string, name string"
_ROWS = "source_key string, native_id string, kind string, id string, message_id string, time_created bigint, data string"


def read_rows(spark: SparkSession, sources: list[dict]) -> DataFrame:
    """Messages and parts of the sessions, by ``kind``."""
    table = spark.createDataFrame([(s["source_key"], s["path"], s["native_id"]) for s in sources], "source_key string, path string, native_id string")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, group in batch.groupby("path"):
                con = connect(path)
                try:
                    for key, sid in zip(group["source_key"], group["native_id"], strict=True):
                        rows = [(key, sid, "message", i, i, t or 0, d) for i, t, d in con.execute("SELECT id, time_created, data FROM message WHERE session_id = ?", (sid,))]
                        rows += [(key, sid, "part", i, m, t or 0, d) for i, m, t, d in con.execute("SELECT id, message_id, time_created, data FROM part WHERE session_id = ?", (sid,))]
                        yield pd.DataFrame(rows, columns=schemas.names(_ROWS))
                finally:
                    con.close()

    return table.repartition(max(1, min(len(sources) // 50, 2000))).mapInPandas(run, _ROWS)


def read_events(spark: SparkSession, sources: list[dict]) -> DataFrame:
    """Event rows as those of the logs: text parts in the order of messages and parts."""
    if not sources:
        return spark.createDataFrame([], schemas.EVENTS)
    about = spark.createDataFrame([(s["source_key"], s["path"], s["native_id"], s["cwd"], s["name"]) for s in sources], ABOUT)
    return events(read_rows(spark, sources), about)


def events(rows: DataFrame, about: DataFrame) -> DataFrame:
    """Event rows from messages and parts (as :func:`read_rows` gives them) and the sessions' own data."""
    spark = rows.sparkSession

    # an object and nothing else; parsed and judged in the JVM
    trimmed = F.regexp_replace("data", r"^\s+|\s+$", "")
    is_object = F.startswith(trimmed, F.lit("{")) & F.endswith(trimmed, F.lit("}")) & F.from_json("data", "map<string,string>").isNotNull()
    rows = rows.withColumn("ok", F.coalesce(is_object, F.lit(False)))
    bad = rows.where(~F.col("ok")).groupBy("source_key").agg(F.min("id").alias("id"))
    get = lambda c, p: F.get_json_object(c, p)
    m = rows.where("kind = 'message' and ok").select("source_key", F.col("id").alias("message_id"), F.col("time_created").alias("m_time"), get("data", "$.role").alias("role"), get("data", "$.parentID").alias("parent"))
    p = rows.where("kind = 'part' and ok").where((get("data", "$.type") == "text") & (F.coalesce(get("data", "$.synthetic"), F.lit("false")) != "true"))
    p = p.select("source_key", "message_id", F.col("id").alias("part_id"), F.col("time_created").alias("p_time"), F.trim(F.regexp_replace(get("data", "$.text"), r"^\s+|\s+$", "")).alias("text"))
    both = m.join(p, ["source_key", "message_id"]).where(F.col("role").isin("user", "assistant") & (F.col("text") != ""))
    # numbers by ranges, not by a window of a session, which may be a third of all rows
    order = ["m_time", "message_id", "p_time", "part_id"]
    ords = running_totals(both.select("source_key", *order, F.lit(1).cast("bigint").alias("one")), ["source_key"], order, {"ord": "one"})
    numbered = both.join(ords.drop("one", "m_time", "p_time"), ["source_key", "message_id", "part_id"])
    entry = numbered.join(about.select("source_key", "path"), "source_key").select(
        "source_key", "path", F.col("ord"), F.lit("event").alias("kind"), F.when(F.col("p_time") > 0, F.col("p_time")).otherwise(F.when(F.col("m_time") > 0, F.col("m_time"))).alias("ts"),
        F.col("part_id").alias("entry_id"), F.coalesce("parent", F.lit("")).alias("entry_parent"), "role", F.lit("message").alias("entry_kind"), "text",
    )
    head = about.select("source_key", "path", F.lit(0).cast("bigint").alias("ord"), F.lit("event").alias("kind"), "session_id", "cwd", F.when(F.col("name") != "", F.col("name")).alias("name"))
    failed = bad.join(about, "source_key").select("source_key", "path", F.lit(-1).cast("bigint").alias("ord"), F.lit("error").alias("kind"), F.concat(F.lit("decode data of "), "id").alias("message"))
    out = entry.unionByName(head, allowMissingColumns=True).unionByName(failed, allowMissingColumns=True)
    empty = spark.createDataFrame([], schemas.EVENTS)
    return empty.unionByName(out, allowMissingColumns=True)
