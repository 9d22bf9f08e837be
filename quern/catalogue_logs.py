"""Queries over logs, session databases and record files whose text is made from the driver's tables.

The tables' rows are written out in the formats of the sources, and the library's own
readers read them back; the SQL twins say what must come out.
"""

from __future__ import annotations

import json
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import corpora
from . import corpora_sql as S
from .functions import times
from .operators import maintenance
from .sources import adapters, jsonl, records, sqlite

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def mapped(function: Callable, kind: str, *cols: Column) -> Column:
    """A function of the library over columns, nulls included."""

    @F.pandas_udf(kind)
    def run(*values: pd.Series) -> pd.Series:
        return pd.Series([function(*v) for v in zip(*values, strict=True)], dtype=object)

    return run(*cols)


# --- logs made from conversations -----------------------------------------------------

#: Second 0 of the made logs.
BEGIN = 1767225600


def clock(second: Column) -> Column:
    return F.date_format(F.timestamp_seconds(second), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def obj(**fields) -> Column:
    return F.struct(*[(v if isinstance(v, Column) else F.lit(v)).alias(k) for k, v in fields.items()])


def log_texts(spark, d, head: Callable, line: Callable, tail: Column | None = None) -> DataFrame:
    """(source_key, path, text): a log of each conversation, its turns in order."""
    c = corpora.read(spark, d, "conversations").where("conv_id is not null")
    rows = c.select("conv_id", "turn", F.to_json(line()).alias("line"))
    rows = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "line"))).alias("rows"))
    lines = F.concat(F.array(*[F.to_json(h) for h in head()]), F.transform("rows", lambda r: r["line"]))
    text = F.array_join(lines, "\n")
    key = F.col("conv_id").cast("string")
    return rows.select(F.concat(F.lit("s"), key).alias("source_key"), F.concat(F.lit("/logs/"), key).alias("path"), (text if tail is None else F.concat(text, tail)).alias("text"))


def conv_name() -> Column:
    return F.concat(F.lit("conv-"), F.col("conv_id").cast("string"))


def at_turn(n: int = 1) -> Column:
    return clock(F.lit(BEGIN) + F.col("conv_id") * 100 + F.col("turn") + n)


def numbered(prefix: str, col: str = "turn") -> Column:
    return F.concat(F.lit(prefix), F.col(col).cast("string"))


def parsed(spark, d, harness: str, texts: DataFrame) -> adapters.Parsed:
    return adapters.assemble(jsonl.read_texts(texts, harness), harness, texts.select("source_key", "path"))


def codex(spark, d) -> adapters.Parsed:
    """Messages with and without identifiers, texts that a tool put in, compactions, a broken line at the end of some."""
    said = F.when((F.col("conv_id") % 4 == 1) & (F.col("turn") % 4 == 0), F.concat(F.lit("<skill> "), F.col("text"))).otherwise(F.col("text"))

    def head():
        git = obj(branch=F.concat(F.lit("topic"), (F.col("conv_id") % 3).cast("string")), repository_url="https://host/o/r.git")
        return [obj(type="session_meta", timestamp=clock(F.lit(BEGIN) + F.col("conv_id") * 100), payload=obj(id=conv_name(), cwd=F.concat(F.lit("/work/p"), (F.col("conv_id") % 5).cast("string")), git=git))]

    def line():
        system = F.col("role") == "system"
        content = F.array(obj(type=F.when(F.col("role") == "user", "input_text").otherwise("output_text"), text=said))
        load = F.struct(
            F.when(~system, F.lit("message")).alias("type"), F.when(~system, F.col("role")).alias("role"), F.when(~system, content).alias("content"),
            F.when(~system & (F.col("turn") % 3 == 2), numbered("m")).alias("id"), F.when(system, F.col("text")).alias("message"),
        )
        return obj(type=F.when(system, "compacted").otherwise("response_item"), timestamp=at_turn(), payload=load)

    return parsed(spark, d, "codex", log_texts(spark, d, head, line, F.when(F.col("conv_id") % 6 == 0, F.lit('\n{"type": \n')).otherwise(F.lit(""))))


CODEX_SQL = f"""codex AS (
  SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) + 1 AS ord,
    trim(text, ' ' || chr(9) || chr(10) || chr(13)) AS body, conv_id % 4 = 1 AND turn % 4 = 0 AND role = 'user' AS injected,
    CASE WHEN conv_id % 4 = 1 AND turn % 4 = 0 AND role <> 'system' THEN '<skill> ' ELSE '' END AS before, ({BEGIN} + conv_id * 100 + turn + 1) * 1000 AS ms
  FROM conversations WHERE conv_id IS NOT NULL),
left_ AS (
  SELECT *, count(*) OVER (PARTITION BY conv_id ORDER BY turn) AS nth, CASE WHEN role = 'system' THEN 'compaction' ELSE 'message' END AS kind
  FROM codex WHERE NOT injected AND body <> '')"""


@query(f"WITH {CODEX_SQL} SELECT 'conv-' || conv_id AS native_id, ({BEGIN} + conv_id * 100) * 1000 AS started_at, max(ms) AS updated_at FROM codex GROUP BY conv_id")
def session_bounds(spark, d):
    return codex(spark, d).sessions.select("native_id", "started_at", "updated_at")


@query(
    f"""WITH {CODEX_SQL} SELECT 'conv-' || c.conv_id AS native_id, {S.title("f.said")} AS name
FROM (SELECT DISTINCT conv_id FROM codex) c LEFT JOIN (SELECT conv_id, arg_min(before || body, turn) AS said FROM left_ WHERE role = 'user' GROUP BY conv_id) f USING (conv_id)"""
)
def session_first_user(spark, d):
    return codex(spark, d).sessions.select("native_id", "name")


@query(
    f"""WITH {CODEX_SQL} SELECT 'conv-' || conv_id AS native_id, ord::BIGINT AS ord, kind, ms AS timestamp,
  CASE WHEN role <> 'system' AND turn % 3 = 2 THEN 'm' || turn ELSE kind || '-' || nth END AS entry_native_id FROM left_"""
)
def codex_ordinal(spark, d):
    """Entries without an identifier are numbered by those that count."""
    p = codex(spark, d)
    return p.entries.join(p.sessions.select("session_key", "native_id"), "session_key").select("native_id", "ord", "kind", "timestamp", "entry_native_id")


@query(f"WITH {CODEX_SQL} SELECT 'conv-' || conv_id AS native_id, ord::BIGINT AS ord, CASE WHEN role = 'system' THEN 'assistant' ELSE role END AS role, CASE WHEN role = 'system' THEN text ELSE before || body END AS text FROM left_")
def injected_texts(spark, d):
    """What is left once texts that a tool put in are gone."""
    p = codex(spark, d)
    return p.entries.join(p.sessions.select("session_key", "native_id"), "session_key").select("native_id", "ord", "role", "text")


@query("SELECT '/logs/' || conv_id AS path, 'ignored malformed JSONL line ' || (count(*) + 2) AS message FROM conversations WHERE conv_id % 6 = 0 GROUP BY conv_id")
def codex_warnings(spark, d):
    return codex(spark, d).warnings.select("path", "message")


def claude(spark, d) -> adapters.Parsed:
    """Strings and blocks, notes of the tool itself, wrapped commands; places that change on the way."""
    t = F.col("turn")
    said = F.when((F.col("conv_id") % 7 == 3) & (t == 0), F.concat(F.lit("<command-name>"), F.col("text"))).otherwise(F.col("text"))

    def line():
        blocks = F.to_json(F.array(obj(type="text", text=said), obj(type="tool_use", text="no"), obj(type="text", text=F.lit("  "))))
        content = F.when(F.col("role") == "assistant", F.parse_json(blocks)).otherwise(F.parse_json(F.regexp_extract(F.to_json(obj(x=said)), r'(?s)^\{"x":(.*)\}$', 1)))
        return F.struct(
            F.col("role").alias("type"), conv_name().alias("sessionId"), numbered("u").alias("uuid"), F.when(t > 0, F.concat(F.lit("u"), (t - 1).cast("string"))).alias("parentUuid"), at_turn().alias("timestamp"),
            F.when(t % 2 == 0, numbered("/work/p")).alias("cwd"), F.when(t % 3 == 0, numbered("b")).alias("gitBranch"), F.when(t % 5 == 4, F.lit(True)).alias("isMeta"), obj(role=F.col("role"), content=content).alias("message"),
        )

    return parsed(spark, d, "claude", log_texts(spark, d, lambda: [obj(type="mode", mode="x", sessionId=conv_name())], line))


@query("SELECT 'conv-' || conv_id AS native_id, coalesce(arg_max('/work/p' || turn, turn) FILTER (WHERE turn % 2 = 0), '') AS cwd, coalesce(arg_max('b' || turn, turn) FILTER (WHERE turn % 3 = 0), '') AS git_branch FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id")
def session_last_nonempty(spark, d):
    return claude(spark, d).sessions.select("native_id", "cwd", "git_branch")


@query(
    f"""SELECT 'conv-' || conv_id AS native_id, 'u' || turn AS entry_native_id, CASE WHEN turn > 0 THEN 'u' || (turn - 1) ELSE '' END AS entry_parent_id, role,
  ({BEGIN} + conv_id * 100 + turn + 1) * 1000 AS timestamp, trim(text, ' ' || chr(9) || chr(10) || chr(13)) AS text
FROM conversations WHERE conv_id IS NOT NULL AND role IN ('user', 'assistant') AND turn % 5 <> 4 AND NOT (conv_id % 7 = 3 AND turn = 0) AND trim(text, ' ' || chr(9) || chr(10) || chr(13)) <> ''"""
)
def claude_entries(spark, d):
    p = claude(spark, d)
    return p.entries.join(p.sessions.select("session_key", "native_id"), "session_key").select("native_id", "entry_native_id", "entry_parent_id", "role", "timestamp", "text")


def pi(spark, d) -> adapters.Parsed:
    def head():
        named = F.when(F.col("conv_id") % 2 == 0, F.concat(F.lit("Talk "), F.col("conv_id").cast("string")))
        return [obj(type="session", id=conv_name(), cwd="/work", timestamp=clock(F.lit(BEGIN) + F.col("conv_id") * 100)), obj(type="session_info", name=named)]

    def line():
        system = F.col("role") == "system"
        message = obj(role=F.col("role"), content=F.array(obj(type="text", text=F.col("text")), obj(type="thinking", text="hm")))
        return F.struct(
            F.when(system, "compaction").otherwise("message").alias("type"), numbered("e").alias("id"), F.when(F.col("turn") % 2 == 1, F.lit("e0")).alias("parentId"),
            at_turn().alias("timestamp"), F.when(system, F.col("text")).alias("summary"), F.when(~system, message).alias("message"),
        )

    return parsed(spark, d, "pi", log_texts(spark, d, head, line))


@query(
    f"""SELECT 'conv-' || conv_id AS native_id, 'e' || turn AS entry_native_id, CASE WHEN turn % 2 = 1 THEN 'e0' ELSE '' END AS entry_parent_id,
  CASE WHEN role = 'system' THEN 'compaction' ELSE 'message' END AS kind, CASE WHEN role = 'system' THEN 'assistant' ELSE role END AS role, ({BEGIN} + conv_id * 100 + turn + 1) * 1000 AS timestamp,
  CASE WHEN role = 'system' THEN text ELSE trim(text, ' ' || chr(9) || chr(10) || chr(13)) END AS text
FROM conversations WHERE conv_id IS NOT NULL AND trim(text, ' ' || chr(9) || chr(10) || chr(13)) <> ''"""
)
def pi_entries(spark, d):
    p = pi(spark, d)
    return p.entries.join(p.sessions.select("session_key", "native_id"), "session_key").select("native_id", "entry_native_id", "entry_parent_id", "kind", "role", "timestamp", "text")


@query(
    f"""SELECT 'conv-' || c.conv_id AS native_id, CASE WHEN c.conv_id % 2 = 0 THEN 'Talk ' || c.conv_id ELSE {S.title("f.said")} END AS name
FROM (SELECT DISTINCT conv_id FROM conversations WHERE conv_id IS NOT NULL) c
LEFT JOIN (SELECT conv_id, arg_min(text, turn) AS said FROM conversations WHERE role = 'user' GROUP BY conv_id) f USING (conv_id)"""
)
def pi_names(spark, d):
    return pi(spark, d).sessions.select("native_id", "name")


# --- a session database made from conversations ---------------------------------------


@query(
    """WITH c AS (SELECT *, 1000 + turn * 10 AS t0, trim(text, ' ' || chr(9) || chr(10) || chr(13)) AS body FROM conversations WHERE conv_id IS NOT NULL AND role IN ('user', 'assistant')),
parts AS (
  SELECT *, 0 AS part, body AS said, CASE WHEN turn % 2 = 0 THEN t0 + 5 ELSE t0 END AS ms FROM c WHERE body <> ''
  UNION ALL SELECT *, 1, 'more of ' || turn, t0 + 7 FROM c)
SELECT 'conv-' || conv_id AS native_id, turn || '-' || part AS entry_native_id, CASE WHEN turn > 0 THEN lpad((turn - 1)::VARCHAR, 9, '0') ELSE '' END AS entry_parent_id,
  role, ms::BIGINT AS timestamp, said AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn, CASE WHEN part = 0 AND turn % 2 = 1 THEN 0 ELSE ms END, part) AS ord FROM parts"""
)
def message_part_join(spark, d):
    """Messages and their parts in order; synthetic parts and those of tools are none."""
    c = corpora.read(spark, d, "conversations").where("conv_id is not null")
    t = F.col("turn")
    key = F.concat(F.lit("s"), F.col("conv_id").cast("string")).alias("source_key")
    mid, at = F.lpad(t.cast("string"), 9, "0"), F.lit(1000) + t * 10
    data = F.to_json(F.struct(F.col("role").alias("role"), F.when(t > 0, F.lpad((t - 1).cast("string"), 9, "0")).alias("parentID")))
    messages = c.select(key, conv_name().alias("native_id"), F.lit("message").alias("kind"), mid.alias("id"), mid.alias("message_id"), at.alias("time_created"), data.alias("data"))

    def part(n: int, when: Column, **fields) -> DataFrame:
        return c.select(key, conv_name().alias("native_id"), F.lit("part").alias("kind"), F.concat(t.cast("string"), F.lit(f"-{n}")).alias("id"), mid.alias("message_id"), when.alias("time_created"), F.to_json(obj(**fields)).alias("data"))

    rows = messages.unionByName(part(0, F.when(t % 2 == 0, at + 5).otherwise(0), type="text", text=F.col("text"))).unionByName(part(1, at + 7, type="text", text=numbered("more of ")))
    rows = rows.unionByName(part(2, at + 8, type="text", text="made up", synthetic=True)).unionByName(part(3, at + 9, type="tool", text="no")).unionByName(part(4, at + 9, type="text", text="  "))
    about = c.select(key, F.lit("/db").alias("path"), conv_name().alias("session_id"), F.lit("/work").alias("cwd"), F.lit("t").alias("name")).distinct()
    known = about.select("source_key", "path", F.lit("").alias("parent_id"), F.lit(1).cast("bigint").alias("started_at"), F.lit(2).cast("bigint").alias("updated_at"))
    p = adapters.assemble(sqlite.events(rows, about), "opencode", known)
    return p.entries.join(p.sessions.select("session_key", "native_id"), "session_key").select("native_id", "entry_native_id", "entry_parent_id", "role", "timestamp", "text", "ord")


# --- values of logs --------------------------------------------------------------------


@query("SELECT event_id, 'v' || event_id AS k FROM events WHERE event_id % 3 <> 0")
def json_type_filter(spark, d):
    """Only strings are strings: a number under the same name is none."""
    i = F.col("event_id")
    text = F.when(i % 3 == 0, F.concat(F.lit('{"k": '), i.cast("string"), F.lit("}"))).otherwise(F.concat(F.lit('{"k": "v'), i.cast("string"), F.lit('"}')))
    e = corpora.read(spark, d, "events").select("event_id", mapped(lambda x: jsonl.string(json.loads(x), "k"), "string", text).alias("k"))
    return e.where("k <> ''")


@query("SELECT event_id, CASE event_id % 4 WHEN 0 THEN (epoch_us(ts) // 1000) END AS ms FROM events")
def rfc3339_millis(spark, d):
    """Times in RFC 3339 only: dates, other forms and nonsense are unknown."""
    t = F.col("ts").cast("timestamp")
    day, second, fraction = F.date_format(t, "yyyy-MM-dd"), F.date_format(t, "HH:mm:ss"), F.date_format(t, "SSSSSS")
    i = F.col("event_id") % 4
    text = F.when(i == 0, F.concat(day, F.lit("T"), second, F.lit("."), fraction, F.lit("Z"))).when(i == 1, day).when(i == 2, F.concat(day, F.lit(" "), second)).otherwise("soon")
    return corpora.read(spark, d, "events").select("event_id", times.rfc3339_millis(text).alias("ms"))


@query(
    """SELECT event_id, CASE WHEN event_id % 2 = 0 THEN epoch_us(date_trunc('day', ts)) // 1000 ELSE epoch_us(date_trunc('second', ts)) // 1000 END AS since,
  CASE WHEN event_id % 2 = 0 THEN epoch_us(date_trunc('day', ts)) // 1000 + 86399999 ELSE epoch_us(date_trunc('second', ts)) // 1000 END AS before FROM events"""
)
def parse_dates(spark, d):
    """Bounds of a filter: a day begins with its first and ends with its last millisecond."""
    t = F.col("ts").cast("timestamp")
    text = F.when(F.col("event_id") % 2 == 0, F.date_format(t, "yyyy-MM-dd")).otherwise(F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    e = corpora.read(spark, d, "events").select("event_id", text.alias("t"))
    return e.select("event_id", times.bound_millis(F.col("t")).alias("since"), times.bound_millis(F.col("t"), True).alias("before"))


@query("SELECT conv_id, turn, trim(text, ' ' || chr(10) || chr(9)) || CASE WHEN turn % 2 = 0 THEN chr(10) || chr(10) || 'more' ELSE '' END AS body FROM conversations")
def content_blocks(spark, d):
    """Text of a message's content: a string, or the text blocks of a list."""
    blocks = F.to_json(F.array(obj(type="text", text=F.col("text")), obj(type="image", text="no"), obj(type="text", text="  "), obj(type="text", text=" more ")))
    plain = F.to_json(F.array(F.concat(F.lit(" "), F.col("text"), F.lit("\n"))))
    whole = F.col("turn") % 2 == 0
    body = mapped(lambda x, w: jsonl.content_text(json.loads(x) if w else json.loads(x)[0], ("text",)), "string", F.when(whole, blocks).otherwise(plain), whole)
    return corpora.read(spark, d, "conversations").select("conv_id", "turn", body.alias("body"))


# --- sets of sources -------------------------------------------------------------------


@query("SELECT n_name AS harness FROM nation UNION SELECT r_name FROM region UNION SELECT event_type FROM events")
def harness_union(spark, d):
    parts = [corpora.read(spark, d, t).select(F.col(c).alias("harness")) for t, c in (("nation", "n_name"), ("region", "r_name"), ("events", "event_type"))]
    return maintenance.named_harnesses(*parts)


@query("SELECT o_custkey FROM orders EXCEPT SELECT user_id FROM events")
def set_difference(spark, d):
    found = corpora.read(spark, d, "events").select(F.col("user_id").alias("o_custkey"))
    return maintenance.vanished(corpora.read(spark, d, "orders"), found, "o_custkey")


# --- record files ----------------------------------------------------------------------


@query("SELECT id, count(*) OVER () AS n_matches FROM (SELECT 'm_' || lpad(doc_id::VARCHAR, 8, '0') AS id FROM documents WHERE doc_id % 3 <> 1) WHERE starts_with(id, 'm_0000001')")
def id_prefix(spark, d):
    """Records whose identifier begins so, by the names of their files; others are no records."""
    name = F.concat(F.lit("m_"), F.lpad(F.col("doc_id").cast("string"), 8, "0"), F.when(F.col("doc_id") % 3 == 1, ".json.bak").otherwise(".json"))
    m = corpora.read(spark, d, "documents").select(records.id_column(name).alias("id")).where(F.startswith("id", F.lit("m_0000001")))
    return m.crossJoin(F.broadcast(m.agg(F.count("*").alias("n_matches"))))


CONFLICT_SQL = r"'(?i)^(.+)\.sync-conflict-\d{8}-\d{6}-[a-z0-9]+(\.[^.]+)$'"


@query(
    f"""WITH names AS (SELECT 'm_' || (doc_id // 4) || CASE doc_id % 4 WHEN 0 THEN '.json' WHEN 1 THEN '.sync-conflict-20260101-000000-ABC' || doc_id || '.json'
    WHEN 2 THEN '.SYNC-conflict-20260101-000000-x1.json' ELSE '.sync-conflict-2026-x.json' END AS name FROM documents)
SELECT regexp_extract(name, {CONFLICT_SQL}, 1) || regexp_extract(name, {CONFLICT_SQL}, 2) AS canonical, string_agg(name, ',' ORDER BY name) AS copies
FROM names WHERE regexp_matches(name, {CONFLICT_SQL}) GROUP BY 1"""
)
def conflict_scan(spark, d):
    """Conflict copies by the record they belong to."""
    i = F.col("doc_id")
    end = (
        F.when(i % 4 == 0, ".json")
        .when(i % 4 == 1, F.concat(F.lit(".sync-conflict-20260101-000000-ABC"), i.cast("string"), F.lit(".json")))
        .when(i % 4 == 2, ".SYNC-conflict-20260101-000000-x1.json")
        .otherwise(".sync-conflict-2026-x.json")
    )
    n = corpora.read(spark, d, "documents").select(F.concat(F.lit("m_"), F.floor(i / 4).cast("string"), end).alias("name"))
    n = n.withColumn("canonical", records.canonical_column(F.col("name"))).where("canonical is not null")
    return n.groupBy("canonical").agg(F.array_join(F.sort_array(F.collect_list("name")), ",").alias("copies"))


def record_files(spark, d) -> DataFrame:
    """(doc_id, path, raw): a record file per document; some break a rule by their number."""
    i = F.col("doc_id")
    time = lambda n: clock(F.lit(BEGIN) + n)
    rev = lambda n, body: F.struct(n.cast("int").alias("revision"), body.alias("content"), time(n).alias("createdAt"))
    is_global = i % 5 == 0
    named = F.concat(F.lit("m_"), F.lpad(i.cast("string"), 8, "0"))
    r = F.struct(
        F.when(i % 13 == 1, 2).otherwise(1).alias("schemaVersion"), F.when(i % 13 == 2, F.lit("bad id")).otherwise(named).alias("id"), F.when(is_global, "global").otherwise("project").alias("scope"),
        F.when(is_global, F.when(i % 13 == 4, "odd").otherwise("")).otherwise("key").alias("projectKey"), F.when(is_global, "").otherwise("name").alias("projectName"),
        F.when(is_global & (i % 13 == 9), "git@host:o/r").alias("projectRemote"), time(F.lit(0)).alias("createdAt"), time(F.when(i % 13 == 5, -1).otherwise(10)).alias("updatedAt"),
        F.when(i % 7 == 0, time(F.when(i % 13 == 6, -5).otherwise(5))).alias("archivedAt"), F.when(i % 13 == 7, 1).otherwise(2).alias("currentRevision"),
        F.array(rev(F.lit(1), F.when(i % 13 == 8, " ").otherwise("first")), rev(F.when(i % 13 == 3, 3).otherwise(2), F.col("text"))).alias("revisions"), F.when(i % 13 == 10, "x").alias("colour"),
    )
    path = F.concat(F.lit("/records/"), F.when(i % 13 == 11, "m_other000").otherwise(named), F.lit(".json"))
    return corpora.read(spark, d, "documents").select("doc_id", path.alias("path"), F.to_json(r).alias("raw"))


BROKEN_SQL = """CASE
  WHEN doc_id % 13 = 1 THEN 'the schema version is not 1' WHEN doc_id % 13 = 2 THEN 'the identifier is malformed'
  WHEN doc_id % 5 = 0 AND doc_id % 13 IN (4, 9) THEN 'a global record names a project'
  WHEN doc_id % 13 = 5 THEN 'the change is before the creation' WHEN doc_id % 7 = 0 AND doc_id % 13 = 6 THEN 'the archiving is before the creation'
  WHEN doc_id % 13 = 7 THEN 'the current revision is not the last one' WHEN doc_id % 13 = 3 THEN 'revision numbers have gaps'
  WHEN doc_id % 13 = 8 OR trim(coalesce(text, '')) = '' THEN 'a revision is empty' END"""


@query(f"SELECT doc_id, {BROKEN_SQL} AS error FROM documents")
def record_validate(spark, d):
    return record_files(spark, d).select("doc_id", mapped(lambda raw: records.problem(json.loads(raw)) or None, "string", F.col("raw")).alias("error"))


@query(f"SELECT error AS type, count(*) AS n FROM (SELECT {BROKEN_SQL} AS error FROM documents) WHERE error IS NOT NULL GROUP BY 1")
def warning_counts(spark, d):
    found = record_files(spark, d).select(mapped(lambda raw: records.problem(json.loads(raw)), "string", F.col("raw")).alias("type"))
    return found.where("type <> ''").groupBy("type").agg(F.count("*").alias("n"))


def read_record(path: str, raw: str) -> str | None:
    """The revisions of a record file as the store reads it; None if it refuses the file."""
    try:
        return json.dumps(records.parse(path, raw.encode())["revisions"])
    except ValueError:
        return None


@query(
    f"""WITH good AS (SELECT doc_id, text FROM documents WHERE {BROKEN_SQL} IS NULL AND doc_id % 13 NOT IN (10, 11))
SELECT doc_id, 1 AS revision, 'first' AS content FROM good UNION ALL SELECT doc_id, 2, text FROM good"""
)
def revision_history(spark, d):
    """Revisions of the files that the store accepts: no unknown fields, named like the record."""
    read = record_files(spark, d).select("doc_id", mapped(read_record, "string", F.col("path"), F.col("raw")).alias("r")).where("r is not null")
    return read.select("doc_id", F.inline(F.from_json("r", "array<struct<revision:int,content:string>>")))
