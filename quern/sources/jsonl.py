"""Reading of JSON logs: discovery, tolerant decoding, and the records of each harness.

A file is read by one task, a large one in ranges by many; what it gives are flat event
rows, and everything about a session (bounds, names, numbering, keys) is computed from
those with DataFrame operations in :mod:`.adapters`.

A range begins behind the first line feed at or before it, so every line is read by one
task.  Records are numbered within the range, and ranges report how many they had; sums of
those in the order of ranges give the numbers that one read of the file gives.  A file
that lines don't part into whole records (values over several lines, or one that can't be
decoded) is read again in one piece, so its events and errors are the same, too.
"""

from __future__ import annotations

import json
import os
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import schemas
from ..functions.identity import stable_key_of
from ..functions.times import rfc3339_millis
from ..operators.lineage import cut

#: What a malformed line and a value that can't be decoded are reported as (fixed values).
MALFORMED, UNDECODED = "ignored malformed JSONL line", "decode JSON near byte"
#: Bytes of a range; smaller files are read in one piece.
RANGE = 64 << 20
#: Prefixes of user texts that a tool injected (fixed values).
INJECTED = ("# AGENTS.md instructions", "<environment_context>", "<skill>", "<user_action>")
WRAPPERS = ("<local-command-", "<command-name>", "<command-message>")


def discover(harness: str, root: str, skip: Callable[[str], bool] | None = None, suffix: str = ".jsonl") -> list[dict]:
    """Sources below a root, sorted by path; a missing root has none."""
    found = []
    for folder, folders, files in os.walk(root) if root else ():
        folders[:] = [f for f in folders if not (skip and skip(os.path.join(folder, f)))]
        for name in files:
            path = os.path.join(folder, name)
            if os.path.splitext(name)[1] == suffix and not (skip and skip(path)):
                st = os.stat(path)
                found.append({"source_key": stable_key_of(harness, path), "harness": harness, "path": path, "version": f"json-v2:{st.st_size}:{st.st_mtime_ns}"})
    return sorted(found, key=lambda s: s["path"])


def _no_constant(name: str):
    raise ValueError(f"invalid constant {name}")


def _cut_off(text: str, error: json.JSONDecodeError) -> bool:
    """Whether decoding failed because the text ends."""
    rest = text[error.pos :]
    if not rest.strip() or error.msg.startswith("Unterminated string") or (error.msg.startswith("Invalid \\") and len(rest) < 6):
        return True
    word = rest.strip()
    return word in ("-",) or any(w.startswith(word) for w in ("true", "false", "null"))


def decode_stream(text: str) -> Iterator[object]:
    """Concatenated JSON values; a last one that is cut off is dropped, other errors raise ``ValueError``."""
    decoder = json.JSONDecoder(parse_constant=_no_constant)
    at, size = 0, len(text)
    while True:
        while at < size and text[at] in " \t\r\n":
            at += 1
        if at >= size:
            return
        try:
            value, at = decoder.raw_decode(text, at)
        except json.JSONDecodeError as e:
            if _cut_off(text, e):
                return
            raise ValueError(f"{UNDECODED} {len(text[: e.pos].encode())}: {e.msg}") from None
        yield value


def decode_lines(text: str) -> Iterator[tuple[int, object, str]]:
    """(line number, value, warning) of each non-blank line; a malformed last line without an end is dropped."""
    lines = text.split("\n")
    for n, line in enumerate(lines, 1):
        body = line.strip()
        if not body:
            continue
        try:
            yield n, json.loads(body, parse_constant=_no_constant), ""
        except ValueError:
            if n < len(lines):
                yield n, None, f"{MALFORMED} {n}"


def string(value, key: str) -> str:
    found = value.get(key) if isinstance(value, dict) else None
    return found if isinstance(found, str) else ""


def content_text(content, types: tuple[str, ...]) -> str:
    """A string, or the texts of the blocks of accepted types with a blank line between."""
    if isinstance(content, str):
        return content.strip()
    if not isinstance(content, list):
        return ""
    texts = [b["text"].strip() for b in content if isinstance(b, dict) and b.get("type") in types and isinstance(b.get("text"), str) and b["text"].strip()]
    return "\n\n".join(texts)


def pi_record(v: dict) -> dict:
    kind = string(v, "type")
    if kind == "session":
        return {"session_id": string(v, "id"), "cwd": string(v, "cwd")}
    if kind == "session_info":
        return {"name": string(v, "name") or None}
    if kind in ("compaction", "branch_summary"):
        text = string(v, "summary")
        return {"entry_id": string(v, "id"), "entry_parent": string(v, "parentId"), "role": "assistant", "entry_kind": kind, "text": text} if text.strip() else {}
    message = v.get("message")
    if kind == "message" and isinstance(message, dict) and string(message, "role") in ("user", "assistant"):
        if text := content_text(message.get("content"), ("text",)):
            return {"entry_id": string(v, "id"), "entry_parent": string(v, "parentId"), "role": string(message, "role"), "entry_kind": "message", "text": text}
    return {}


def codex_record(v: dict) -> dict:
    kind, load = string(v, "type"), v.get("payload")
    if kind == "session_meta":
        out = {"session_id": string(load, "id") or string(load, "session_id"), "cwd": string(load, "cwd")}
        git = load.get("git") if isinstance(load, dict) else None
        return out | ({"branch": string(git, "branch"), "remote": string(git, "repository_url")} if isinstance(git, dict) else {})
    if kind == "response_item" and string(load, "type") == "message" and (role := string(load, "role")) in ("user", "assistant"):
        text = content_text(load.get("content"), ("input_text", "output_text", "text"))
        if text and not (role == "user" and text.startswith(INJECTED)):
            return {"entry_id": string(load, "id"), "role": role, "entry_kind": "message", "counts": True, "text": text}
    if kind == "compacted" and (text := string(load, "message")).strip():
        own = string(load, "window_id")
        return {"entry_id": own, "role": "assistant", "entry_kind": "compaction", "counts": not own, "text": text}
    return {}


def claude_record(v: dict) -> dict:
    out = {"session_id": string(v, "sessionId") or None, "cwd": string(v, "cwd") or None, "branch": string(v, "gitBranch") or None}
    kind, message = string(v, "type"), v.get("message")
    if kind not in ("user", "assistant") or v.get("isMeta") is True or not isinstance(message, dict):
        return out
    role = string(message, "role")
    text = content_text(message.get("content"), ("text",))
    if not text or text.startswith(WRAPPERS):
        return out
    return out | {"entry_id": string(v, "uuid"), "entry_parent": string(v, "parentUuid"), "role": role if role in ("user", "assistant") else kind, "entry_kind": "message", "text": text}


RECORDS = {"pi": pi_record, "codex": codex_record, "claude": claude_record}


def events_in(harness: str, source_key: str, path: str, text: str) -> Iterator[dict]:
    """Event rows of one file's text; a failure is one row of the kind ``error`` after those before it."""
    row = {"source_key": source_key, "path": path}
    n = 0
    try:
        values = decode_lines(text) if harness == "codex" else ((i, v, "") for i, v in enumerate(decode_stream(text), 1))
        for n, value, warning in values:
            if warning:
                yield row | {"ord": n, "kind": "warning", "message": warning}
                continue
            if value is None:
                value = {}
            if not isinstance(value, dict):
                raise ValueError(f"record {n} is no object")
            yield row | {"ord": n, "kind": "event", "ts": string(value, "timestamp")} | RECORDS[harness](value)
    except ValueError as e:
        yield row | {"ord": n + 1, "kind": "error", "message": str(e)}


def events_of(harness: str, source_key: str, path: str) -> Iterator[dict]:
    """Event rows of one file."""
    try:
        with open(path, encoding="utf-8", errors="replace", newline="") as f:
            text = f.read()
    except OSError as e:
        yield {"source_key": source_key, "path": path, "ord": 1, "kind": "error", "message": str(e)}
        return
    yield from events_in(harness, source_key, path, text)


def lines_in(path: str, begin: int, end: int | None) -> Iterator[tuple[bytes, bool]]:
    """Lines that begin in a range of a file, and whether a line feed ends them; without an end, up to the file's."""
    with open(path, "rb") as f:
        if begin:
            f.seek(begin - 1)
            f.readline()
        at = f.tell()
        while end is None or at < end:
            line = f.readline()
            if not line:
                return
            at += len(line)
            yield line.removesuffix(b"\n"), line.endswith(b"\n")


def events_in_range(harness: str, source_key: str, path: str, begin: int, end: int | None) -> Iterator[dict]:
    """Event rows of a range, numbered from 1, and one of the kind ``count``; one of the kind ``whole`` if the
    file must be read in one piece."""
    row = {"source_key": source_key, "path": path, "begin": begin}
    n = 0
    try:
        lines = lines_in(path, begin, end)
        for raw, ended in lines:
            text = raw.decode("utf-8", "replace")
            values: list = []
            if harness == "codex":
                n += 1
                if body := text.strip():
                    try:
                        values = [json.loads(body, parse_constant=_no_constant)]
                    except ValueError:
                        if ended:
                            yield row | {"ord": n, "kind": "warning"}
            else:
                values, complete = _whole_values(text)
                if not complete:  # only blank lines may follow what the end of the file cuts off
                    tail = "\n".join([text, *(x.decode("utf-8", "replace") for x, _ in lines)]) if end is None else None
                    if tail is None or tail[len(text) :].strip():
                        raise ValueError(path)
                    values = list(decode_stream(tail))
            for value in values:
                n += harness != "codex"
                if not isinstance(value, dict):
                    raise ValueError(path)
                yield row | {"ord": n, "kind": "event", "ts": string(value, "timestamp")} | RECORDS[harness](value)
        yield row | {"ord": n, "kind": "count"}
    except (OSError, ValueError):
        yield row | {"ord": 0, "kind": "whole"}


def _whole_values(text: str) -> tuple[list, bool]:
    """The values of a line, and whether nothing else is in it."""
    decoder, at, out = json.JSONDecoder(parse_constant=_no_constant), 0, []
    while True:
        while at < len(text) and text[at] in " \t\r\n":
            at += 1
        if at >= len(text):
            return out, True
        try:
            value, at = decoder.raw_decode(text, at)
        except ValueError:
            return out, False
        out.append(value)


def read_events(spark: SparkSession, sources: list[dict], harness: str, range_bytes: int = RANGE) -> DataFrame:
    """Event rows of all files: one task for several small ones, several tasks for a large one."""
    size = {s["source_key"]: int(s["version"].split(":")[1]) for s in sources}
    small = [s for s in sources if size[s["source_key"]] <= range_bytes]
    large = [s for s in sources if size[s["source_key"]] > range_bytes]
    out = spark.createDataFrame([], schemas.EVENTS)
    if small:
        table = spark.createDataFrame([(s["source_key"], s["path"]) for s in small], "source_key string, path string")
        out = _events(table.repartition(min(len(small), 2000)), lambda row: events_of(harness, row.source_key, row.path))
    if not large:
        return out
    # a range a row, made by the tasks from sizes; the last one has no end, as a file may have grown
    files = spark.createDataFrame([(s["source_key"], s["path"], size[s["source_key"]]) for s in large], "source_key string, path string, size bigint")
    begins = files.select("source_key", "path", "size", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("size") - 1, F.lit(range_bytes).cast("bigint"))).alias("begin"))
    ranges = begins.select("source_key", "path", "begin", F.when(F.col("begin") + range_bytes < F.col("size"), F.col("begin") + range_bytes).alias("end"))
    parts = sum(-(-size[s["source_key"]] // range_bytes) for s in large)
    whole = lambda v: None if v is None or v != v else int(v)
    rows = cut(_events(ranges.repartition(min(parts, 20_000)), lambda row: events_in_range(harness, row.source_key, row.path, row.begin, whole(row.end)), f"{schemas.EVENTS}, begin bigint"))
    odd = rows.where("kind = 'whole'").select("source_key", "path").distinct()
    before = F.sum("n").over(Window.partitionBy("source_key").orderBy("begin").rowsBetween(Window.unboundedPreceding, -1))
    offsets = rows.where("kind = 'count'").select("source_key", "begin", F.col("ord").alias("n")).withColumn("before", F.coalesce(before, F.lit(0))).drop("n")  # a row a range
    good = rows.where("kind not in ('count', 'whole')").join(odd.select("source_key"), "source_key", "left_anti").join(offsets, ["source_key", "begin"])
    good = good.withColumn("ord", F.col("ord") + F.col("before"))
    good = good.withColumn("message", F.when(F.col("kind") == "warning", F.concat_ws(" ", F.lit(MALFORMED), F.col("ord").cast("string"))).otherwise(F.col("message")))
    again = _events(odd.repartition("source_key"), lambda row: events_of(harness, row.source_key, row.path))
    return out.unionByName(good.select(out.columns)).unionByName(again)


def read_texts(texts: DataFrame, harness: str) -> DataFrame:
    """Event rows of logs that are rows of a table: (source_key, path, text)."""
    return _events(texts.select("source_key", "path", "text"), lambda row: events_in(harness, row.source_key, row.path, row.text or ""))


def _events(table: DataFrame, read: Callable[..., Iterator[dict]], schema: str = schemas.EVENTS) -> DataFrame:
    columns = schemas.names(schema)

    def frame(rows: list[dict]) -> pd.DataFrame:
        out = pd.DataFrame(rows, columns=columns).astype(object)
        out = out.where(out.notna(), None)
        out["ord"] = out["ord"].astype("int64")
        return out

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            held: list[dict] = []
            for row in batch.itertuples(index=False):
                for e in read(row):
                    held.append(e)
                    if len(held) >= 5000:
                        yield frame(held)
                        held = []
            if held:
                yield frame(held)

    # times come as they are written and are read in the JVM
    return table.mapInPandas(run, schema.replace("ts bigint", "ts string")).withColumn("ts", rfc3339_millis(F.col("ts")))
