import datetime as dt
import json
import os
import sqlite3

import pytest

from quern.sources import adapters, jsonl, sqlite
from quern.sources.records import RecordStore, parse


def write(path, rows, tail=""):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("\n".join(r if isinstance(r, str) else json.dumps(r) for r in rows) + tail)


def run(spark, harness, root):
    found = adapters.discover(harness, str(root))
    p = adapters.parse(spark, harness, found)
    return found, [r.asDict() for r in p.sessions.collect()], [r.asDict() for r in p.entries.orderBy("source_key", "ord").collect()], p.warnings.collect(), p.errors.collect()


def message(role, *texts, kind="text"):
    return {"role": role, "content": [{"type": kind, "text": t} for t in texts]}


def test_pi(spark, tmp_path):
    t = "2026-01-02T03:04:0{}Z".format
    write(tmp_path / "a" / "one.jsonl", [
        {"type": "session", "version": 3, "id": "s1", "timestamp": t(0), "cwd": "/w"}, {"type": "session_info", "id": "i", "timestamp": t(1), "name": "Named"},
        {"type": "message", "id": "m1", "timestamp": t(2), "message": message("user", "hello", "there")},
        {"type": "message", "id": "m2", "parentId": "m1", "timestamp": t(3), "message": {"role": "assistant", "content": [{"type": "thinking", "text": "x"}, {"type": "text", "text": " answer "}]}},
        {"type": "message", "id": "m3", "timestamp": t(4), "message": message("tool", "no")}, {"type": "compaction", "id": "c1", "parentId": "m2", "timestamp": t(5), "summary": "sum "},
    ], '\n{"type": "mess')
    (tmp_path / "empty.jsonl").write_text("")
    (tmp_path / "bad.jsonl").write_text('{"type": "session", "id": "s2"}\n{"a": }\n')
    (tmp_path / "array.jsonl").write_text("[1]")
    (tmp_path / "not.JSONL").write_text("{}")
    found, sessions, entries, _, errors = run(spark, "pi", tmp_path)
    assert [os.path.basename(f["path"]) for f in found] == ["one.jsonl", "array.jsonl", "bad.jsonl", "empty.jsonl"]
    (s,) = sessions
    assert (s["native_id"], s["name"], s["cwd"]) == ("s1", "Named", "/w") and s["updated_at"] - s["started_at"] == 5000
    assert [(e["role"], e["kind"], e["text"]) for e in entries] == [("user", "message", "hello\n\nthere"), ("assistant", "message", "answer"), ("assistant", "compaction", "sum ")]
    said = {os.path.basename(e["path"]): e["error"] for e in errors}
    assert set(said) == {"empty.jsonl", "bad.jsonl", "array.jsonl"} and "missing session header" in said["empty.jsonl"] and "near byte" in said["bad.jsonl"]


def test_codex(spark, tmp_path):
    item = lambda role, text, **k: {"type": "response_item", "payload": {"type": "message", "role": role, "content": [{"type": "input_text", "text": text}], **k}}
    write(tmp_path / "x.jsonl", [
        {"type": "session_meta", "timestamp": "2026-01-01T00:00:00.5+01:00", "payload": {"session_id": "c1", "cwd": "/c", "git": {"branch": "main", "repository_url": "r"}}},
        item("user", "<environment_context> x"), item("user", "question"), "{broken", "", item("assistant", "reply", id="own"), {"type": "event_msg", "payload": {}},
        {"type": "compacted", "payload": {"message": "short"}}, {"type": "compacted", "payload": {"message": "two", "window_id": "w9"}}, item("assistant", "end"),
    ], "\n{cut")
    _, (s,), entries, warnings, errors = run(spark, "codex", tmp_path)
    assert (s["git_branch"], s["git_remote"], s["name"]) == ("main", "r", "question") and not errors
    assert [e["entry_native_id"] for e in entries] == ["message-1", "own", "compaction-3", "w9", "message-4"]
    assert [w["message"] for w in warnings] == ["ignored malformed JSONL line 4"]


def test_claude(spark, tmp_path):
    base = {"sessionId": "k1", "cwd": "/k", "gitBranch": "b", "timestamp": "2026-01-01T00:00:00Z"}
    write(tmp_path / "p" / "y.jsonl", [
        {"type": "user", "isMeta": True, "message": message("user", "meta"), **base}, {"type": "user", "uuid": "u1", "message": {"role": "user", "content": "<command-name>x"}, **base},
        {"type": "user", "uuid": "u2", "message": {"role": "user", "content": " ask "}, **base}, {"type": "assistant", "uuid": "u3", "message": {"role": "odd", "content": [{"type": "text", "text": "say"}]}, **base},
    ])
    write(tmp_path / "p" / "subagents" / "z.jsonl", [base])
    write(tmp_path / "q.jsonl", [{"type": "mode", "mode": "m", "sessionId": "k2"}, {"type": "system", "content": "c", **base, "sessionId": "k2"}])
    found, sessions, entries, _, _ = run(spark, "claude", tmp_path)
    assert len(found) == 2 and {s["native_id"] for s in sessions} == {"k1", "k2"}
    assert [(e["role"], e["text"]) for e in entries] == [("user", "ask"), ("assistant", "say")]
    assert {s["native_id"]: s["name"] for s in sessions} == {"k1": "ask", "k2": "Untitled session"}


#: The tables of the format (fixed values).
TABLES = {
    "session": "id text primary key, parent_id text, directory text, title text, time_created int, time_updated int",
    "message": "id text primary key, session_id text, time_created int, data text",
    "part": "id text primary key, message_id text, session_id text, time_created int, data text",
}


def database(path, **rows):
    con = sqlite3.connect(path)
    for name, columns in TABLES.items():
        con.execute(f"create table {name}({columns})")
        for r in rows.get(name, ()):
            con.execute(f"insert into {name} values ({', '.join('?' * len(r))})", r)
    con.commit()
    con.close()
    return str(path)


def test_database_of_sessions(spark, tmp_path):
    """A talk told out of order, its branch, one that is broken and one without a word."""
    part = lambda **data: json.dumps(data)
    path = database(
        tmp_path / "talks.db",
        session=[("talk", "", "/garden", "Roses", 50, 900), ("twig", "talk", "/garden", "", 60, 800), ("torn", None, None, "Torn", 70, 700), ("mute", None, "/m", "Mute", 80, 600)],
        message=[("late", "talk", 300, part(role="assistant", parentID="mid")), ("mid", "talk", 200, part(role="user")), ("early", "talk", 100, part(role="system")), ("one", "twig", 10, part(role="user")), ("bad", "torn", 10, "{not json"), ("ok", "torn", 11, part(role="user"))],
        part=[("z", "late", "talk", 301, part(type="text", text="second answer")), ("y", "late", "talk", 299, part(type="text", text="\n first answer ")), ("x", "mid", "talk", 0, part(type="text", text="which roses")), ("w", "early", "talk", 1, part(type="text", text="be brief")),
              ("v", "mid", "talk", 2, part(type="text", text="pasted", synthetic=True)), ("u", "mid", "talk", 3, part(type="tool", text="run")), ("t", "one", "twig", 5, part(type="text", text="and thorns")), ("s", "one", "twig", 6, part(type="text", text="   ")), ("r", "ok", "torn", 1, part(type="text", text="unread"))],
    )
    found, sessions, entries, _, errors = run(spark, "opencode", path)
    assert [f["native_id"] for f in found] == ["mute", "talk", "torn", "twig"]
    about = {s["native_id"]: (s["name"], s["parent_id"], s["cwd"], s["started_at"], s["updated_at"]) for s in sessions}
    assert about == {"talk": ("Roses", "", "/garden", 50, 900), "twig": ("and thorns", "talk", "/garden", 60, 800), "mute": ("Mute", "", "/m", 80, 600)}
    said = sorted((e["entry_native_id"], e["entry_parent_id"], e["role"], e["timestamp"], e["text"]) for e in entries)
    assert said == [("t", "", "user", 5, "and thorns"), ("x", "", "user", 200, "which roses"), ("y", "mid", "assistant", 299, "first answer"), ("z", "mid", "assistant", 301, "second answer")]
    assert [e["entry_native_id"] for e in sorted((e for e in entries if e["entry_native_id"] != "t"), key=lambda e: e["ord"])] == ["x", "y", "z"]
    assert len(errors) == 1 and "decode data of bad" in errors[0]["error"]


def test_database_without_columns(tmp_path):
    path = database(tmp_path / "old.db")
    con = sqlite3.connect(path)
    con.execute("alter table part rename column data to body")
    con.execute("alter table part drop column time_created")
    con.commit()
    with pytest.raises(ValueError, match="part lacks columns: data, time_created"):
        sqlite.discover(path)


def test_missing_roots(spark):
    assert all(adapters.discover(h, "/no/such/place") == [] for h in ("pi", "codex", "claude", "opencode"))


def test_streams():
    assert list(jsonl.decode_stream('{"a":1}{"b":2} null [3]')) == [{"a": 1}, {"b": 2}, None, [3]]
    for cut in ('{"a":1} {"b": "x', '{"a":1} {"b": tr', '{"a":1} {"b"', '{"a":1} ['):
        assert list(jsonl.decode_stream(cut)) == [{"a": 1}]
    with pytest.raises(ValueError):
        list(jsonl.decode_stream('{"a": NaN}'))


def store(tmp_path, ids=("m_aaaa01", "m_aaaa02", "m_bbbb01")):
    ticks = iter(range(100))
    names = iter(ids)
    return RecordStore(str(tmp_path), lambda: dt.datetime(2026, 1, 1, tzinfo=dt.UTC) + dt.timedelta(seconds=next(ticks)), lambda: next(names))


def test_records(spark, tmp_path):
    s = store(tmp_path)
    r = s.create("global", " first ")
    assert r["revisions"][0]["content"] == "first" and os.stat(s.path(r["id"])).st_mode & 0o777 == 0o600
    s.create("project", "second", "", "host/p", "", "p")
    assert s.edit("m_aaaa01", "changed")["currentRevision"] == 2
    with pytest.raises(ValueError, match="ambiguous: m_aaaa01, m_aaaa02"):
        s.load("m_aaaa")
    with pytest.raises(KeyError):
        s.load("m_zz")
    s.forget("m_aaaa02")
    with pytest.raises(ValueError, match="already archived"):
        s.forget("m_aaaa02")
    assert s.restore("m_aaaa02")["archivedAt"] is None
    with pytest.raises(ValueError):
        s.create("global", " ")
    rows, warnings = s.scan(spark)
    assert {r["id"]: r["content"] for r in rows.collect()} == {"m_aaaa01": "changed", "m_aaaa02": "second"} and not warnings


def test_conflicts_and_invalid(spark, tmp_path):
    s = store(tmp_path)
    s.create("global", "x")
    copy = os.path.join(s.records, "m_aaaa01.sync-conflict-20260101-000000-ABCDEFG.json")
    open(copy, "w").write("{}")
    open(os.path.join(s.records, "m_cccc01.json"), "w").write('{"schemaVersion": 1, "odd": 2}')
    rows, warnings = s.scan(spark)
    assert [w["type"] for w in warnings] == ["syncthing_conflict"] and warnings[0]["conflictPaths"] == [copy] and warnings[0]["memoryId"] == "m_aaaa01"
    assert [r["error"] for r in rows.orderBy("path").collect()] == [None, "unknown field 'odd'"]
    with pytest.raises(RuntimeError, match="conflicts"):
        s.edit("m_aaaa01", "y")


def test_rules():
    from quern.sources import records

    good = {"schemaVersion": 1, "id": "m_aaaa01", "scope": "project", "projectKey": "k", "projectName": "n", "createdAt": "2026-01-01T00:00:00Z", "updatedAt": "2026-01-03T00:00:00Z", "archivedAt": "2026-01-02T00:00:00Z",
            "currentRevision": 2, "revisions": [{"revision": 1, "content": "a", "createdAt": "2026-01-01T00:00:00Z"}, {"revision": 2, "content": "b", "createdAt": "2026-01-02T00:00:00+01:00"}]}
    assert records.problem(good) == ""
    breaks = [
        {"schemaVersion": 2}, {"schemaVersion": True}, {"id": "m_A"}, {"id": None}, {"scope": "team"}, {"projectKey": " "}, {"projectName": None}, {"scope": "global"}, {"createdAt": "2026-01-01"}, {"updatedAt": None},
        {"updatedAt": "2025-01-01T00:00:00Z"}, {"archivedAt": "2025-12-31T00:00:00Z"}, {"archivedAt": "soon"}, {"currentRevision": 1}, {"revisions": []}, {"revisions": [{"revision": 1, "content": "a", "createdAt": "2026-01-01T00:00:00Z"}] * 2},
        {"revisions": [good["revisions"][0], good["revisions"][1] | {"content": " "}]}, {"revisions": [good["revisions"][0], good["revisions"][1] | {"createdAt": "2026-01-04T00:00:00Z"}]}, {"revisions": [good["revisions"][0], {"revision": 2, "content": "b"}]},
    ]
    said = [records.problem(good | b) for b in breaks]
    assert set(said) == {message for message, _ in records.RULES}
    assert records.problem(good | {"scope": "global"}) == records.problem({**good, "scope": "global", "projectKey": "", "projectName": "", "projectRemote": "r"})
    assert records.id_of("m_aaaa01.json") == "m_aaaa01" and records.id_of("m_aaaa01.txt") is None and records.canonical("m_a.sync-conflict-20260101-000000-x.json") == "m_a.json"


def test_parse_is_strict(tmp_path):
    r = store(tmp_path).create("global", "x")
    raw = json.dumps(r).encode()
    assert parse("/x/m_aaaa01.json", raw)["id"] == "m_aaaa01"
    for path, bad in (("/x/m_other1.json", raw), ("/x/m_aaaa01.json", raw + b"{}"), ("/x/m_aaaa01.json", raw.replace(b'"global"', b'"project"')), ("/x/m_aaaa01.json", raw.replace(b'"revision": 1', b'"revision": 2'))):
        with pytest.raises(ValueError):
            parse(path, bad)
