import io
import json
import os
import socket
import subprocess
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest
from pyspark.sql import functions as F

from quern import cli, config, project, schemas
from quern.functions.identity import stable_key_of
from quern.operators import filters, segments
from quern.operators.filters import MemoryFilters, SessionFilters
from quern.plans import embedding
from quern.plans.engine import MEMORY_TABLES, SESSION_TABLES, Engine
from quern.plans.snapshot import Snapshot, bucket_of


class Compass:
    """Vectors by theme: water points north, doubts about it north-east, all else east."""

    def __init__(self, mark="compass:1", fail=False):
        self.fingerprint, self.fail = mark, fail

    def embed_query(self, text):
        return self.embed_documents([text])[0]

    def embed_documents(self, texts):
        if self.fail:
            raise OSError("no server")
        north = [1.0 if any(w in t for w in ("river", "harbour")) else 0.48 if "perhaps" in t else 0.0 for t in texts]
        return [[n, (1 - n * n) ** 0.5] for n in north]


ALL_THERE = lambda harness: True


def settings(tmp_path, **sources):
    return config.Config(str(tmp_path / "index"), str(tmp_path / "memories"), str(tmp_path / "mindex"), sources={"pi": "", "codex": "", "claude": "", "opencode": ""} | sources)


def log(path, sid, *texts):
    path.parent.mkdir(parents=True, exist_ok=True)
    rows = [{"type": "session", "id": sid, "cwd": f"/work/{sid}", "timestamp": "2026-01-01T00:00:00Z"}]
    rows += [{"type": "message", "id": f"e{i}", "timestamp": f"2026-01-01T00:00:0{i}Z", "message": {"role": "user" if i % 2 == 0 else "assistant", "content": t}} for i, t in enumerate(texts)]
    path.write_text("\n".join(json.dumps(r) for r in rows))


def engine(spark, tmp_path, provider=None, installed=ALL_THERE, **sources):
    return Engine(spark, settings(tmp_path, **sources), provider, installed)


def apart(spark, folder):
    """Two paths whose sources lie in different buckets, wherever the folder is."""
    paths = [folder / f"log{i}.jsonl" for i in range(30)]
    keyed = spark.createDataFrame([(i, stable_key_of("pi", str(p))) for i, p in enumerate(paths)], "i int, source_key string")
    of = {r["i"]: r["b"] for r in keyed.select("i", bucket_of("source_key").alias("b")).collect()}
    return paths[0], next(p for i, p in enumerate(paths) if of[i] != of[0])


def test_index_and_search(spark, tmp_path):
    logs = tmp_path / "logs"
    a, b = apart(spark, logs)
    log(a, "boat", "where does the ferry cross the estuary at night", "at the old harbour beside the river")
    log(b, "bread", "how long should dough rest", "until it has doubled in size")
    e = engine(spark, tmp_path, Compass(), pi=str(logs))
    first, _ = e.index()
    assert (first.discovered, first.updated, first.embedded, first.errors) == (2, 2, 4, 0)
    hits, error = e.search_sessions("harbour river")
    rows = hits.orderBy("rank").collect()
    assert not error and rows[0]["session_id"] == "boat" and rows[0]["similarity"] == 1.0 and rows[0]["lexical_rank"] == 1 and rows[0]["resume"] == "cd '/work/boat' && pi --session 'boat'"
    typo, _ = e.search_sessions("fery crosss estury", SessionFilters(path="/work/boat"))
    assert [r["session_id"] for r in typo.where("fuzzy_rank = 1").collect()] == ["boat"]
    assert e.search_sessions("estury", SessionFilters(path="/elsewhere"))[0].count() == 0
    exact, _ = e.search_sessions("bread")
    assert exact.where("exact_rank = 1").collect()[0]["session_id"] == "bread"
    plain = sorted(map(repr, hits.drop("score").collect()))
    e.write_postings()
    assert e.sessions_store.postings(SESSION_TABLES) is not None
    assert sorted(map(repr, e.search_sessions("harbour river")[0].drop("score").collect())) == plain
    # nothing changed: nothing is written, and the inverted index stays
    number = e.sessions_store.manifest()["number"]
    again, _ = e.index()
    assert (again.updated, again.unchanged, again.embedded) == (0, 2, 0) and e.sessions_store.manifest()["number"] == number
    # one file with one more turn: its bucket is written, the other's folder stays, the inverted index follows
    before = e.sessions_store.manifest()["tables"]["chunks"]
    log(b, "bread", "how long should dough rest", "until it has doubled in size", "and where is the river mill")
    more, _ = e.index()
    after = e.sessions_store.manifest()["tables"]["chunks"]
    assert (more.updated, more.unchanged, more.embedded) == (1, 1, 1) and len(before) == 2 and len(set(before.values()) & set(after.values())) == 1
    assert e.sessions_store.postings(SESSION_TABLES) is not None
    assert {r["session_id"] for r in e.search_sessions("mill")[0].where("lexical_rank is not null").collect()} == {"bread"}
    os.unlink(a)
    (logs / "c.jsonl").write_text("{bad}")
    less, _ = e.index()
    assert (less.deleted, less.errors) == (1, 1) and e.status()["sessions"] == 1 and e.status()["parser_errors"] == 1
    assert {r["check"].split()[0] for r in e.doctor().where("not ok").collect()} >= {"parser"}
    number = e.sessions_store.manifest()["number"]
    assert e.index()[0].errors == 1 and e.sessions_store.manifest()["number"] == number  # the same failure again
    e.provider = Compass("compass:2")
    assert e.status()["pending"] == 3
    rebuilt, _ = e.index(rebuild=True)
    assert rebuilt.embedded == 3
    e.provider = Compass(fail=True)
    _, error = e.search_sessions("river")
    assert error == "no server"
    out = e.search("river")
    assert out["sessions"]["semanticError"] and out["sessions"]["results"] and any(w["type"] == "semantic_search" for w in out["warnings"])


def postings_written(e, number):
    """Postings of a stored segment."""
    return next(s for s in e.sessions_store.segments() if s.number == number).blocks.agg(F.coalesce(F.sum("n_posts"), F.lit(0))).first()[0]


def test_postings_follow_by_segments(spark, tmp_path, monkeypatch):
    """A run with one changed source writes postings in its size; searches equal those of an index made anew."""
    logs = tmp_path / "logs"
    said = ["the ferry crosses the estuary", "dough rests until it has doubled", "tar for the hull of the boat", "a harbour beside the river mill"]
    for i in range(12):
        log(logs / f"{i}.jsonl", f"s{i}", *(f"{t} number {i}" for t in said))
    e = engine(spark, tmp_path, pi=str(logs))
    e.index()
    e.write_postings()
    assert [s.number for s in e.sessions_store.segments()] == [1]
    whole = postings_written(e, 1)
    found = lambda: sorted((r["session_id"], r["lexical_rank"] or 0, r["fuzzy_rank"] or 0) for q in ("estuary mill", "hul of boatt") for r in e.search_sessions(q, SessionFilters(limit=50))[0].collect())
    log(logs / "3.jsonl", "s3", "the ferry crosses the estuary number 3", "an owl on the mill")
    os.unlink(logs / "7.jsonl")
    e.index()
    first, second = e.sessions_store.segments()
    assert (second.rows, second.n_gone, second.n_docs) == (1, 7, -6) and 0 < postings_written(e, 2) < whole / 20
    by_segments = found()
    assert any(r[0] == "s3" for r in by_segments) and not any(r[0] == "s7" for r in by_segments)
    number = e.sessions_store.manifest()["number"]
    e.index()
    assert e.sessions_store.manifest()["number"] == number
    monkeypatch.setattr(segments, "MOST_SEGMENTS", 1)
    log(logs / "4.jsonl", "s4", "nothing but an owl")
    e.index()  # a third segment, merged with the second: the first outweighs them
    assert [s.rows for s in e.sessions_store.segments()] == [48, 2]
    merged = found()
    e.write_postings()
    assert [s.rows for s in e.sessions_store.segments()] == [39] and found() == merged
    stats = lambda: sorted(map(tuple, segments.Index(e.sessions_store.segments()).terms().collect()))
    anew = stats()
    log(logs / "4.jsonl", "s4", *(f"{t} number 4" for t in said))
    e.index()
    log(logs / "4.jsonl", "s4", "nothing but an owl")
    e.index()
    assert stats() == anew


def test_search_in_every_script(spark, tmp_path):
    logs = tmp_path / "logs"
    log(logs / "a.jsonl", "s1", "がぎぐ について", "한국어 문장", "ﬁnance chapter ①", "x² and ΑΣ")
    e = engine(spark, tmp_path, pi=str(logs))
    e.index()
    for query in ("がぎぐ", "한국어", "finance", "chapter 1", "x2", "ασ"):
        assert e.search_sessions(query)[0].where("lexical_rank is not null or fuzzy_rank is not null").count() == 1, query


def test_session_that_moves_to_another_file(spark, tmp_path):
    logs = tmp_path / "logs"
    log(logs / "a.jsonl", "same", "first words of it")
    e = engine(spark, tmp_path, pi=str(logs))
    e.index()
    log(logs / "b.jsonl", "same", "first words of it", "second words of it")
    e.index()
    assert e.sessions_store.read("sessions").collect()[0]["source_path"].endswith("b.jsonl") and e.sessions_store.read("chunks").count() == 2


def test_harness_that_is_not_installed(spark, tmp_path):
    """Its sessions stay as they are, even if its folder is gone; the others go on."""
    gone, there = tmp_path / "gone", tmp_path / "there"
    log(gone / "a.jsonl", "kept", "words of a tool that is removed later")
    e = engine(spark, tmp_path, pi=str(gone), codex=str(there))
    e.index()
    os.unlink(gone / "a.jsonl")
    os.rmdir(gone)
    e.installed = lambda harness: harness == "codex"
    r, _ = e.index()
    assert r.deleted == 0 and e.sessions_store.read("sessions").count() == 1 and sum(w["type"] == "skipped" for w in r.warnings) == 3
    e.installed = ALL_THERE
    assert e.index()[0].deleted == 1


def test_database_place(spark, tmp_path, monkeypatch):
    """The place of the database is asked of its program where it isn't set."""
    tools = tmp_path / "bin"
    tools.mkdir()
    (tools / "opencode").write_text("#!/bin/sh\necho /somewhere/sessions.db\n")
    os.chmod(tools / "opencode", 0o755)
    monkeypatch.setenv("PATH", f"{tools}:{os.environ['PATH']}")
    e = engine(spark, tmp_path)
    assert e.place("opencode") == "/somewhere/sessions.db" and e.place("pi") == ""
    (tools / "opencode").write_text("#!/bin/sh\nexit 3\n")
    with pytest.raises(OSError, match="db path"):
        e.place("opencode")
    assert any("db path" in w["message"] for w in e.index()[0].warnings)


def test_failed_source_keeps_rows(spark, tmp_path):
    logs = tmp_path / "logs"
    log(logs / "a.jsonl", "s1", "first words")
    e = engine(spark, tmp_path, pi=str(logs))
    e.index()
    (logs / "a.jsonl").write_text("{bad} more")
    for _ in range(2):  # tried again each time
        r, _ = e.index()
        assert r.errors == 1 and e.sessions_store.read("chunks").count() == 1


def test_memories(spark, tmp_path):
    e = engine(spark, tmp_path, Compass())
    a = e.remember("moor at the eastern harbour", global_scope=True)
    e.records.create("project", "perhaps use the northern pier", "", "host/p", "", "p")
    e.records.create("project", "tar the other hull", "", "host/q", "", "q")
    found, _ = e.search_memories("river", MemoryFilters(project_key="host/p"), threshold=0.5)
    assert [r["id"] for r in found.where("semantic_rank is not null").collect()] == [a["id"]]
    assert e.search_memories("river", MemoryFilters(project_key="host/p"), threshold=0.45)[0].where("semantic_rank is not null").count() == 2
    found, _ = e.search_memories("mooor estern harbor", MemoryFilters(global_only=True))
    assert [r["id"] for r in found.collect()] == [a["id"]]
    assert e.search_memories("other hull", MemoryFilters(project_key="host/p"))[0].where("content like 'tar%'").count() == 0
    plain = sorted(map(repr, e.search_memories("other hull harbour", MemoryFilters(all_projects=True))[0].drop("score").collect()))
    assert len(plain) == 2
    e.write_postings()
    assert e.memories_store.postings(MEMORY_TABLES) is not None and sorted(map(repr, e.search_memories("other hull harbour", MemoryFilters(all_projects=True))[0].drop("score").collect())) == plain
    e.edit(a["id"][:6], "moor at the lock")
    assert e.memories_store.postings(MEMORY_TABLES) is not None  # follows the records
    assert [r["content"] for r in e.history(a["id"]).collect()] == ["moor at the eastern harbour", "moor at the lock"]
    e.forget(a["id"])
    assert e.list(MemoryFilters(global_only=True)).count() == 0 and e.list(MemoryFilters(global_only=True, include_archived=True)).count() == 1
    e.restore(a["id"])
    with e.memories_store.writer():  # another writer: searched as it is
        assert e.search_memories("lock", MemoryFilters(all_projects=True))[0].count() >= 1
        with pytest.raises(RuntimeError, match="already running"):
            e.refresh()
    open(e.records.path(a["id"]), "w").write("{}")
    r = e.refresh()
    assert [w["type"] for w in r.warnings] == ["invalid_record"] and e.list(MemoryFilters(global_only=True)).count() == 1
    os.unlink(e.records.path(a["id"]))
    assert e.refresh().deleted == 1
    with pytest.raises(ValueError):
        e.search_memories(" ")


def work_tree(path, url=""):
    path.mkdir(parents=True)
    subprocess.run(["git", "init", "-q", str(path)], check=True)
    if url:
        subprocess.run(["git", "-C", str(path), "remote", "add", "origin", url], check=True)
    return path


def test_projects(spark, tmp_path, monkeypatch):
    e = engine(spark, tmp_path)
    (tmp_path / "bare").mkdir()
    with pytest.raises(ValueError):
        e.remember("x", str(tmp_path / "bare"))
    tree = work_tree(tmp_path / "tree", "git@Host:o/r.git")
    (tree / "deep" / "er").mkdir(parents=True)
    for path in (tree, tree / "deep" / "er"):
        assert project.around(str(path)) == (str(tree), "host/o/r", "git@Host:o/r.git", "r")
    assert project.around(str(work_tree(tmp_path / "alone")))[1:] == ("local/alone", "", "alone")
    subprocess.run(["git", "-C", str(tree), "-c", "user.name=a", "-c", "user.email=b@c", "commit", "-q", "--allow-empty", "-m", "x"], check=True)
    subprocess.run(["git", "-C", str(tree), "worktree", "add", "-q", str(tmp_path / "second")], check=True)
    assert project.around(str(tmp_path / "second")).key == "host/o/r"
    made = e.remember("x", str(tree / "deep"))
    assert (made["projectKey"], made["projectName"]) == ("host/o/r", "r")
    # without options, searches and lists are about the project around the working directory
    e.remember("of all", global_scope=True)
    monkeypatch.chdir(tree / "deep")
    assert e.memory_scope().project_key == "host/o/r" and e.session_scope() == str(tree) and e.session_scope(all_projects=True) == ""
    monkeypatch.chdir(tmp_path / "bare")
    assert e.memory_scope().global_only and e.session_scope() == "" and e.list(e.memory_scope()).count() == 1
    with pytest.raises(ValueError):
        e.memory_scope(str(tmp_path / "bare"))


def test_snapshot(spark, tmp_path):
    s = Snapshot(spark, str(tmp_path / "x"), keep_ms=0)
    assert s.read("sources").count() == 0
    row = spark.createDataFrame([("k", "pi", "p", "v", 1)], "source_key string, harness string, path string, version string, indexed_at long")
    for n in range(1, 5):
        assert s.commit({"sources": row.withColumn("version", F.lit(str(n)))}, {"m": str(n)}) == n
    assert s.read("sources").first()["version"] == "4" and s.meta("m") == "4" and s.meta("none") == ""
    assert len(os.listdir(tmp_path / "x" / "data")) == 2
    name = sorted(n for n in os.listdir(tmp_path / "x") if n.endswith(".json"))[-1]
    (tmp_path / "x" / "manifest-000009.json").write_text((tmp_path / "x" / name).read_text().replace(f'"schema_version": {schemas.VERSION}', f'"schema_version": {schemas.VERSION + 1}'))
    with pytest.raises(RuntimeError, match="newer"):
        s.read("sources")
    late = Snapshot(spark, str(tmp_path / "y"))  # by default, readers keep their folders for a day
    for n in range(1, 5):
        late.commit({"sources": row})
    assert len(os.listdir(tmp_path / "y" / "data")) == 4


def test_writer(spark, tmp_path):
    s = Snapshot(spark, str(tmp_path / "x"))
    with s.writer(), pytest.raises(RuntimeError, match="already running"), s.writer():
        pass
    with s.writer():
        pass
    done = subprocess.Popen(["true"])
    done.wait()
    (tmp_path / "x" / "writer.lock").write_text(json.dumps({"host": socket.gethostname(), "pid": done.pid}))
    with s.writer():  # left behind by a process that is gone
        pass
    (tmp_path / "x" / "writer.lock").write_text(json.dumps({"host": "elsewhere", "pid": 1}))
    with pytest.raises(RuntimeError), s.writer():
        pass


def test_provider(tmp_path):
    seen = []

    class Handler(BaseHTTPRequestHandler):
        def do_POST(self):
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            seen.append(body["input"])
            out = json.dumps({"embeddings": [[3, 4]] * len(body["input"])}).encode()
            self.send_response(200)
            self.end_headers()
            self.wfile.write(out)

        def log_message(self, *_):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    p = embedding.LoopbackProvider(f"http://127.0.0.1:{server.server_port}", "embeddinggemma:300m")
    assert [round(x, 5) for x in p.embed_query("q")] == [0.6, 0.8] and len(p.embed_documents(["a", "b"])) == 2
    assert seen == [["task: search result | query: q"], ["title: none | text: a", "title: none | text: b"]]
    server.shutdown()
    for url, model in (("http://example.com", "embeddinggemma"), ("ftp://localhost", "embeddinggemma"), ("http://localhost", "other")):
        with pytest.raises(ValueError):
            embedding.LoopbackProvider(url, model)


def test_config(tmp_path, monkeypatch):
    monkeypatch.setenv("XDG_DATA_HOME", str(tmp_path))
    assert config.load(str(tmp_path / "none.toml")).index == str(tmp_path / "quern" / "index")
    f = tmp_path / "c.toml"
    f.write_text('index = "~/i"\n[embedding]\nthreshold = 0.5\n[harnesses]\npi = false\n[sources]\ncodex = "/c"\n')
    c = config.load(str(f))
    assert c.index == os.path.expanduser("~/i") and c.threshold == 0.5 and not c.harnesses["pi"] and c.sources["codex"] == "/c"
    f.write_text("[embedding]\nthreshold = 2\n")
    with pytest.raises(ValueError):
        config.load(str(f))
    with pytest.raises(ValueError):
        config.check_index_outside("/m", "/m/index")


def test_routes(capsys):
    assert cli.route(["some", "words"]).command == "search" and cli.route(["--", "index"]).words == ["index"] and cli.route(["session", "x"]).command == "session"
    assert cli.route(["x", "-m"]).command == "memory" and cli.route(["session", "x", "-s"]).command == "session"
    assert cli.main(["version"]) == 0 and cli.main([]) == 0
    wrong = (["-s", "-m", "x"], ["session", "x", "--global"], ["memory", "x", "--path", "/a"], ["session", "x", "-m"], ["x", "--global", "--project", "p"], ["x", "--project", "p", "--all-projects"],
             ["list", "word"], ["index", "--limit", "3"], ["search"], ["edit"], ["x", "--limit", "0"], ["x", "--limit", "many"], ["x", "--semantic-threshold", "2"], ["x", "--none"], ["index", "--rebuild", "--reembed"])
    for argv in wrong:
        assert cli.main(argv) == 2, argv
    assert "exclusive" in capsys.readouterr().err


def test_reports(spark, tmp_path, monkeypatch, capsys):
    tree = work_tree(tmp_path / "tree", "https://host/o/r")
    monkeypatch.chdir(tree)
    logs = tmp_path / "logs"
    log(logs / "a.jsonl", "far", "the ferry leaves the river at noon")
    e = engine(spark, tmp_path, Compass(), lambda h: h == "pi", pi=str(logs))

    def said(*argv, stdin="", code=0):
        piped = io.StringIO(stdin)
        assert cli.main(list(argv), e, piped) == code
        return capsys.readouterr()

    out = said("index")
    assert "sessions: 1 discovered, 1 updated" in out.out and "codex is not installed" in out.err
    assert said("index", "--quiet").out == ""
    assert json.loads(said("index", "--json").out)["sessions"]["unchanged"] == 1
    made = said("remember", stdin="tie the boat twice\n").out.split()[1].rstrip(".")
    assert "pipe it in" in said("remember", code=2).err
    assert f"1. {made} [project]\n   tie the boat twice" in said("list").out
    assert "No matching sessions." in said("session", "ferry").out  # another folder's session
    found = said("session", "ferry", "--all-projects", "--explain").out
    assert "1. [pi]" in found and "Session: far" in found and "lexical=1" in found and "Resume:" in found
    both = said("boat", "--all-projects").out
    assert "Memories:" in both and "tie the boat twice" in both and "Sessions:" in both
    assert json.loads(said("memory", "boat", "--json").out)["memories"]["results"][0]["id"] == made
    assert "revision 2" in said("edit", made[:8], "tie it thrice").out and "archived" in said("forget", made).out
    assert "No memories." in said("list").out and " archived]" in said("list", "--include-archived").out and "active" in said("restore", made).out
    shown = said("show", made).out
    assert "Key:      host/o/r" in shown and shown.rstrip().endswith("tie it thrice") and "Revision 1" in said("history", made).out
    assert "sessions: 1" in said("status").out and "ok   session index" in said("doctor").out
    (tmp_path / "memories" / "records" / "m_broken000.json").write_text("{")
    assert "warning:" in said("list").err and said("show", "m_none", code=2).err

    class Terminal(io.StringIO):
        def isatty(self):
            return True

    assert cli.main(["remember"], e, Terminal("never read")) == 2 and "pipe it in" in capsys.readouterr().err


def test_poller(spark, tmp_path):
    from quern.streaming.poller import poll

    runs = []
    q = poll(spark, lambda: runs.append(1), str(tmp_path / "cp"), "1 second")
    for _ in range(60):
        if runs:
            break
        q.awaitTermination(0.5)
    q.stop()
    assert runs


def test_path_filter_reaches_the_scan(spark, tmp_path):
    """A directory and what is below it are a range of keys that the scan gets; sessions are sorted by it."""
    e = engine(spark, tmp_path)
    rows = spark.range(3000).select(F.concat(F.lit("k"), F.col("id")).alias("session_key"), F.concat(F.lit("/Work/p"), F.lpad(F.col("id").cast("string"), 5, "0"), F.lit("/src")).alias("cwd"))
    rows = rows.unionByName(spark.createDataFrame([("own", "/Work/p00007"), ("other", "/work/p00007"), ("below", "/WORK/P00007/x"), ("beside", "/Work/p00007-x")], "session_key string, cwd string"))
    empty = spark.createDataFrame([], schemas.SESSIONS)
    table = empty.unionByName(rows.withColumn("cwd_key", filters.path_key(F.col("cwd"))), allowMissingColumns=True)
    e.sessions_store.commit({"sessions": table})
    found = e.sessions_store.read("sessions").where(SessionFilters(path="/Work/p00007/").predicate(with_chunk=False))
    assert sorted(r["session_key"] for r in found.collect()) == ["below", "k7", "own"]
    plan = found._jdf.queryExecution().executedPlan().toString()
    pushed = plan[plan.index("PushedFilters") :]
    assert "And(EqualTo(cwd_key,/work/p00007),EqualTo(cwd,/Work/p00007)),And(GreaterThanOrEqual(cwd_key," in pushed
    files = e.sessions_store.read("sessions").select("cwd_key", F.input_file_name().alias("f"), F.monotonically_increasing_id().alias("i")).collect()
    keys = [r["cwd_key"] for r in sorted(files, key=lambda r: (r["f"], r["i"]))]
    assert keys == sorted(keys)


def test_buckets_follow_the_size(spark, tmp_path, monkeypatch):
    """A table that is written whole gets buckets by its rows; partial writes keep their number."""
    from quern import schemas
    from quern.plans import snapshot

    monkeypatch.setattr(snapshot, "BUCKETS", 2)
    monkeypatch.setattr(snapshot, "BUCKET_ROWS", 10)
    assert [snapshot.buckets_for(n) for n in (0, 20, 21, 80, 10**12)] == [2, 2, 4, 8, snapshot.MOST_BUCKETS]
    names = schemas.names(schemas.CHUNKS)
    empty = spark.createDataFrame([], schemas.CHUNKS)
    made = spark.range(70).select(F.concat(F.lit("c"), F.col("id")).alias("chunk_key"), F.concat(F.lit("s"), F.col("id") % 30).alias("source_key"), F.lit("text").alias("text"))
    rows = empty.unionByName(made, allowMissingColumns=True).select(*names)
    store = Snapshot(spark, str(tmp_path / "store"))
    store.commit({"chunks": rows})
    assert store.buckets("chunks") == 8 and store.read("chunks").count() == 70
    before = store.manifest()["tables"]["chunks"]
    number = spark.createDataFrame([("s3",)], "source_key string").select(bucket_of("source_key", 8)).first()[0]
    store.commit({"chunks": store.read("chunks").where("source_key <> 's3'")}, buckets={"chunks": [number]})
    after = store.manifest()["tables"]["chunks"]
    assert store.buckets("chunks") == 8 and {b for b in before if before[b] != after.get(b)} == {str(number)} and store.read("chunks").where("source_key = 's3'").count() == 0
    store.commit({"chunks": store.read("chunks").limit(5)})
    assert store.buckets("chunks") == 2 and store.read("chunks").count() == 5
