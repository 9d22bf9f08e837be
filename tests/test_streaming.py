"""The index follows a stream of changed sources; a batch counts once."""

import os
import time

from quern.streaming import logs

from .test_engine import engine, log


def until(query, condition, seconds=120):
    began = time.time()
    while not condition():
        assert query.isActive, query.exception()
        assert time.time() - began < seconds
        time.sleep(0.3)


def test_reader(tmp_path):
    log(tmp_path / "a.jsonl", "a", "one")
    reader = logs.LogReader({"pi": str(tmp_path), "claude": str(tmp_path / "none")})
    first = reader.latestOffset()
    rows = lambda a, b: sorted((r[0], os.path.basename(r[2]), r[4]) for p in reader.partitions(a, b) for r in reader.read(p))
    assert rows({}, first) == [("pi", "a.jsonl", "new")] and rows(first, first) == [] and first["claude"] == {}
    log(tmp_path / "a.jsonl", "a", "one", "two")
    log(tmp_path / "b.jsonl", "b", "one")
    second = reader.latestOffset()
    assert rows(first, second) == [("pi", "a.jsonl", "changed"), ("pi", "b.jsonl", "new")]
    os.unlink(tmp_path / "a.jsonl")
    assert rows(second, reader.latestOffset()) == [("pi", "a.jsonl", "missing")]


def test_follow(spark, tmp_path):
    folder, checkpoint = tmp_path / "logs", tmp_path / "checkpoint"
    log(folder / "a.jsonl", "a", "an owl on the mill")
    e = engine(spark, tmp_path, pi=str(folder))
    runs = []
    plain = e.index
    e.index = lambda **k: runs.append(k["batch"]) or plain(**k)
    count = lambda: e.sessions_store.read("chunks").count()
    query = logs.follow(e, str(checkpoint), "1 second")
    until(query, lambda: (checkpoint / "commits" / "0").exists())
    assert count() == 1 and len(runs) == 1
    log(folder / "a.jsonl", "a", "an owl on the mill", "a second turn")
    until(query, lambda: (checkpoint / "commits" / "1").exists())
    query.stop()
    assert count() == 2 and len(runs) == 2 and e.sessions_store.meta("batch") == runs[-1]
    number = e.sessions_store.manifest()["number"]
    # killed between the index's commit and the stream's: the last batch is run again
    for name in ("1", ".1.crc"):
        if (checkpoint / "commits" / name).exists():
            os.unlink(checkpoint / "commits" / name)
    query = logs.follow(e, str(checkpoint), "1 second")
    until(query, lambda: (checkpoint / "commits" / "1").exists())
    assert len(runs) == 2 and e.sessions_store.manifest()["number"] == number
    os.unlink(folder / "a.jsonl")
    until(query, lambda: (checkpoint / "commits" / "2").exists())
    query.stop()
    assert count() == 0 and len(runs) == 3
