"""Logs read in ranges give the events, warnings and numbers of one read."""

import json
import random

import pytest

from quern.sources import jsonl


def record(harness, i, text):
    if harness == "pi":
        return {"type": "message", "id": f"e{i}", "timestamp": "2026-01-01T00:00:00Z", "message": {"role": "user", "content": text}}
    if harness == "codex":
        return {"type": "response_item", "timestamp": "2026-01-01T00:00:00Z", "payload": {"type": "message", "role": "user", "content": [{"type": "input_text", "text": text}]}}
    return {"type": "user", "sessionId": "s", "uuid": f"u{i}", "message": {"role": "user", "content": text}}


def logs(harness, rng):
    """Texts of files of many kinds."""
    lines = [json.dumps(record(harness, i, "wörd " * rng.randint(1, 30)), ensure_ascii=i % 2 == 0) for i in range(60)]
    yield "\n".join(lines)
    yield "\n".join(lines) + "\n"
    yield "\r\n".join(lines[:30]) + "\n\n \n" + "\n".join(lines[30:]) + "\n\n"
    yield "\n".join(lines) + "\n" + lines[0][: len(lines[0]) // 2]  # cut off at the end
    yield "\n".join(lines) + "\n" + lines[0][:-5] + "\n"
    yield "\n".join([*lines[:20], '{"bad": ', *lines[20:]])
    yield "\n".join([*lines[:40], "[1, 2]", *lines[40:]])
    yield "\n".join([*lines[:10], json.dumps(record(harness, 99, "x"), indent=1), *lines[10:]])  # a value over several lines
    yield "\n".join([*lines[:5], lines[5] + " " + lines[6], *lines[7:]])
    yield "\n".join([*lines[:5], "\udcff".encode("utf-8", "surrogateescape").decode("latin-1"), *lines[5:]])
    yield lines[0] * 3


@pytest.mark.parametrize("harness", ["pi", "codex", "claude"])
def test_ranges_equal_one_read(spark, tmp_path, harness):
    rng = random.Random(1)
    for i, text in enumerate(logs(harness, rng)):
        (tmp_path / f"{i:02d}.jsonl").write_bytes(text.encode())
    raw = json.dumps(record(harness, 0, "Ω" * 40), ensure_ascii=False).encode()
    (tmp_path / "raw.jsonl").write_bytes(b"\n".join([raw, raw[:-20] + b"\xff" + raw[-20:], raw]))
    sources = jsonl.discover(harness, str(tmp_path))
    want = sorted(map(repr, jsonl.read_events(spark, sources, harness).collect()))
    for size in (700, 5000):
        got = sorted(map(repr, jsonl.read_events(spark, sources, harness, size).collect()))
        assert got == want, size


def test_every_line_is_in_one_range(tmp_path):
    rng = random.Random(2)
    for _ in range(50):
        data = b"\n".join(b"x" * rng.randint(0, 9) for _ in range(rng.randint(1, 30)))
        (tmp_path / "f").write_bytes(data)
        for size in (1, 2, 3, 7, 50):
            begins = range(0, max(1, len(data)), size)
            parts = [line for b in begins for line, _ in jsonl.lines_in(str(tmp_path / "f"), b, b + size if b + size < len(data) else None)]
            want = data.split(b"\n")
            assert parts == (want[:-1] if data.endswith(b"\n") or not data else want)
