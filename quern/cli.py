"""Command line: python -m quern.cli COMMAND.

Reports are text, or JSON with ``--json``; warnings go to standard error.  Searches and lists are about
the project around the working directory unless the options say something else.
"""

from __future__ import annotations

import argparse
import datetime as dt
import json
import sys

from pyspark.sql import SparkSession

from .operators.filters import MemoryFilters, SessionFilters, check_threshold, parse_date
from .plans.embedding import LoopbackProvider
from .plans.engine import Engine

VERSION = "0.2.0"

#: Options: name, type (None: a switch), help.
OPTIONS: dict[str, tuple[type | None, str]] = {
    "path": (str, "sessions of this folder and those below"), "harness": (str, "comma-separated harnesses"), "role": (str, "comma-separated roles"),
    "since": (str, "first date"), "before": (str, "last date"), "limit": (int, "most results of each kind, 1 to 100"), "semantic-threshold": (float, "least similarity"),
    "project": (str, "the project around this folder"), "json": (None, "JSON instead of text"), "explain": (None, "ranks by channel"), "lexical-only": (None, "no vectors"),
    "include-archived": (None, "archived records too"), "all-projects": (None, "every project"), "global": (None, "global records only"),
    "rebuild": (None, "from nothing"), "reembed": (None, "all vectors anew"), "quiet": (None, "no report"),
}
_SESSION, _MEMORY = {"path", "harness", "role", "since", "before"}, {"include-archived", "global", "project"}
_SEARCH = {"limit", "json", "explain", "lexical-only", "semantic-threshold", "all-projects"}
#: What each command takes: its options, and whether words follow.
COMMANDS: dict[str, tuple[set[str], bool]] = {
    "search": (_SEARCH | _SESSION | _MEMORY, True), "session": (_SEARCH | _SESSION, True), "memory": (_SEARCH | _MEMORY, True),
    "remember": ({"global", "path", "json"}, True), "list": ({"project", "global", "all-projects", "include-archived", "json"}, False),
    "show": ({"json"}, True), "edit": ({"json"}, True), "forget": ({"json"}, True), "restore": ({"json"}, True), "history": ({"json"}, True),
    "index": ({"harness", "rebuild", "reembed", "quiet", "json", "lexical-only"}, False), "status": ({"json"}, False), "doctor": ({"json"}, False), "version": (set(), False), "help": (set(), False),
}
#: Options that exclude each other.
EXCLUSIVE = (("global", "project"), ("global", "all-projects"), ("project", "all-projects"), ("rebuild", "reembed"))


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="quern", exit_on_error=False, argument_default=argparse.SUPPRESS)
    p.add_argument("command", choices=COMMANDS)
    p.add_argument("words", nargs="*", default=[])
    p.add_argument("-s", dest="only", action="append_const", const="session", help="sessions only")
    p.add_argument("-m", dest="only", action="append_const", const="memory", help="records only")
    for name, (kind, about) in OPTIONS.items():
        p.add_argument(f"--{name}", **({"action": "store_true"} if kind is None else {"type": kind}), help=about)
    return p


def route(argv: list[str]) -> argparse.Namespace:
    """A bare query is a search; what follows ``--`` is always a query.  Raises ``ValueError`` for options that don't fit."""
    argv = argv or ["help"]
    if argv[0] in ("-h", "--help", "--version"):
        argv = ["version" if argv[0] == "--version" else "help"]
    elif argv[0] not in COMMANDS:
        argv = ["search", *argv]
    try:
        a = parser().parse_intermixed_args(argv)
    except (argparse.ArgumentError, SystemExit) as e:
        raise ValueError(str(e)) from None
    given = {k.replace("_", "-") for k in vars(a)} - {"command", "words", "only"}
    only = set(getattr(a, "only", ()))
    if len(only) > 1:
        raise ValueError("-s and -m are mutually exclusive")
    if only:
        (kind,) = only
        if a.command not in ("search", kind):
            raise ValueError(f"-{'s' if kind == 'session' else 'm'} does not apply to {a.command}")
        a.command = kind
    options, words = COMMANDS[a.command]
    for name in sorted(given - options):
        raise ValueError(f"--{name} does not apply to {a.command}")
    for one, other in EXCLUSIVE:
        if one in given and other in given:
            raise ValueError(f"--{one} and --{other} are mutually exclusive")
    if a.words and not words:
        raise ValueError(f"{a.command} takes no further words")
    if a.command in ("search", "session", "memory") and not " ".join(a.words).strip():
        raise ValueError("a search needs a query")
    if a.command in ("show", "edit", "forget", "restore", "history") and not a.words:
        raise ValueError(f"{a.command} needs a record's identifier")
    for name, (kind, _) in OPTIONS.items():
        key = name.replace("-", "_")
        if not hasattr(a, key):
            setattr(a, key, False if kind is None else 3 if name == "limit" else None)
    if not 1 <= a.limit <= 100:
        raise ValueError("limit must be between 1 and 100")
    if a.semantic_threshold is not None:
        check_threshold(a.semantic_threshold)
    return a


def content(words: list[str], stdin) -> str:
    """The text of a record: the words, or what is piped in."""
    text = " ".join(words).strip()
    if not text and not stdin.isatty():
        text = stdin.read().strip()
    if not text:
        raise ValueError("the text of the record is missing: give it as words or pipe it in")
    return text


def _list(value: str | None) -> tuple[str, ...]:
    return tuple(x for x in (value or "").split(",") if x.strip())


def session_filters(a: argparse.Namespace) -> SessionFilters:
    path = Engine.session_scope(a.path or "", a.all_projects)
    return SessionFilters(_list(a.harness), path, _list(a.role), parse_date(a.since) if a.since else None, parse_date(a.before, True) if a.before else None, a.limit)


def memory_filters(a: argparse.Namespace) -> MemoryFilters:
    return Engine.memory_scope(a.project or "", a.__dict__["global"], a.all_projects, a.include_archived, a.limit)


# reports


def _ranks(r: dict) -> str:
    parts = [f"{c}={r[f'{c}_rank']}" for c in ("exact", "lexical", "fuzzy", "semantic") if r.get(f"{c}_rank")]
    if r.get("semantic_rank"):
        parts[-1] += f" (similarity={r['similarity']:.3f})"
    return ", ".join(parts)


def _day(ms) -> str:
    return dt.datetime.fromtimestamp(ms / 1000, dt.UTC).date().isoformat() if ms else "unknown date"


def session_lines(results: list[dict], explain: bool) -> list[str]:
    out = []
    for r in results:
        out += [f"{r['rank']}. [{r['harness']}] {r['name']}", f"   {_day(r['updated_at'])}", *([f"   {r['cwd']}"] if r["cwd"] else []), f"   Session: {r['session_id']}"]
        out += [f"   {r['excerpt']}"] if r["excerpt"] else []
        out += [f"   Ranks: {_ranks(r)}"] if explain else []
        out += ["   Resume:", f"   {r['resume']}", ""]
    return out or ["No matching sessions."]


def memory_lines(results: list[dict], explain: bool) -> list[str]:
    out = []
    for r in results:
        out += [f"{r['rank']}. {r['id']} [{r['scope']}{', archived' if r['archived_at'] else ''}]", f"   {' '.join(r['content'].split())}"]
        out += [f"   {name}: {r[key]}" for name, key in (("Project", "project_name"), ("Source", "source")) if r[key]]
        out += [f"   Ranks: {_ranks(r)}"] if explain else []
        out.append("")
    return out or ["No matching memories."]


def record_lines(r: dict) -> list[str]:
    names = (("ID", "id"), ("Scope", "scope"), ("Project", "projectName"), ("Key", "projectKey"), ("Remote", "projectRemote"), ("Source", "source"), ("Created", "createdAt"), ("Updated", "updatedAt"), ("Archived", "archivedAt"), ("Revision", "currentRevision"))
    return [*(f"{n + ':':<10}{r.get(k) or '-'}" for n, k in names), "", r["revisions"][-1]["content"]]


def warn(warnings: list[dict], to) -> None:
    for w in warnings:
        print(f"warning: {w['message']}", file=to)
        for name, key in (("memory", "memoryId"), ("file", "path")):
            if w.get(key):
                print(f"  {name}: {w[key]}", file=to)
        for p in w.get("conflictPaths", ()):
            print(f"  copy: {p}", file=to)


def run(a: argparse.Namespace, engine: Engine, stdin=sys.stdin) -> tuple[object, list[str], list[dict], int]:
    """What a command gives: values, report lines, warnings, exit code."""
    if a.command in ("search", "session", "memory"):
        text, out, lines, warnings = " ".join(a.words), {"query": " ".join(a.words)}, [], []
        if a.command != "session":
            warnings += engine.records_warnings()
            df, error = engine.search_memories(text, memory_filters(a), a.semantic_threshold)
            out["memories"] = {"results": [r.asDict() for r in df.orderBy("rank").collect()]} | ({"semanticError": error} if error else {})
            lines += (["Memories:"] if a.command == "search" else []) + memory_lines(out["memories"]["results"], a.explain)
            warnings += [{"type": "semantic_search", "message": error}] if error else []
        if a.command != "memory":
            df, error = engine.search_sessions(text, session_filters(a), a.semantic_threshold)
            out["sessions"] = {"results": [r.asDict() for r in df.orderBy("rank").collect()]} | ({"semanticError": error} if error else {})
            lines += (["Sessions:"] if a.command == "search" else []) + session_lines(out["sessions"]["results"], a.explain)
            warnings += [{"type": "semantic_search", "message": error}] if error else []
        return out | {"warnings": warnings}, lines, warnings, 0
    if a.command == "index":
        s, m = engine.index(a.rebuild, a.reembed, _list(a.harness))
        counted = ("discovered", "updated", "unchanged", "deleted", "errors", "embedded")
        lines = [] if a.quiet else [f"{name}: " + ", ".join(f"{getattr(r, c)} {c}" for c in counted) for name, r in (("sessions", s), ("memories", m))]
        late = [{"type": "semantic_index", "message": f"vectors are pending: {r.embedding_error}"} for r in (s, m) if r.embedding_error]
        return {"sessions": vars(s), "memories": vars(m)}, lines, s.warnings + m.warnings + late, 0
    if a.command == "remember":
        r = engine.remember(content(a.words, stdin), a.path, a.__dict__["global"])
        return r, [f"Remembered {r['id']}."], [], 0
    if a.command == "edit":
        r = engine.edit(a.words[0], content(a.words[1:], stdin))
        return r, [f"{r['id']} is at revision {r['currentRevision']}."], [], 0
    if a.command in ("forget", "restore"):
        r = getattr(engine, a.command)(a.words[0])
        return r, [f"{r['id']} is {'archived' if r['archivedAt'] else 'active'}."], [], 0
    if a.command == "show":
        r = engine.show(a.words[0])
        return r, record_lines(r), [], 0
    if a.command == "history":
        rows = [r.asDict() for r in engine.history(a.words[0]).orderBy("revision").collect()]
        return rows, [x for r in rows for x in (f"Revision {r['revision']}  {r['created_at']}", r["content"], "")], [], 0
    if a.command == "list":
        rows = [r.asDict() for r in engine.list(memory_filters(a)).drop("tokens", "grams", "embedding").collect()]
        lines = [x for n, r in enumerate(rows, 1) for x in (f"{n}. {r['id']} [{r['scope']}{' archived' if r['archived_at'] else ''}]", f"   {' '.join(r['content'].split())}")]
        return {"results": rows, "warnings": engine.records_warnings()}, lines or ["No memories."], engine.records_warnings(), 0
    if a.command == "doctor":
        rows = [r.asDict() for r in engine.doctor().collect()]
        return rows, [f"{'ok  ' if r['ok'] else 'FAIL'} {r['check']}: {r['detail']}" for r in rows], [], int(any(not r["ok"] and not r["check"].startswith("harness") for r in rows))
    found = engine.status()
    return found, [f"{k.replace('_', ' ')}: {v}" for k, v in found.items()], [], 0


def main(argv: list[str] | None = None, engine: Engine | None = None, stdin=None) -> int:
    try:
        a = route(sys.argv[1:] if argv is None else argv)
        if a.command in ("version", "help"):
            print(VERSION if a.command == "version" else parser().format_help())
            return 0
        if engine is None:
            engine = Engine(SparkSession.builder.appName("quern").getOrCreate())
            if not a.lexical_only:
                engine.provider = LoopbackProvider(engine.config.embedding_url, engine.config.embedding_model)
        values, lines, warnings, code = run(a, engine, stdin or sys.stdin)
    except (ValueError, KeyError, RuntimeError) as e:
        print(e.args[0] if e.args else e, file=sys.stderr)
        return 2
    if a.json:
        print(json.dumps(values, indent=2, default=str))
    else:
        print("\n".join(lines), end="\n" if lines else "")
        warn(warnings, sys.stderr)
    return code


if __name__ == "__main__":
    sys.exit(main())
