"""The engine: everything a caller does, on one object."""

from __future__ import annotations

import os
import shutil
import subprocess
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import config as cfg
from .. import project
from ..functions import text as T
from ..operators import channels, filters, maintenance
from ..operators.filters import MemoryFilters, SessionFilters
from ..sources.records import RecordStore
from . import embedding, indexer, search
from .snapshot import Snapshot

#: The tables that search rows are made of.
SESSION_TABLES, MEMORY_TABLES = ("chunks", "sessions"), ("memories",)


def _unshared(old, now) -> tuple:
    """Of a table's folders before and now, those that not both have; a table without buckets is one."""
    if isinstance(old, dict) and isinstance(now, dict):
        return {b: p for b, p in old.items() if now.get(b) != p}, {b: p for b, p in now.items() if old.get(b) != p}
    return old, now


class Engine:
    def __init__(self, spark: SparkSession, config: cfg.Config | None = None, provider: embedding.Provider | None = None, installed: Callable[[str], bool] | None = None):
        self.spark = spark
        self.config = config or cfg.load()
        cfg.check_index_outside(self.config.memory_directory, self.config.memory_index)
        self.provider = provider
        #: Whether a harness's program is there; the sessions of others are left alone.
        self.installed = installed or (lambda harness: shutil.which(harness) is not None)
        self.sessions_store = Snapshot(spark, self.config.index)
        self.memories_store = Snapshot(spark, self.config.memory_index)
        self.records = RecordStore(self.config.memory_directory)
        #: Vectors by their text, of both corpora; a rebuild leaves them.
        self.vectors = embedding.VectorStore(spark, self.config.vectors or f"{self.config.index}-vectors")

    # indexing

    def roots(self, harnesses: tuple[str, ...] = ()) -> tuple[dict[str, str], list[dict]]:
        """Where the harnesses that are wanted and installed keep their sessions, and a warning for each other one."""
        wanted = [h for h in filters.HARNESSES if self.config.harnesses.get(h) and (not harnesses or h in harnesses)]
        available = {h: self.installed(h) for h in wanted}
        skipped = [{"type": "skipped", "message": f"{h} is not installed; its sessions stay as they are"} for h in wanted if not available[h]]
        roots: dict[str, str] = {}
        for h in wanted:
            if available[h]:
                try:
                    roots[h] = self.place(h)
                except OSError as e:
                    skipped.append({"type": "discovery", "message": str(e)})
        return roots, skipped

    def index_batch(self, mark: str) -> tuple[indexer.Result, indexer.Result] | None:
        """:meth:`index` for a batch of a stream; None if the index has that batch already."""
        return None if self.sessions_store.meta("batch") == mark else self.index(batch=mark)

    def index(self, rebuild: bool = False, reembed: bool = False, harnesses: tuple[str, ...] = (), batch: str = "") -> tuple[indexer.Result, indexer.Result]:
        """Sessions, then memories."""
        with self.sessions_store.writer():
            with self.memories_store.writer():
                if rebuild:
                    self.sessions_store.clear()
                    self.memories_store.clear()
                if reembed and self.provider is not None:
                    self.vectors.forget(self.provider.fingerprint)
                if reembed and not rebuild:
                    self.sessions_store.commit({"chunks": maintenance.clear_embeddings(self.sessions_store.read("chunks"))})
                    self.memories_store.commit({"memories": maintenance.clear_embeddings(self.memories_store.read("memories"))})
            roots, skipped = self.roots(harnesses)
            s = indexer.index_sessions(self.spark, self.sessions_store, roots, self.provider, self.vectors, {"batch": batch} if batch else None)
            s.warnings = skipped + s.warnings
            self.update_postings(memories=False)
            return s, self.refresh()

    def place(self, harness: str) -> str:
        """Where a harness keeps its sessions; the database's place is asked of its program if it isn't set."""
        named = self.config.sources.get(harness, "")
        if named or harness != "opencode":
            return named
        try:
            said = subprocess.run(["opencode", "db", "path"], capture_output=True, text=True, timeout=60, check=True).stdout.strip()
        except (OSError, subprocess.SubprocessError) as e:
            raise OSError(f"locate the session database with `opencode db path`: {e}") from None
        if not said:
            raise OSError("locate the session database: `opencode db path` said nothing")
        return said

    def write_postings(self) -> None:
        """Store the inverted indexes of both corpora; from then on indexing keeps them up to date."""
        self.sessions_store.write_postings(self.session_rows(), dict(channels.SESSIONS.weights), SESSION_TABLES)
        self.memories_store.write_postings(self.memory_rows(), dict(channels.MEMORIES.weights), MEMORY_TABLES)

    def update_postings(self, sessions: bool = True, memories: bool = True) -> None:
        """Add to stored inverted indexes what has changed in their tables since.

        Only folders that both states don't share are read, and only rows that differ are written."""
        for on, store, rows, spec, of in (
            (sessions, self.sessions_store, self._rows_of_sessions, channels.SESSIONS, SESSION_TABLES), (memories, self.memories_store, self._rows_of_memories, channels.MEMORIES, MEMORY_TABLES),
        ):
            old = store.indexed() if on else None
            now = store.named(of)
            if old is None or old == now:
                continue
            a, b = zip(*(_unshared(x, y) for x, y in zip(old, now, strict=True)), strict=True)
            read = lambda found: [store.read_folders(t, f) for t, f in zip(of, found, strict=True)]  # noqa: B023, E731
            store.add_postings(rows(*read(a)), rows(*read(b)), dict(spec.weights), of)

    def refresh(self) -> indexer.Result:
        """Mirror the records in their index."""
        with self.memories_store.writer():
            done = indexer.refresh_memories(self.spark, self.memories_store, self.records, self.provider, self.vectors)
            self.update_postings(sessions=False)
        return done

    def _refresh_for_search(self) -> list[dict]:
        """As :meth:`refresh`; while another process writes, the index is searched as it is."""
        try:
            return self.refresh().warnings
        except RuntimeError as e:
            return [{"type": "memory_index", "message": f"searched without a refresh: {e}"}]

    # search

    def session_rows(self) -> DataFrame:
        return self._rows_of_sessions(*(self.sessions_store.read(t) for t in SESSION_TABLES))

    def memory_rows(self) -> DataFrame:
        return self._rows_of_memories(*(self.memories_store.read(t) for t in MEMORY_TABLES))

    @staticmethod
    def _rows_of_sessions(chunks: DataFrame, s: DataFrame) -> DataFrame:
        s = s.select("session_key", "native_id", "harness", "cwd", "cwd_key", "updated_at", *[T.tokens(T.normalize(F.col(c))).alias(t) for t, c in (("t_name", "name"), ("t_cwd", "cwd"), ("t_native", "native_id"), ("t_branch", "git_branch"))])
        rows = chunks.withColumnRenamed("tokens", "t_content").withColumn("row_id", F.col("chunk_key"))
        return rows.join(s, "session_key").withColumn("group_key", F.col("session_key"))

    @staticmethod
    def _rows_of_memories(m: DataFrame) -> DataFrame:
        m = m.withColumn("text", F.col("content")).withColumnRenamed("tokens", "t_content")
        return m.select(F.col("id").alias("row_id"), F.col("id").alias("group_key"), "*", *[T.tokens(T.normalize(F.col(c))).alias(t) for t, c in (("t_source", "source"), ("t_project", "project_name"), ("t_id", "id"))])

    def _vector(self, query: str, threshold: float | None) -> tuple[search.QueryVector | None, str]:
        """The query's vector, or why there is none: search goes on without it."""
        if self.provider is None:
            return None, ""
        try:
            limit = filters.check_threshold(self.config.threshold if threshold is None else threshold)
            return search.QueryVector(self.provider.embed_query(query.strip()), self.provider.fingerprint, limit), ""
        except (OSError, ValueError) as e:
            return None, str(e)

    def search_sessions(self, query: str, f: SessionFilters | None = None, threshold: float | None = None) -> tuple[DataFrame, str]:
        vector, error = self._vector(query, threshold)
        s = self.sessions_store.read("sessions")
        fused = search.hybrid(s.withColumn("group_key", F.col("session_key")), self.session_rows(), channels.SESSIONS, query, f or SessionFilters(), vector, self.sessions_store.postings(SESSION_TABLES))
        return search.session_results(fused, s), error

    def search_memories(self, query: str, f: MemoryFilters | None = None, threshold: float | None = None, refresh: bool = True) -> tuple[DataFrame, str]:
        if refresh:
            self._refresh_for_search()
        vector, error = self._vector(query, threshold)
        m = self.memories_store.read("memories").withColumn("text", F.col("content")).withColumn("group_key", F.col("id"))
        fused = search.hybrid(m, self.memory_rows(), channels.MEMORIES, query, f or MemoryFilters(all_projects=True), vector, self.memories_store.postings(MEMORY_TABLES))
        keep = m.select("id", "scope", "project_key", "project_remote", "project_name", "source", "current_revision", "content", "created_at", F.col("updated_at").alias("changed_at"), "archived_at")
        return keep.join(F.broadcast(fused), keep["id"] == fused["group_key"]).drop("group_key", "row_id", "text"), error

    def search(self, query: str, sessions: SessionFilters | None = None, memories: MemoryFilters | None = None, threshold: float | None = None) -> dict:
        """Both corpora, ranked apart, as plain values."""
        warnings = self._refresh_for_search()
        out: dict = {"query": query}
        for name, (df, error) in (("memories", self.search_memories(query, memories, threshold, refresh=False)), ("sessions", self.search_sessions(query, sessions, threshold))):
            out[name] = {"results": [r.asDict() for r in df.orderBy("rank").collect()]} | ({"semanticError": error} if error else {})
            if error:
                warnings.append({"type": "semantic_search", "message": error})
        return out | {"warnings": warnings}

    # scope

    @staticmethod
    def memory_scope(path: str = "", global_only: bool = False, all_projects: bool = False, include_archived: bool = False, limit: int = 3) -> MemoryFilters:
        """The project around ``path`` or, by default, the working directory; outside of any, global records only."""
        if global_only or all_projects:
            return MemoryFilters("", all_projects, global_only, include_archived, limit)
        found = project.around(path or os.getcwd())
        if found is None and path:
            raise ValueError(f"{path} is not inside a Git repository")
        return MemoryFilters(found.key if found else "", False, found is None, include_archived, limit)

    @staticmethod
    def session_scope(path: str = "", all_projects: bool = False) -> str:
        """The folder that sessions must be of: ``path``, else the work tree around the working directory."""
        if not path and not all_projects and (found := project.around(os.getcwd())):
            path = found.root
        return os.path.abspath(path) if path else ""

    # records

    def remember(self, content: str, path: str | None = None, global_scope: bool = False, source: str = "") -> dict:
        """A new note of the project around ``path``, or a global one."""
        if global_scope:
            made = self.records.create("global", content, source)
        else:
            who = project.around(path or os.getcwd())
            if who is None:
                raise ValueError("not inside a Git repository; use a global memory")
            made = self.records.create("project", content, source, who.key, who.remote, who.name)
        self.refresh()
        return made

    def edit(self, prefix: str, content: str) -> dict:
        return self._changed(self.records.edit(prefix, content))

    def forget(self, prefix: str) -> dict:
        return self._changed(self.records.forget(prefix))

    def restore(self, prefix: str) -> dict:
        return self._changed(self.records.restore(prefix))

    def _changed(self, record: dict) -> dict:
        self.refresh()
        return record

    def records_warnings(self) -> list[dict]:
        """What is wrong with the record files as they are now."""
        return self.records.warnings()

    def show(self, prefix: str) -> dict:
        return self.records.load(prefix)

    def history(self, prefix: str) -> DataFrame:
        r = self.records.load(prefix)
        return self.spark.createDataFrame([(x["revision"], x["content"], x["createdAt"]) for x in r["revisions"]], "revision int, content string, created_at string")

    def list(self, f: MemoryFilters | None = None) -> DataFrame:
        """All matching records, the newest first."""
        self.refresh()
        f = f or MemoryFilters(all_projects=True)
        return maintenance.newest_first(self.memories_store.read("memories").where(f.predicate()))

    # reports

    def status(self) -> dict:
        print_ = self.provider.fingerprint if self.provider else ""
        s = {t: self.sessions_store.read(t) for t in ("sources", "sessions", "chunks", "parser_errors")}
        out = maintenance.index_stats(*s.values(), print_).first().asDict()
        out |= {f"memory_{k}": v for k, v in maintenance.memory_stats(self.memories_store.read("memories"), print_).first().asDict().items()}
        _, warnings = self.records.listing()
        return out | {"memory_conflicts": len(warnings), "last_indexed_at": self.sessions_store.meta("last_indexed_at")}

    def doctor(self) -> DataFrame:
        """(check, ok, detail)."""
        rows = [(f"harness {h}", self.installed(h) or os.path.exists(self.config.sources.get(h) or "/nonexistent"), self.config.sources.get(h, "")) for h, on in self.config.harnesses.items() if on]
        for name, store in (("session index", self.sessions_store), ("memory index", self.memories_store)):
            try:
                rows.append((name, True, f"snapshot {store.manifest()['number']}"))
            except RuntimeError as e:
                rows.append((name, False, str(e)))
        rows += [(f"parser error {r['path']}", False, r["error"]) for r in maintenance.sorted_errors(self.sessions_store.read("parser_errors")).collect()]
        rows += [(f"conflict {w['path']}", False, w["message"]) for w in self.records.listing()[1]]
        return self.spark.createDataFrame(rows, "check string, ok boolean, detail string")
