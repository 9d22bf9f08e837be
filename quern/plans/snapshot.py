"""Versioned tables: immutable Parquet folders named by numbered manifests.

A commit writes new folders for the tables that changed and then creates the
next manifest, exclusively; a reader takes the latest manifest once.  Nothing
that is read is ever overwritten, an interrupted commit leaves no trace but
unused folders, and two writers can't create the same manifest.  All file
operations go through Hadoop's file system API, so the root may be in any store.

Large tables lie in buckets of a key (:data:`PARTED`), each a folder of its own, so a
commit writes the buckets that changed and the manifest names the others again.  Their
number follows the rows of the table whenever all of it is written; a bucket that is large
all the same is dealt to several tasks and files.
What newer commits don't name stays for ``KEEP_MS``, for readers that still use it.
"""

from __future__ import annotations

import json
import math
import os
import socket
import time
import uuid
from collections.abc import Iterable
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..operators import segments as S
from ..operators.lineage import cut

#: Commits whose folders stay in any case, and how long all others stay.
KEEP, KEEP_MS = 2, 24 * 3600 * 1000
#: Tables in buckets, by key; the number of buckets that a small table has, rows that a bucket of a larger one aims at, and the most.
PARTED, BUCKETS, BUCKET_ROWS, MOST_BUCKETS = {"chunks": "source_key"}, 64, 500_000, 16_384
#: Tables sorted by a key, so that a range of it skips files and row groups.
CLUSTERED = {"sessions": "cwd_key"}
#: After so long the lock of a writer that can't be asked counts as left behind.
LEASE_MS = 6 * 3600 * 1000


def bucket_of(key: str, buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def buckets_for(rows: int) -> int:
    """A power of two, so that the number changes seldom."""
    return min(MOST_BUCKETS, max(BUCKETS, 1 << max(0, math.ceil(math.log2(max(1, rows) / BUCKET_ROWS)))))


class Snapshot:
    def __init__(self, spark: SparkSession, root: str, keep_ms: int = KEEP_MS):
        self.spark, self.root, self.keep_ms = spark, root.rstrip("/"), keep_ms
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self.fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    # manifests

    def _manifests(self) -> list[str]:
        at = self._path(self.root)
        if not self.fs.exists(at):
            return []
        return sorted(n for s in self.fs.listStatus(at) if (n := s.getPath().getName()).startswith("manifest-"))

    def manifest(self) -> dict:
        names = self._manifests()
        if not names:
            return {"schema_version": schemas.VERSION, "number": 0, "tables": {}, "meta": {}}
        stream = self.fs.open(self._path(f"{self.root}/{names[-1]}"))
        try:
            found = json.loads(bytes(stream.readAllBytes()))
        finally:
            stream.close()
        if found["schema_version"] > schemas.VERSION:
            raise RuntimeError(f"index schema {found['schema_version']} is newer than this program")
        if found["schema_version"] < schemas.VERSION:
            raise RuntimeError(f"index schema {found['schema_version']} is unknown; rebuild the index")
        return found

    # tables

    def read(self, table: str) -> DataFrame:
        return self.read_folders(table, self.manifest()["tables"].get(table))

    def read_folders(self, table: str, found: dict[str, str] | str | None) -> DataFrame:
        """A table as a manifest names it: its folder, or its folders by bucket."""
        paths = list(found.values()) if isinstance(found, dict) else [found] if found else []
        if not paths:
            return self.spark.createDataFrame([], schemas.TABLES[table])
        return self.spark.read.parquet(*[f"{self.root}/{p}" for p in paths])

    def commit(self, tables: dict[str, DataFrame], meta: dict[str, str] | None = None, buckets: dict[str, Iterable[int]] | None = None, folders: dict[str, dict[str, str]] | None = None) -> int:
        """Write the tables given and the next manifest; the others stay as they are.

        ``folders`` are tables whose folders are written already.  ``buckets`` names the buckets of a table in buckets that may have changed; without
        it all are written."""
        now = self.manifest()
        written: dict = {}
        meta = dict(meta or {})
        for name, df in tables.items():
            path = f"data/{name}-{now['number'] + 1:06d}-{uuid.uuid4().hex[:8]}"
            if name in PARTED:
                old, changed = now["tables"].get(name), (buckets or {}).get(name)
                whole = not isinstance(old, dict) or changed is None
                number = buckets_for(df.count()) if whole else self.buckets(name)
                meta[f"buckets_{name}"] = str(number)
                written[name] = self._write_buckets(name, df, path, number, {} if whole else old, None if whole else changed)
                continue
            df = df.select(*schemas.names(schemas.TABLES[name]))
            if key := CLUSTERED.get(name):
                df = df.repartitionByRange(key).sortWithinPartitions(key)
            df.write.parquet(f"{self.root}/{path}")
            written[name] = path
        new = {"schema_version": schemas.VERSION, "number": now["number"] + 1, "tables": now["tables"] | written | (folders or {}), "meta": now["meta"] | meta}
        out = self.fs.create(self._path(f"{self.root}/manifest-{new['number']:06d}.json"), False)
        try:
            out.write(bytearray(json.dumps(new, indent=2).encode()))
        finally:
            out.close()
        self._vacuum()
        return new["number"]

    def buckets(self, name: str) -> int:
        """The number of buckets that a table has."""
        return int(self.manifest()["meta"].get(f"buckets_{name}", BUCKETS))

    def _write_buckets(self, name: str, df: DataFrame, path: str, number: int, old: dict[str, str], changed: Iterable[int] | None) -> dict[str, str]:
        """Folder by bucket: new ones of the changed buckets (None: of all), the old ones of the rest."""
        df = df.select(*schemas.names(schemas.TABLES[name]), bucket_of(PARTED[name], number).alias("bucket"))
        kept: dict[str, str] = {}
        if changed is not None:
            changed = sorted(set(changed))
            kept = {b: p for b, p in old.items() if int(b) not in changed}
            df = df.where(F.col("bucket").isin(changed))
        # rows of a bucket come together, so a small one is few files, and a large one is split by its size
        df.hint("rebalance", "bucket").write.partitionBy("bucket").parquet(f"{self.root}/{path}")
        there = [s.getPath().getName() for s in self.fs.listStatus(self._path(f"{self.root}/{path}"))]
        return kept | {n.removeprefix("bucket="): f"{path}/{n}" for n in there if n.startswith("bucket=")}

    def _vacuum(self) -> None:
        """Drop what is older than ``keep_ms`` and named by neither of the last two manifests."""
        limit = time.time() * 1000 - self.keep_ms
        names, kept = self._manifests(), set()
        for n in names:
            path = self._path(f"{self.root}/{n}")
            if n not in names[-KEEP:] and self.fs.getFileStatus(path).getModificationTime() < limit:
                self.fs.delete(path, False)
                continue
            stream = self.fs.open(path)
            said = json.loads(bytes(stream.readAllBytes()))
            # what an inverted index was made of is wanted for the difference to what is there now
            for found in [*said["tables"].values(), *json.loads(said["meta"].get(INDEXED, "[]"))]:
                kept |= {p.split("/")[1] for p in (found.values() if isinstance(found, dict) else [found] if found else [])}
            stream.close()
        data = self._path(f"{self.root}/data")
        for s in self.fs.listStatus(data) if self.fs.exists(data) else ():
            if s.getPath().getName() not in kept and s.getModificationTime() < limit:
                self.fs.delete(s.getPath(), True)

    def clear(self) -> None:
        """Start from nothing: a rebuild."""
        at = self._path(self.root)
        for s in self.fs.listStatus(at) if self.fs.exists(at) else ():
            if s.getPath().getName() != LOCK:
                self.fs.delete(s.getPath(), True)

    # lock

    @contextmanager
    def writer(self):
        """One writer of this index: a lock file, created exclusively, that doesn't wait.

        A lock whose process is known to be gone, or that is older than ``LEASE_MS``, is taken over."""
        at = self._path(f"{self.root}/{LOCK}")
        mine = json.dumps({"host": socket.gethostname(), "pid": os.getpid(), "id": uuid.uuid4().hex})
        for last in (False, True):
            try:
                out = self.fs.create(at, False)
                break
            except Exception:  # of the JVM: it exists
                if last or not self._left_behind(at):
                    raise RuntimeError("another indexing process is already running") from None
                self.fs.delete(at, False)
        try:
            out.write(bytearray(mine.encode()))
        finally:
            out.close()
        try:
            yield
        finally:
            self.fs.delete(at, False)

    def _left_behind(self, at) -> bool:
        try:
            age = time.time() * 1000 - self.fs.getFileStatus(at).getModificationTime()
            stream = self.fs.open(at)
            try:
                owner = json.loads(bytes(stream.readAllBytes()) or b"{}")
            finally:
                stream.close()
        except Exception:  # gone meanwhile, or just being written
            return False
        if owner.get("host") == socket.gethostname() and owner.get("pid") != os.getpid():
            try:
                os.kill(owner["pid"], 0)
            except ProcessLookupError:
                return True
            except OSError:
                pass
        return age > LEASE_MS

    # key-value

    def meta(self, key: str) -> str:
        return self.manifest()["meta"].get(key, "")

    # inverted indexes

    def named(self, of: Iterable[str]) -> list:
        """The folders of tables, as the manifest names them."""
        tables = self.manifest()["tables"]
        return [tables.get(t) for t in of]

    def indexed(self) -> list | None:
        """The folders that the inverted index was made of; None without an index."""
        m = self.manifest()
        return json.loads(m["meta"][INDEXED]) if "segments" in m["tables"] else None

    def segments(self) -> list[S.Segment]:
        """The segments that are stored, oldest first."""
        m = self.manifest()
        paths = m["tables"].get("segments", {})
        read = lambda path, part, ddl: self.spark.read.schema(ddl).parquet(f"{self.root}/{path}/{part}")
        out = []
        for sums in json.loads(m["meta"].get("segments", "[]")):
            path = paths[str(sums["number"])]
            out.append(S.Segment(**sums, blocks=read(path, "blocks", S.BLOCKS), terms=read(path, "terms", S.TERMS), gone=read(path, "gone", S.GONE)))
        return out

    def _commit_segments(self, kept: list[S.Segment], new: S.Segment | None, of: Iterable[str]) -> None:
        """The next manifest names the kept segments and a new one, which is written sorted by term."""
        m = self.manifest()
        folders = {str(s.number): m["tables"]["segments"][str(s.number)] for s in kept}
        sums = [s.sums() for s in kept]
        if new is not None:
            path = f"data/segments-{m['number'] + 1:06d}-{uuid.uuid4().hex[:8]}"
            at = f"{self.root}/{path}"
            new.blocks.repartitionByRange("kind", "term", "slot").sortWithinPartitions("kind", "term", "slot").write.parquet(f"{at}/blocks")
            new = new.stored(self.spark.read.schema(S.BLOCKS).parquet(f"{at}/blocks"))
            new.terms.repartitionByRange("kind", "term").sortWithinPartitions("kind", "term").write.parquet(f"{at}/terms")
            new.gone.write.parquet(f"{at}/gone")
            folders[str(new.number)] = path
            sums.append(new.sums())
        self.commit({}, {"segments": json.dumps(sums), INDEXED: json.dumps(self.named(of), sort_keys=True)}, folders={"segments": folders})

    def write_postings(self, rows: DataFrame, weights: dict[str, float], of: Iterable[str]) -> None:
        """Store the inverted index of search rows as one segment; ``of`` names the tables that the rows are made of."""
        last = max((s.number for s in self.segments()), default=0)
        self._commit_segments([], S.segment(rows, None, weights, last + 1), of)

    def add_postings(self, old: DataFrame, new: DataFrame, weights: dict[str, float], of: Iterable[str]) -> None:
        """Store the difference of search rows, as they were indexed and as they are, as one more segment."""
        wanted = ["row_id", *weights, "grams"]
        added, removed = (cut(rows.select(*wanted)) for rows in S.difference(old.select(*wanted), new.select(*wanted), weights))
        there = self.segments()
        if added.isEmpty() and removed.isEmpty():
            self._commit_segments(there, None, of)
            return
        self._commit_segments(there, S.segment(added, removed, weights, there[-1].number + 1), of)
        there = self.segments()
        if len(there) > S.MOST_SEGMENTS:
            start = S.to_merge([s.rows + s.n_gone for s in there])
            self._commit_segments(there[:start], S.merged(S.Index(there), start), of)

    def postings(self, of: Iterable[str]) -> S.Index | None:
        """The inverted index if it is that of the tables as they are now."""
        return S.Index(self.segments()) if self.indexed() == self.named(of) and self.segments() else None


#: The key under which a manifest keeps what the inverted index was made of.
INDEXED = "postings_of"
LOCK = "writer.lock"
