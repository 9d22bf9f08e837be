"""Sessions, entries, warnings and errors from the event rows of one harness."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import identity
from ..functions import text as T
from ..operators.filters import path_key
from ..operators.lineage import cut
from ..operators.running import running_totals
from . import jsonl, sqlite

#: What a session without an identifier is reported as (fixed values).
MISSING = {"pi": "missing session header", "codex": "missing session metadata", "claude": "missing session ID", "opencode": "missing session"}


@dataclass
class Parsed:
    sessions: DataFrame
    entries: DataFrame
    warnings: DataFrame
    errors: DataFrame


def discover(harness: str, root: str) -> list[dict]:
    """Sources of a harness below its root (for the database: in its file)."""
    if harness == "opencode":
        return sqlite.discover(root)
    skip = (lambda p: "subagents" in p.split("/")) if harness == "claude" else None
    return jsonl.discover(harness, root, skip)


#: What :func:`assemble` wants to know of the sources; the last three of a database's only.
KNOWN = "source_key string, path string, parent_id string, started_at bigint, updated_at bigint"


def parse(spark: SparkSession, harness: str, sources: list[dict]) -> Parsed:
    """Files are read once: the events are cut from the files before several tables are made of them."""
    events = sqlite.read_events(spark, sources) if harness == "opencode" else jsonl.read_events(spark, sources, harness)
    known = spark.createDataFrame([(s["source_key"], s["path"], s.get("parent_id"), s.get("started_at"), s.get("updated_at")) for s in sources], KNOWN)
    return assemble(cut(events), harness, known)


def assemble(events: DataFrame, harness: str, known: DataFrame) -> Parsed:
    """All of it per source, in the order of its records."""
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("ord")))
    is_entry = F.col("entry_kind").isNotNull()
    per = events.groupBy("source_key", "path").agg(
        last("session_id").alias("native_id"), last("cwd").alias("cwd"), last("name").alias("name"), last("branch").alias("git_branch"), last("remote").alias("git_remote"),
        F.min("ts").alias("started_at"), F.max("ts").alias("updated_at"), F.min_by("text", F.when(is_entry & (F.col("role") == "user"), F.col("ord"))).alias("first_user"),
        F.min(F.when(F.col("kind") == "error", F.col("message"))).alias("error"),
    )
    if harness == "opencode":  # the database says it itself
        per = per.drop("started_at", "updated_at")
        known = known.select("source_key", "path", "parent_id", "started_at", "updated_at")
    else:
        known = known.select("source_key", "path", F.lit("").alias("parent_id"))
    per = known.join(per.drop("path"), "source_key", "left")  # an empty file has no event
    no_id = F.coalesce(F.col("native_id"), F.lit("")) == ""
    per = per.withColumn("error", F.coalesce("error", F.when(no_id, F.lit(MISSING[harness]))))
    title = {"pi": "Pi", "codex": "Codex", "claude": "Claude", "opencode": "OpenCode"}[harness]
    errors = per.where(F.col("error").isNotNull()).select("source_key", F.lit(harness).alias("harness"), "path", F.concat(F.lit(f"parse {title} session "), "path", F.lit(": "), "error").alias("error"))
    good = per.where(F.col("error").isNull())
    blank = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    sessions = good.select(
        identity.stable_key(harness, F.col("native_id")).alias("session_key"), F.lit(harness).alias("harness"), "native_id", blank("parent_id"),
        F.coalesce("name", T.first_line_title(F.col("first_user"))).alias("name"), blank("cwd"), "source_key", F.col("path").alias("source_path"),
        F.coalesce("started_at", F.lit(0)).cast("bigint").alias("started_at"), F.coalesce("updated_at", F.lit(0)).cast("bigint").alias("updated_at"), blank("git_branch"), blank("git_remote"),
        path_key(F.coalesce(F.col("cwd"), F.lit(""))).alias("cwd_key"),
    )
    rows = events.where(is_entry & (F.col("kind") == "event"))
    if harness == "codex":  # an entry without an identifier has its number among those that count
        narrow = rows.select("source_key", "ord", F.coalesce(F.col("counts"), F.lit(False)).cast("bigint").alias("counted"))
        nth = running_totals(narrow, ["source_key"], ["ord"], {"nth": "counted"}).drop("counted")
        rows = rows.join(nth, ["source_key", "ord"])
        rows = rows.withColumn("entry_id", F.when(F.col("entry_id") == "", F.concat("entry_kind", F.lit("-"), F.col("nth").cast("string"))).otherwise(F.col("entry_id"))).drop("nth")
    rows = rows.join(sessions.select("source_key", "session_key", F.col("native_id").alias("sid")), "source_key")
    parts = [F.col("sid"), F.col("entry_id"), *([] if harness == "opencode" else [F.col("entry_kind")])]
    entries = rows.select(
        identity.stable_key(harness, *parts).alias("entry_key"), "session_key", "source_key", F.col("entry_id").alias("entry_native_id"), blank("entry_parent"), F.col("entry_kind").alias("kind"),
        "role", F.coalesce("ts", F.lit(0)).cast("bigint").alias("timestamp"), "ord", "text",
    ).withColumnRenamed("entry_parent", "entry_parent_id")
    warnings = events.where("kind = 'warning'").groupBy("source_key", "path").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "message"))), lambda x: x["message"]), "; ").alias("message"))
    return Parsed(sessions, entries, warnings, errors)
