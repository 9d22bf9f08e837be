"""Metadata filters of the two corpora."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

HARNESSES = ("pi", "codex", "opencode", "claude")
ROLES = ("user", "assistant")


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def path_key(col: Column) -> Column:
    """A directory as prefixes are compared: ASCII letters in lower case."""
    return F.translate(col, _UPPER, _LOWER)


def path_prefix(col: Column, path: str, key: Column | None = None) -> Column:
    """The directory itself (case-sensitive) or below it (ASCII case-insensitive).

    With ``key``, a column that holds :func:`path_key`, both are comparisons of columns with
    constants, which reach the scan: what is below a directory is a range of keys, for in the
    order of bytes "0" comes right after "/"."""
    p = path.rstrip("/")
    low = p.translate(str.maketrans(_UPPER, _LOWER))
    key = path_key(col) if key is None else key
    return ((key == low) & (col == p)) | ((key >= low + "/") & (key < low + "0"))


def parse_date(value: str, end_of_day: bool = False) -> int:
    """Epoch milliseconds of an RFC 3339 time or a UTC date; as an end, a date is its last millisecond."""
    if len(value) == 10:
        day = dt.datetime.strptime(value, "%Y-%m-%d").replace(tzinfo=dt.UTC)
        return int(day.timestamp() * 1000) + (86_400_000 - 1 if end_of_day else 0)
    when = dt.datetime.fromisoformat(value.replace("Z", "+00:00"))
    if when.tzinfo is None or "T" not in value.upper():
        raise ValueError(f"invalid date {value!r}")
    return round(when.timestamp() * 1000)


def check_limit(limit: int) -> int:
    if limit < 0 or limit > 100:
        raise ValueError("limit must be between 1 and 100")
    return limit or 3


def check_threshold(value: float) -> float:
    if not 0 <= value <= 1:
        raise ValueError("semantic threshold must be between 0 and 1")
    return value


def _names(values, known: tuple[str, ...], what: str) -> tuple[str, ...]:
    found = tuple(dict.fromkeys(v.strip().lower() for v in values if v.strip()))
    for v in found:
        if v not in known:
            raise ValueError(f"unknown {what} {v!r}")
    return found


@dataclass(frozen=True)
class SessionFilters:
    harnesses: tuple[str, ...] = ()
    path: str = ""
    roles: tuple[str, ...] = ()
    since: int | None = None
    before: int | None = None
    limit: int = 3

    def __post_init__(self):
        object.__setattr__(self, "harnesses", _names(self.harnesses, HARNESSES, "harness"))
        object.__setattr__(self, "roles", _names(self.roles, ROLES, "role"))
        object.__setattr__(self, "limit", check_limit(self.limit))

    def predicate(self, with_chunk: bool = True) -> Column:
        """On session columns and, where rows are chunks, on the role."""
        p = F.lit(True)
        if self.harnesses:
            p &= F.col("harness").isin(*self.harnesses)
        if self.path:
            p &= path_prefix(F.col("cwd"), self.path, F.col("cwd_key"))
        if self.since is not None:
            p &= F.col("updated_at") >= self.since
        if self.before is not None:
            p &= F.col("updated_at") <= self.before
        if self.roles and with_chunk:
            p &= F.col("role").isin(*self.roles)
        return p


@dataclass(frozen=True)
class MemoryFilters:
    project_key: str = ""
    all_projects: bool = False
    global_only: bool = False
    include_archived: bool = False
    limit: int = 3
    extra: dict = field(default_factory=dict)

    def __post_init__(self):
        object.__setattr__(self, "limit", check_limit(self.limit))

    def predicate(self, with_chunk: bool = True) -> Column:
        p = F.lit(True) if self.include_archived else F.col("archived_at").isNull()
        if self.all_projects:
            return p
        if self.global_only or not self.project_key:
            return p & (F.col("scope") == "global")
        return p & ((F.col("scope") == "global") | ((F.col("scope") == "project") & (F.col("project_key") == self.project_key)))
