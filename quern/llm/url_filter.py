"""URL filters: a bit-parallel wildcard automaton (multiword Shift-And).

Every glob is laid out as positions in one long bit vector; all patterns are
simulated at once, one shift, two ANDs and two ORs a character, over the
canonical URL.  Python's integers hold the vector, so any number of patterns
fit, and the masks of a character are looked up in a dictionary.

Canonical URL: ``.`` + host (A-Z lower-cased) + ``#`` + path.  Host and path
never contain ``#``, so the mark keeps a host rule from matching inside a path;
the leading dot lets a rule for ``example.org`` match the host itself and all
of its subdomains, but not ``badexample.org``.

Pattern language: ``*`` any characters, ``~`` any characters of the host part,
``?`` one character; a backslash takes the next character literally.

Defined results: a null URL, or one without ``://``, has an empty host and an
empty path, matches no host rule and gets the default verdict (unless a glob
matches the empty URL).  Very long URLs are read whole.  Among rules the
longest (host and path together) wins; equal lengths: the one listed first.
An empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import map_batches


@dataclass(frozen=True)
class Rule:
    """``host`` and its subdomains, with paths that start with ``path``."""

    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


#: The rules of the contract.
RULES = (
    Rule("allow", "org", "/"),
    Rule("block", "example.org", "/es/"),
    Rule("block", "example.org", "/en/1"),
    Rule("allow", "com", "/fr/"),
    Rule("block", "com", "/de/"),
)

#: The method's own verdict where no rule fits: globs over the canonical URL
#: that are blocked; everything else is allowed.
BLOCKED_GLOBS = (
    ".ads.~#*",
    ".adserver.~#*",
    "~.doubleclick.net#*",
    "~#/wp-login.php*",
    "~#/cgi-bin/*",
    "~#*/phpmyadmin/*",
)

SCHEMA = "page_id bigint, host string, path string, rule string, verdict string"

_PARTS = re.compile(r"([^/?#]*)([^?#]*)")
_ASCII_LOWER = {i: i + 32 for i in range(65, 91)}


def split_url(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path, as the contract defines them."""
    if url is None:
        return "", ""
    at = url.find("://")
    if at < 0:
        return "", ""
    rest = url[at + 3 :]
    m = _PARTS.match(rest)
    return m[1].translate(_ASCII_LOWER), m[2]


def literal(text: str) -> str:
    return re.sub(r"([*~?\\])", r"\\\1", text)


class ShiftAnd:
    """All patterns, packed in one automaton."""

    HOST, ANY = "host", "any"

    def __init__(self, patterns: list[str]):
        """Bit layout of a pattern of n tokens: one bit for each state 0..n; state n accepts."""
        self.start = self.accept = 0
        self.loop_any = self.loop_host = self.single = 0
        chars: dict[str, int] = {}
        self.of_bit: dict[int, int] = {}
        at = 0
        for index, pattern in enumerate(patterns):
            self.start |= 1 << at
            i = 0
            while i < len(pattern):
                c = pattern[i]
                if c == "*":
                    self.loop_any |= 1 << at
                elif c == "~":
                    self.loop_host |= 1 << at
                else:
                    at += 1
                    if c == "?":
                        self.single |= 1 << at
                    else:
                        if c == "\\":
                            i += 1
                            c = pattern[i]
                        chars[c] = chars.get(c, 0) | 1 << at
                i += 1
            self.accept |= 1 << at
            self.of_bit[at] = index
            at += 1
        self.masks = {c: m | self.single for c, m in chars.items()}

    def matches(self, text: str) -> list[int]:
        """The patterns that match the whole text."""
        state, masks, single = self.start, self.masks, self.single
        loop_any, loops = self.loop_any, self.loop_any | self.loop_host
        for c in text:
            if c == "#":  # the host ends: its wildcard doesn't cross
                loops = loop_any
            state = ((state << 1) & masks.get(c, single)) | (state & loops)
            if not state:
                return []
        state &= self.accept
        out = []
        while state:
            low = state & -state
            out.append(self.of_bit[low.bit_length() - 1])
            state ^= low
        return out


class UrlFilter:
    def __init__(self, rules=RULES, blocked_globs=BLOCKED_GLOBS, default: str = "allow"):
        self.rules = tuple(rules)
        self.default = default
        patterns = []
        for r in self.rules:
            # the wildcard may be empty: then it is the host itself, else a subdomain
            patterns.append(f"~.{literal(r.host)}#{literal(r.path)}*")
        self.automaton = ShiftAnd([*patterns, *blocked_globs])

    def judge(self, host: str, path: str) -> tuple[str | None, str]:
        found = self.automaton.matches(f".{host}#{path}")
        ours = [i for i in found if i < len(self.rules)]
        if ours:
            best = min(ours, key=lambda i: (-len(self.rules[i].name), i))
            return self.rules[best].name, self.rules[best].verdict
        return None, "block" if found else self.default


def filter_urls(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", rules=RULES, blocked_globs=BLOCKED_GLOBS, default: str = "allow") -> DataFrame:
    """One verdict per row, in one pass; only the id and the URL are read."""

    def make():
        urls = UrlFilter(rules, blocked_globs, default)

        def fn(batch: pa.RecordBatch) -> pa.RecordBatch:
            parts = [split_url(u) for u in batch.column(1).to_pylist()]
            said = [urls.judge(*p) for p in parts]
            return pa.RecordBatch.from_arrays(
                [
                    batch.column(0).cast(pa.int64()),
                    pa.array([h for h, _ in parts], pa.string()),
                    pa.array([p for _, p in parts], pa.string()),
                    pa.array([r for r, _ in said], pa.string()),
                    pa.array([v for _, v in said], pa.string()),
                ],
                names=["page_id", "host", "path", "rule", "verdict"],
            )

        return fn

    return map_batches(pages.select(id_col, url_col), make, SCHEMA)
