"""Identity functions: the keys that drive upserts."""

from __future__ import annotations

import hashlib
import re
import urllib.parse

from pyspark.sql import Column
from pyspark.sql import functions as F


def stable_key(*parts: Column | str) -> Column:
    """Hex SHA-256 over ``<byte length>:<part>`` of all parts."""
    cols = [F.lit(p) if isinstance(p, str) else p for p in parts]
    return F.sha2(F.concat(*[x for c in cols for x in (F.octet_length(c).cast("string"), F.lit(":"), c)]), 256)


def stable_key_of(*parts: str) -> str:
    """The same for strings on the driver."""
    h = hashlib.sha256()
    for p in parts:
        raw = p.encode()
        h.update(f"{len(raw)}:".encode() + raw)
    return h.hexdigest()


def chunk_key(entry_key: Column, part: Column) -> Column:
    return F.sha2(F.concat(entry_key, F.char(F.lit(0)), part.cast("string")), 256)


def text_hash(text: Column) -> Column:
    return F.sha2(text, 256)


#: Schemes under which a Git remote names a host (fixed values).
REMOTE_SCHEMES = frozenset(("http", "https", "ssh", "git"))
_LONG = re.compile(r"(?P<scheme>[A-Za-z][A-Za-z0-9+.-]*)://(?:[^/?#@]*@)?(?P<host>\[[^\]]*\]|[^/?#:]*)(?::[0-9]*)?(?P<path>[^?#]*)")
_SHORT = re.compile(r"(?:[^@/]+@)?(?P<host>[^:/]+):/?(?P<path>.+)")


def remote_name(raw: str | None) -> str:
    """``host/path`` of a Git remote, written as an address or as ``user@host:path``; '' for anything else."""
    text = (raw or "").strip()
    m = _LONG.match(text) if "://" in text else _SHORT.fullmatch(text)
    if m is None:
        return ""
    found = m.groupdict()
    path = found["path"]
    if "scheme" in found:
        if found["scheme"].lower() not in REMOTE_SCHEMES:
            return ""
        path = urllib.parse.unquote(path)
    both = found["host"].strip().lower(), path.strip().strip("/").removesuffix(".git")
    return "/".join(both) if all(both) else ""


def normalize_remote(raw: Column) -> Column:
    """:func:`remote_name` of a column, by the same patterns in the JVM.

    An address with a percent sign that begins no escape keeps all of its escapes."""
    blank = r"^[\s\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{1C}-\x{1F}]+"
    strip = lambda c: F.regexp_replace(F.regexp_replace(c, blank, ""), blank[1:] + r"\z", "")
    text = strip(F.coalesce(raw, F.lit("")))
    long, short = _java(_LONG), rf"^(?:{_java(_SHORT)})\z"
    is_long = F.contains(text, F.lit("://"))
    part = lambda name: F.when(is_long, F.regexp_extract(text, f"^{long}", _LONG.groupindex[name])).otherwise(F.regexp_extract(text, short, _SHORT.groupindex[name]))
    known = ~is_long | F.lower(F.regexp_extract(text, f"^{long}", _LONG.groupindex["scheme"])).isin(*sorted(REMOTE_SCHEMES))
    path = part("path")
    path = F.when(is_long, F.coalesce(F.try_url_decode(F.replace(path, F.lit("+"), F.lit("%2B"))), path)).otherwise(path)
    host, path = F.lower(strip(part("host"))), F.regexp_replace(F.regexp_replace(strip(path), r"^/+|/+\z", ""), r"\.git\z", "")
    return F.when(known & (host != "") & (path != ""), F.concat(host, F.lit("/"), path)).otherwise(F.lit(""))


def _java(pattern: re.Pattern) -> str:
    """The pattern for Java, whose named groups are written another way."""
    return pattern.pattern.replace("(?P<", "(?<")
