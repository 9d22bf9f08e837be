"""What project a folder belongs to, read from the Git files around it.

No program is started: the work tree is the nearest folder upwards that has a ``.git``,
and the remote is the address of ``origin`` in its configuration.
"""

from __future__ import annotations

import os
import re
from pathlib import Path
from typing import NamedTuple

from .functions.identity import remote_name


class Project(NamedTuple):
    """``key`` is the same for all clones of one remote."""

    root: str
    key: str
    remote: str
    name: str


_SECTION = re.compile(r"\s*\[\s*([^\s\]\"]+)\s*(?:\"([^\"]*)\")?\s*\]")
_SETTING = re.compile(r"\s*([A-Za-z][\w-]*)\s*=\s*(.*?)\s*$")


def _settings(folder: Path) -> Path:
    """The folder of the configuration; a work tree added to a clone points to the clone's."""
    if folder.is_file():
        said = folder.read_text(encoding="utf-8", errors="replace").partition("gitdir:")[2].strip()
        folder = (folder.parent / said).resolve()
    shared = folder / "commondir"
    return (folder / shared.read_text(encoding="utf-8").strip()).resolve() if shared.is_file() else folder


def _origin(config: Path) -> str:
    section, url = ("", ""), ""
    for line in config.read_text(encoding="utf-8", errors="replace").splitlines() if config.is_file() else ():
        if m := _SECTION.match(line):
            section = m[1].lower(), m[2] or ""
        elif section == ("remote", "origin") and (m := _SETTING.match(line)) and m[1].lower() == "url" and not url:
            url = m[2].strip('"')
    return url


def around(path: str) -> Project | None:
    """The project around a path; None outside of any."""
    here = Path(path).resolve()
    for folder in (here, *here.parents):
        if (folder / ".git").exists():
            remote = _origin(_settings(folder / ".git") / "config")
            key = remote_name(remote) or f"local/{folder.name}"
            return Project(str(folder), key, remote, os.path.basename(key))
    return None
