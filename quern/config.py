"""Settings: defaults, then a TOML file, then the environment names the file."""

from __future__ import annotations

import os
import tomllib
from dataclasses import dataclass, field, replace

THRESHOLD = 0.80


def _expand(path: str) -> str:
    return os.path.expanduser(path) if path else path


@dataclass(frozen=True)
class Config:
    index: str
    memory_directory: str
    memory_index: str
    #: Where vectors are kept by their texts; '' is beside the index.
    vectors: str = ""
    embedding_url: str = "http://localhost:11434"
    embedding_model: str = "embeddinggemma"
    threshold: float = THRESHOLD
    harnesses: dict[str, bool] = field(default_factory=lambda: dict.fromkeys(("pi", "codex", "opencode", "claude"), True))
    sources: dict[str, str] = field(default_factory=dict)


def default() -> Config:
    home = os.path.expanduser("~")
    data = os.path.join(os.environ.get("XDG_DATA_HOME") or os.path.join(home, ".local", "share"), "quern")
    return Config(
        os.path.join(data, "index"), os.path.join(data, "memories"), os.path.join(data, "memory-index"),
        sources={"pi": f"{home}/.pi/agent/sessions", "codex": f"{home}/.codex/sessions", "claude": f"{home}/.claude/projects", "opencode": ""},
    )


def path() -> str:
    home = os.environ.get("XDG_CONFIG_HOME") or os.path.join(os.path.expanduser("~"), ".config")
    return os.environ.get("QUERN_CONFIG") or os.path.join(home, "quern", "config.toml")


def load(file: str | None = None) -> Config:
    """A missing file is the defaults."""
    cfg = default()
    file = file or path()
    if os.path.exists(file):
        with open(file, "rb") as f:
            found = tomllib.load(f)
        flat = {k: v for k, v in found.items() if k in ("index", "memory_directory", "memory_index", "vectors")}
        e = found.get("embedding", {})
        flat |= {a: e[b] for a, b in (("embedding_url", "url"), ("embedding_model", "model"), ("threshold", "threshold")) if b in e}
        cfg = replace(cfg, **flat, harnesses=cfg.harnesses | found.get("harnesses", {}), sources=cfg.sources | found.get("sources", {}))
    if not 0 <= cfg.threshold <= 1:
        raise ValueError("embedding threshold must be between 0 and 1")
    return replace(cfg, index=_expand(cfg.index), memory_directory=_expand(cfg.memory_directory), memory_index=_expand(cfg.memory_index), vectors=_expand(cfg.vectors), sources={k: _expand(v) for k, v in cfg.sources.items()})


def check_index_outside(records: str, index: str) -> None:
    """A disposable index must not lie inside the canonical folder."""
    a, b = os.path.realpath(records), os.path.realpath(index)
    if a == b or b.startswith(a + os.sep):
        raise ValueError("index must not be inside the memory directory")
