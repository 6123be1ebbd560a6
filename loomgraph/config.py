"""Settings of the engine: defaults, then a TOML file of at most 1 MiB, then the environment."""

from __future__ import annotations

import os
import tomllib
from collections.abc import Mapping
from dataclasses import dataclass, fields, replace
from pathlib import Path

from loomgraph.functions import names as N

MOST_BYTES = 1 << 20


@dataclass(frozen=True)
class Config:
    max_depth: int = 3
    max_nodes: int = 100
    max_children: int = 10
    search_limit: int = 10
    callers_limit: int = 20
    churn_limit: int = 20
    changes_limit: int = 50
    churn_files: int = 50
    min_together: int = 2
    semantic_least: float = 0.3
    hybrid_least: float = 0.25
    max_output_tokens: int = 4000
    max_age_hours: float = 24.0
    test_dirs: tuple[str, ...] = tuple(N.TEST_DIRS)
    test_suffixes: tuple[str, ...] = tuple(N.TEST_SUFFIXES)
    test_names: str = N.TEST_NAME
    code: tuple[str, ...] = tuple(N.CODE)
    excluded: tuple[str, ...] = tuple(N.EXCLUDED)
    handlers: tuple[str, ...] = ()
    api_prefixes: tuple[str, ...] = ("/api/v1", "/api/v2", "/api")

    @classmethod
    def load(cls, path: str | None = None, env: Mapping[str, str] | None = None, prefix: str = "LOOMGRAPH_") -> Config:
        out = cls()
        if path and Path(path).exists():
            if Path(path).stat().st_size > MOST_BYTES:
                raise ValueError(f"{path} is larger than {MOST_BYTES} bytes")
            found = tomllib.loads(Path(path).read_text(encoding="utf-8"))
            flat = {k: v for part in found.values() if isinstance(part, dict) for k, v in part.items()} | {k: v for k, v in found.items() if not isinstance(v, dict)}
            out = replace(out, **{f.name: type(getattr(out, f.name))(flat[f.name]) for f in fields(cls) if f.name in flat})
        env = os.environ if env is None else env
        parsed = lambda old, text: tuple(x for x in text.split(",") if x) if isinstance(old, tuple) else type(old)(text)
        return replace(out, **{f.name: parsed(getattr(out, f.name), env[prefix + f.name.upper()]) for f in fields(cls) if prefix + f.name.upper() in env})
