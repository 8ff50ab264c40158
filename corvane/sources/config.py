"""Configuration from JSON files: defaults, then the user's, then the project's."""

from __future__ import annotations

import json
import os
from pathlib import Path

NAME = "corvane.json"


def merged(base: dict, over: dict) -> dict:
    """Objects merge, anything else is replaced (lists whole); a missing value (None) leaves what is there."""
    out = dict(base)
    for key, value in over.items():
        if value is None:
            continue
        out[key] = merged(out[key], value) if isinstance(value, dict) and isinstance(out.get(key), dict) else value
    return out


def global_path() -> Path:
    return Path(os.environ.get("XDG_CONFIG_HOME", Path.home() / ".config")) / "corvane" / NAME


def load(defaults: dict, folder: str = ".", user: Path | None = None) -> dict:
    out = defaults
    for path in (user or global_path(), Path(folder) / NAME):
        if path.exists():
            out = merged(out, json.loads(path.read_text()))
    return out


def save_global(values: dict, user: Path | None = None) -> Path:
    path = user or global_path()
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(json.dumps(values, indent=2))
    return path
