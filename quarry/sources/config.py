"""Settings of a run, from YAML."""

from __future__ import annotations

from dataclasses import dataclass, fields
from pathlib import Path


def load_yaml(path: str) -> dict:
    """The file's mapping; a missing or empty file is an empty one, bad YAML raises."""
    import yaml

    file = Path(path)
    return (yaml.safe_load(file.read_text(encoding="utf-8")) or {}) if file.is_file() else {}


@dataclass(frozen=True)
class Settings:
    folder: str = "data"
    results: str = "results"
    order: str = "bfs"
    heuristic: str | None = None
    max_occurrence: int = 3
    max_tables: int = 3
    max_edges: int = 6
    timeout_s: int = 3600

    @classmethod
    def read(cls, path: str, **overrides: object) -> Settings:
        """Settings of the file, then overrides that aren't None; an unknown name raises."""
        found = load_yaml(path) | {k: v for k, v in overrides.items() if v is not None}
        if unknown := set(found) - {f.name for f in fields(cls)}:
            raise ValueError(f"unknown settings: {', '.join(sorted(unknown))}")
        return cls(**found)
