"""Settings: defaults, then the user's file, then the project's; each value only if its type fits."""

from __future__ import annotations

import json
import math
from dataclasses import asdict, dataclass, fields, replace
from pathlib import Path


@dataclass(frozen=True)
class Settings:
    enabled: bool = True
    hints_enabled: bool = True
    min_relevance: int = 40
    min_confidence: int = 30
    hint_min_relevance: int = 80
    hint_min_confidence: int = 70
    freshness_high_days: float = 7
    freshness_medium_days: float = 30


def _camel(name: str) -> str:
    head, *rest = name.split("_")
    return head + "".join(x.title() for x in rest)


def read_object(path: str | Path) -> dict | None:
    """A JSON object from a file; None for anything else."""
    try:
        found = json.loads(Path(path).read_text("utf-8"))
    except (OSError, ValueError):
        return None
    return found if isinstance(found, dict) else None


def overlay(base: Settings, given: dict | None) -> Settings:
    new = {}
    for f in fields(Settings):
        value = (given or {}).get(_camel(f.name))
        if isinstance(getattr(base, f.name), bool):
            ok = isinstance(value, bool)
        else:
            ok = isinstance(value, int | float) and not isinstance(value, bool) and math.isfinite(value)
            if ok:
                value = max(1, value) if f.name.endswith("days") else max(0, min(100, math.floor(value + 0.5)))
        if ok:
            new[f.name] = value
    return replace(base, **new)


def load(user_file: str | Path, project_file: str | Path) -> Settings:
    """Effective settings; the medium span of freshness is never shorter than the high one."""
    out = overlay(overlay(Settings(), read_object(user_file)), read_object(project_file))
    return replace(out, freshness_medium_days=max(out.freshness_medium_days, out.freshness_high_days))


def save(path: str | Path, change: dict) -> None:
    """Write defaults, what the file has, and the change, as they are."""
    merged = {_camel(k): v for k, v in asdict(Settings()).items()} | (read_object(path) or {}) | change
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(json.dumps(merged, indent=2) + "\n", "utf-8")
