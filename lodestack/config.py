"""Settings from a file (YAML where its library is there, else JSON) with overrides from the environment."""

from __future__ import annotations

import json
import os
from collections.abc import Mapping
from pathlib import Path
from typing import Any

DEFAULTS: dict[str, Any] = {
    "chunking": {"max_tokens": 400, "overlap_tokens": 60, "cut_references": False},
    "quality": {"min_tokens": 30, "min_chars": 80, "min_alpha": 0.4},
    "retrieval": {"top_k": 10, "rrf_constant": 60, "rerank_threshold": -8.0, "feedback_weight": 0.3},
    "taxonomy": {"beam": 3, "least": 0.05, "floor": 0.30, "gap": 0.10, "depth": 6},
}


def load_config(path: str | None = None, prefix: str = "LODESTACK", env: Mapping[str, str] | None = None) -> dict[str, Any]:
    """DEFAULTS, then the file's values, then PREFIX_SECTION__KEY from the environment, read as JSON where they are."""
    out = json.loads(json.dumps(DEFAULTS))
    if path and Path(path).exists():
        raw = Path(path).read_text(encoding="utf-8")
        try:
            import yaml

            given = yaml.safe_load(raw) or {}
        except ModuleNotFoundError:
            given = json.loads(raw or "{}")
        _merge(out, given)
    for name, value in (os.environ if env is None else env).items():
        if name.startswith(f"{prefix}_"):
            *sections, key = name[len(prefix) + 1:].lower().split("__")
            at = out
            for s in sections:
                at = at.setdefault(s, {})
            try:
                at[key] = json.loads(value)
            except ValueError:
                at[key] = value
    return out


def _merge(into: dict[str, Any], given: Mapping[str, Any]) -> None:
    for k, v in given.items():
        if isinstance(v, Mapping) and isinstance(into.get(k), dict):
            _merge(into[k], v)
        else:
            into[k] = v
