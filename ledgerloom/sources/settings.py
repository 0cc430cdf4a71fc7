"""Tuning settings from YAML (if a parser is installed) or JSON."""

from __future__ import annotations

import json

from ..errors import TuningError

KEYS = ("n_splits", "scoring", "grids")


def load_tuning(path: str) -> dict:
    """The ``tuning`` section; an error if it, or a key of it, is missing."""
    try:
        with open(path, encoding="utf-8") as file:
            text = file.read()
    except OSError as e:
        raise TuningError(f"{path} can't be read") from e
    if path.endswith(".json"):
        data = json.loads(text)
    else:
        try:
            import yaml
        except ModuleNotFoundError as e:
            raise TuningError("no YAML parser is installed; give the settings as JSON") from e
        data = yaml.safe_load(text)
    found = (data or {}).get("tuning")
    if not isinstance(found, dict):
        raise TuningError(f"{path} has no section 'tuning'")
    missing = [k for k in KEYS if k not in found]
    if missing:
        raise TuningError(f"'tuning' lacks {missing}")
    return found
