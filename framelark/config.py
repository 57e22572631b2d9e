"""Nested settings from YAML files: inheritance, deep merge and overrides."""

from __future__ import annotations

import json
from pathlib import Path


def merge(base: dict, over: dict) -> dict:
    """``over`` laid on ``base``; mappings are merged, other values replaced."""
    return {k: merge(base[k], over[k]) if isinstance(base.get(k), dict) and isinstance(over.get(k), dict) else over.get(k, base.get(k)) for k in {**base, **over}}


def overrides(pairs: list[str]) -> dict:
    """``a.b=1`` ... as nested settings; values are read as YAML."""
    import yaml

    made: dict = {}
    for pair in pairs:
        name, found, value = pair.partition("=")
        if not found:
            raise ValueError(f"{pair!r} isn't of the form key=value")
        nested = yaml.safe_load(value)
        for part in reversed(name.split(".")):
            nested = {part: nested}
        made = merge(made, nested)
    return made


def load(path: str, sets: list[str] | None = None) -> dict:
    """The settings of a file over those of the file that it inherits from (one level)."""
    import yaml

    own = yaml.safe_load(Path(path).read_text()) or {}
    if parent := own.pop("inherits", None):
        base = yaml.safe_load((Path(path).parent / parent).read_text()) or {}
        base.pop("inherits", None)
        own = merge(base, own)
    return merge(own, overrides(sets or []))


def snapshot(settings: dict, path: str) -> None:
    Path(path).write_text(json.dumps(settings, indent=2, sort_keys=True, default=str))
