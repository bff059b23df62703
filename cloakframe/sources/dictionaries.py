"""Dictionaries and run settings read on the driver (they are small by nature)."""

from __future__ import annotations

import csv
import json
import os
import re

from cloakframe.operators.matching import Guard, merged


def word_map(path: str) -> list[tuple[str, str]]:
    """key and optional template per line; `#` starts a comment line."""
    with open(path, encoding="utf-8", newline="") as f:
        rows = list(csv.reader(x for x in f if not x.startswith("#")))
    return [(r[0].strip(), r[1].strip() if len(r) > 1 else "") for r in rows if r and r[0].strip()]


def word_set(path: str) -> list[str]:
    """The first cell of each line; there are no comments, so `#` is a value like others."""
    with open(path, encoding="utf-8", newline="") as f:
        return list(dict.fromkeys(r[0].strip() for r in csv.reader(f) if r and r[0].strip()))


def pattern_key(key: str) -> str:
    """A pattern as a settings key: one outer pair of brackets, which only protects it, goes."""
    return key[1:-1] if key.startswith("[") and key.endswith("]") and len(key) > 2 else key


def guard_of(settings: dict) -> Guard:
    """A Guard from a direction's settings: word.guard and word.ignore with values, patterns and their files."""
    word = settings.get("word") or {}
    guard, ignore = word.get("guard") or {}, word.get("ignore") or {}
    pairs = [*(guard.get("values") or {}).items()] + [p for f in guard.get("valueFiles") or [] for p in word_map(f)]
    patterns = [(pattern_key(k), v) for k, v in (guard.get("patterns") or {}).items()] + [p for f in guard.get("patternFiles") or [] for p in word_map(f)]
    values = set(ignore.get("values") or []) | {w for f in ignore.get("valueFiles") or [] for w in word_set(f)}
    searched = [*(ignore.get("patterns") or []), *(w for f in ignore.get("patternFiles") or [] for w in word_set(f))]
    return Guard(merged((k.lower(), v) for k, v in pairs), merged(patterns), values, searched, settings.get("defaultTemplate") or "w{hash}")


def read_settings(path: str) -> dict:
    """A settings file: JSON, or YAML where a YAML parser is installed.

    Files that spring.config.import names are read over it, and ${a.b:default} stands for another setting.
    """
    found = _loaded(path)
    names = ((found.get("spring") or {}).get("config") or {}).get("import") or []
    for name in [names] if isinstance(names, str) else names:
        name = _resolved(name, found)
        at = os.path.join(os.path.dirname(path), name.removeprefix("optional:").removeprefix("file:"))
        if os.path.exists(at) or not name.startswith("optional:"):
            found = _over(found, read_settings(at))
    return _resolved(found, found)


def _loaded(path: str) -> dict:
    with open(path, encoding="utf-8") as f:
        text = f.read()
    try:
        return json.loads(text)
    except ValueError:
        import yaml

        return yaml.safe_load(text) or {}


def _over(low, high):
    """Settings with those of high put over them, key by key."""
    if not (isinstance(low, dict) and isinstance(high, dict)):
        return high
    return {k: _over(low[k], high[k]) if k in low and k in high else (high if k in high else low)[k] for k in {**low, **high}}


def _resolved(value, settings: dict, depth: int = 0):
    if isinstance(value, dict):
        return {k: _resolved(v, settings, depth) for k, v in value.items()}
    if isinstance(value, list):
        return [_resolved(v, settings, depth) for v in value]
    if not isinstance(value, str):
        return value

    def put(m: re.Match) -> str:
        at = settings
        for k in m[1].split("."):
            at = at.get(k) if isinstance(at, dict) else None
        if at is None and m[2] is None:
            raise KeyError(f"no setting {m[1]}")
        return str(_resolved(m[2] if at is None else at, settings, depth + 1))

    if depth > 20:
        raise ValueError(f"settings stand for each other in a circle: {value}")
    return re.sub(r"\$\{([^{}:]+)(?::([^{}]*))?\}", put, value)
