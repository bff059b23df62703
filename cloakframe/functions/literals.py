"""Literals that every match of a regular expression holds."""

from __future__ import annotations

import re
from collections import Counter

LEAST = 3


def _class_end(p: str, i: int) -> int:
    """The place after the character class that begins at i."""
    depth, i = 1, i + 1
    if p[i : i + 1] == "^":
        i += 1
    if p[i : i + 1] == "]":
        i += 1
    while i < len(p) and depth:
        depth += (p[i] == "[") - (p[i] == "]")
        i += 2 if p[i] == "\\" else 1
    return i


def _group_end(p: str, i: int) -> int:
    """The place after the group that begins at i."""
    depth = 0
    while i < len(p):
        if p[i] == "\\":
            i += 2
        elif p[i] == "[":
            i = _class_end(p, i)
        else:
            depth += (p[i] == "(") - (p[i] == ")")
            i += 1
            if not depth:
                return i
    return i


def required_literal(pattern: str, least: int = LEAST) -> str | None:
    """The longest text of at least least characters that stands in every match, as far as a look at the top level tells.

    Groups, classes and escapes for classes of characters end a literal, and so does a repeated character. An expression
    with an alternative at the top level, inline flags or \\Q has none.
    """
    if re.search(r"\(\?[a-zA-Z]*[iux-]", pattern) or "\\Q" in pattern:
        return None
    found, run, i = [], "", 0
    while i < len(pattern):
        c, one = pattern[i], None
        if c == "|":
            return None
        if c == "\\":
            one, i = pattern[i + 1 : i + 2], i + 2
            if one.isalnum():
                if one in "xucpPk0":  # longer escapes
                    return max(found + [run], key=len) if len(max(found + [run], key=len)) >= least else None
                one = None
        elif c == "(":
            i = _group_end(pattern, i)
        elif c == "[":
            i = _class_end(pattern, i)
        else:
            one, i = None if c in ".^$" else c, i + 1
        times = pattern[i : i + 1]
        if times in ("?", "*", "+", "{") and times:
            if times == "{":
                i = pattern.find("}", i) if "}" in pattern[i:] else len(pattern)
            i += 1
            if pattern[i : i + 1] in ("?", "+"):  # reluctant or possessive
                i += 1
            found.append(run + one if one and times == "+" else run)
            run = ""
        elif one is None:
            found.append(run)
            run = ""
        else:
            run += one
    best = max([*found, run], key=len)
    return best if len(best) >= least else None


def gram_of(literals: list[str]) -> dict[str, str]:
    """For each literal its stretch of LEAST characters that the fewest of them hold."""
    cut = {x: sorted({x[i : i + LEAST] for i in range(len(x) - LEAST + 1)}) for x in set(literals)}
    many = Counter(g for gs in cut.values() for g in gs)
    return {x: min(gs, key=lambda g: (many[g], g)) for x, gs in cut.items()}
