"""Expressions over lines of text: pieces with places, context windows, hashes, path patterns.

The larger ones are SQL text (str in, str out): one expression that Spark parses at once is put together a hundred times
faster than a tree of columns that is built node by node.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"[\p{IsAlphabetic}\p{IsDigit}]"
GAP = r"[^\p{IsAlphabetic}\p{IsDigit}]"
EOL = "\r\n|\n|\r"

CHUNK = 512
_POWERS = ", ".join(str(1 << i) for i in range(31))
_names = itertools.count()


def quoted(text: str) -> str:
    """A text as a literal of Spark SQL."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def fresh() -> str:
    """A name for a lambda's variable that no other lambda has."""
    return f"x{next(_names)}"


def let(value: str, body: Callable[[str], str]) -> str:
    """body over a value that is computed once: a lambda computes what it holds again for every element."""
    x = fresh()
    return f"transform(array({value}), {x} -> {body(x)})[0]"


def running(sizes: str, join: str = "{} + {}") -> str:
    """Running sums (or joins) of an array of ints (a name) by doubling: n log n steps, where appending to an array takes n * n."""
    z, by, x, i = (fresh() for _ in range(4))
    both = join.format(x, f"get({z}, {i} - {by})")
    shifts = f"slice(array({_POWERS}), 1, cast(ceil(log2(greatest(size({sizes}), 1))) as int))"
    return f"aggregate({shifts}, {sizes}, ({z}, {by}) -> transform({z}, ({x}, {i}) -> if({i} >= {by}, {both}, {x})))"


def spans(text: str, pattern: str) -> str:
    """array<struct<start, end, word>> of the matches of a pattern (SQL text); places count code points from 0."""

    def placed(v: str) -> str:
        sizes = f"transform({v}.g, (g, i) -> length(g) + coalesce(length(get({v}.h, i)), 0))"
        return let(let(sizes, running), lambda e: f"transform({v}.h, (h, i) -> named_struct('start', get({e}, i) - length(h), 'end', get({e}, i), 'word', h))")

    parts = f"named_struct('h', regexp_extract_all({text}, {pattern}, 0), 'g', split({text}, {pattern}, -1))"
    return f"if({text} rlike {pattern}, {let(parts, placed)}, cast(array() as array<struct<start:int,end:int,word:string>>))"


def chunks(text: str) -> str:
    """A text in stretches of CHUNK code points, from which piece() cuts without going through all of it."""
    return f"if(length({text}) <= {CHUNK}, array({text}), regexp_extract_all({text}, '(?s).{{1,{CHUNK}}}', 0))"


def piece(parts: str, start: str, size: str) -> str:
    """size code points of a text in chunks, from start (0: the first; none before it)."""

    def cut(v: str) -> str:
        near = f"slice({parts}, cast({v}.s div {CHUNK} as int) + 1, cast({v}.n div {CHUNK} as int) + 2)"
        return f"substring(array_join({near}, ''), {v}.s % {CHUNK} + 1, {v}.n)"

    return let(f"named_struct('s', cast({start} as int), 'n', greatest(cast({size} as int), 0))", cut)


def whole_word(parts: str, start: str, end: str) -> str:
    """Neither neighbour of the span (of a text in chunks) is a letter or digit."""
    alone = quoted(WORD)
    return f"(not if({start} > 0, {piece(parts, f'greatest({start} - 1, 0)', '1')}, '') rlike {alone} and not {piece(parts, end, '1')} rlike {alone})"


def context(parts: str, n: str, start: str, end: str, keep: int = 15) -> str:
    """The span of a text (in chunks, of n code points) with up to keep characters on each side.

    `..` marks a cut, and no cut saves fewer than two.
    """
    low = f"if({start} - {keep} < 0 or ({start} > {keep} and {start} - {keep} - 2 < 0), 0, {start} - {keep})"
    high = f"if({end} + {keep} > {n} or ({end} + {keep} < {n} and {end} + {keep} + 2 > {n}), {n}, {end} + {keep})"

    def trimmed(v: str) -> str:
        left = f"{v}.a + length(regexp_extract({piece(parts, f'{v}.a', f'{start} - 1 - {v}.a')}, {quoted(_BLANKS_FIRST)}, 0))"
        right = f"{v}.b - length(regexp_extract({piece(parts, f'{end} + 1', f'{v}.b - {end} - 1')}, {quoted(_BLANKS_LAST)}, 0))"
        return let(f"named_struct('a', {left}, 'b', {right})", lambda x: f"concat(if({x}.a > 0, '..', ''), {piece(parts, f'{x}.a', f'{x}.b - {x}.a')}, if({x}.b < {n}, '..', ''))")

    return let(f"named_struct('a', {low}, 'b', {high})", trimmed)


_BLANKS_FIRST, _BLANKS_LAST = r"^[\x00-\x20]*", r"[\x00-\x20]*\z"


def word_hash(word: Column) -> Column:
    """The number of a lower-case word: Java's string hash of it, doubled until 20 characters long; 0 if empty."""
    n = F.length(word)
    doubled = F.repeat(word, F.when(n >= 20, 1).otherwise(F.pow(F.lit(2.0), F.ceil(F.log2(F.lit(20.0) / F.greatest(n, F.lit(1)))))).cast("int"))
    code = F.call_function("java_method", F.lit("java.util.Objects"), F.lit("hashCode"), doubled).cast("bigint")
    return F.when(n == 0, F.lit(0).cast("bigint")).otherwise(F.abs(code))


def filled_hash(template: Column, number: Column) -> Column:
    """A template with {hash} put in; {name:-default} of any other name gives its default, ${ stands for a plain {."""
    out = F.regexp_replace(template, r"\$\{", "\u0001")
    out = F.regexp_replace(out, F.lit(r"\{hash(?::-[^{}]*)?\}"), number)
    return F.replace(F.regexp_replace(out, r"\{[^{}]*?:-([^{}]*)\}", "$1"), F.lit("\u0001"), F.lit("{"))


def blank(c: Column) -> Column:
    return F.trim(F.coalesce(c, F.lit(""))) == ""


# A path pattern (? one character, * within a folder, ** as a whole folder name: any folders) as a regular expression, step
# by step; every step is the same in Python and in Spark.
_HEAD, _TAIL, _ALL = "\u0001", "\u0002", "\u0003"
PATH_STEPS = [
    (r"\?", "[^/]"), (rf"(?:(?<=/)|^)\*\*/", _HEAD), (rf"(?:(?<={_HEAD})|^)\*\*$", _ALL), (r"/\*\*$", _TAIL), (r"\*+", "[^/]*"),
    (_HEAD, "(?:[^/]+/)*"), (_TAIL, "(?:/[^/]+)*"), (_ALL, ".*"),
]
_SPECIAL = r"([.+^$()\[\]{}|])"


def path_regex(pattern: str) -> str:
    out = re.sub(_SPECIAL, r"\\\1", pattern.replace("\\", "/"))
    for find, put in PATH_STEPS:
        out = re.sub(find, lambda _, put=put: put, out)
    return f"^{out}$"


def path_regex_column(pattern: Column) -> Column:
    out = F.regexp_replace(F.replace(pattern, F.lit("\\"), F.lit("/")), _SPECIAL, r"\\$1")
    for find, put in PATH_STEPS:
        out = F.regexp_replace(out, find, put)
    return F.concat(F.lit("^"), out, F.lit("$"))


def path_guarded(path: Column, guard: list[str], ignore: list[str]) -> Column:
    """Some guard pattern and no ignore pattern fits; a name that ends with / meets only such patterns, case aside."""
    p = F.lower(F.replace(path, F.lit("\\"), F.lit("/")))

    def some(patterns: list[str], folder: bool) -> Column:
        fit = [path_regex(x.lower()) for x in patterns if x.replace("\\", "/").endswith("/") == folder]
        return p.rlike("|".join(f"(?:{x})" for x in fit)) if fit else F.lit(False)

    return F.when(p.endswith("/"), some(guard, True) & ~some(ignore, True)).otherwise(some(guard, False) & ~some(ignore, False))
