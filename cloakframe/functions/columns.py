"""Column versions of the expressions over long texts that build on other columns."""

from __future__ import annotations

import operator
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

CHUNK = 512
_POWERS = [1 << i for i in range(31)]


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body over a value that is computed once: a lambda computes what it holds again for every element."""
    return F.transform(F.array(value), lambda x: body(x))[0]


def running(sizes: Column, join: Callable[[Column, Column], Column] = operator.add) -> Column:
    """Running sums (or joins) of an array of ints by doubling: n log n steps, where appending to an array takes n * n."""
    shifts = F.slice(F.array(*map(F.lit, _POWERS)), F.lit(1), F.ceil(F.log2(F.greatest(F.size(sizes), F.lit(1)))).cast("int"))
    return F.aggregate(shifts, sizes, lambda z, by: F.transform(z, lambda x, i: F.when(i >= by, join(x, F.get(z, i - by))).otherwise(x)))


def chunks(text: Column) -> Column:
    """A text in stretches of CHUNK code points, from which piece() cuts without going through all of it."""
    return F.when(F.length(text) <= CHUNK, F.array(text)).otherwise(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0)))


def piece(parts: Column, start: Column, size: Column) -> Column:
    """size code points of a text in chunks, from start (0: the first; none before it)."""
    size = F.greatest(size, F.lit(0))
    near = F.slice(parts, (F.floor(start / CHUNK) + 1).cast("int"), (F.floor(size / CHUNK) + 2).cast("int"))
    return F.substring(F.array_join(near, ""), (start % CHUNK + 1).cast("int"), size.cast("int"))
