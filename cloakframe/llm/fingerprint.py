"""Document fingerprints as invertible Bloom lookup sketches, in built-in SQL functions only.

A text is the set of the 64-bit digests of its paragraphs: its lines, where a line goes on as a new paragraph at the
first sentence end after 320 characters. A sketch of size s has three tables of s cells; a digest is in one cell
of each, and a cell holds how many digests it has, their XOR and the XOR of their checks. Only cells in use are
kept, in order. Cells of two versions subtract; then peeling takes the digest out of every cell that holds just
one, round after round, until nothing is left. If something is left, the sketches were too small for the
difference, and larger ones with other hashes are tried; sets that defeat the largest are compared digest by digest.
Cells are sorted, and each stretch of equal places is added up by itself, so that nothing grows by appending.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cloakframe.functions.columns import let

PARAGRAPH = r"[^\n]{320,}?[.!?](?=\s)|[^\n]+"


def paragraph_digests(text: Column) -> Column:
    """The sorted distinct digests of a text's paragraphs (paragraphs without a visible character do not count)."""
    parts = F.filter(F.regexp_extract_all(text, F.lit(PARAGRAPH), F.lit(0)), lambda p: F.length(F.trim(p)) > 0)
    return F.sort_array(F.array_distinct(F.transform(parts, lambda p: F.xxhash64(p))))


def _check(key: Column) -> Column:
    return F.xxhash64(key, F.lit("check"))


def _cells(key: Column, n: Column, size: Column, seed: int) -> Column:
    """The three cells of a digest, with count n (1 or -1)."""
    return F.array(
        *[
            F.struct(
                (F.pmod(F.xxhash64(key, F.lit(3 * seed + j)), size) + size * j).cast("int").alias("i"), n.cast("int").alias("n"), key.alias("k"), _check(key).alias("c")
            )
            for j in range(3)
        ]
    )


def _both(a: Column, b: Column) -> Column:
    return F.struct(a["i"].alias("i"), (a["n"] + b["n"]).alias("n"), a["k"].bitwiseXOR(b["k"]).alias("k"), a["c"].bitwiseXOR(b["c"]).alias("c"))


def _merged(cells: Column) -> Column:
    """Cells of the same place added up; those that come to nothing go."""

    def folded(cells: Column) -> Column:
        last = F.filter(F.transform(cells, lambda c, j: F.when(F.coalesce(F.get(cells, j + 1)["i"] != c["i"], F.lit(True)), j)), lambda j: j.isNotNull())
        return let(last, lambda ends: F.filter(F.transform(ends, lambda end, j: stretch(cells, F.coalesce(F.get(ends, j - 1) + 1, F.lit(0)), end)), used))

    def stretch(cells: Column, first: Column, end: Column) -> Column:
        some = F.slice(cells, first + 1, end - first)  # all but the last
        return F.when(first == end, F.get(cells, end)).otherwise(F.aggregate(some, F.get(cells, end), _both))

    used = lambda c: (c["n"] != 0) | (c["k"] != 0) | (c["c"] != 0)
    return let(F.sort_array(cells), folded)


def sketch(digests: Column, size: Column, seed: int = 0) -> Column:
    """The cells in use of a set of digests, in order."""
    return _merged(F.flatten(F.transform(digests, lambda k: _cells(k, F.lit(1), size, seed))))


def power_size(n: Column) -> Column:
    """The least power of two that is at least n and 4."""
    return F.pow(F.lit(2.0), F.ceil(F.log2(F.greatest(n.cast("double"), F.lit(4.0))))).cast("long")


def subtract(a: Column, b: Column) -> Column:
    minus = F.transform(b, lambda c: F.struct(c["i"].alias("i"), (-c["n"]).alias("n"), c["k"].alias("k"), c["c"].alias("c")))
    return _merged(F.concat(a, minus))


def peel(cells: Column, size: Column, seed: int, rounds: int = 24) -> Column:
    """struct<cells left, added array, removed array> after at most rounds rounds."""
    state = F.struct(cells.alias("cells"), F.array().cast("array<bigint>").alias("plus"), F.array().cast("array<bigint>").alias("minus"))

    def step(z: Column, _: Column) -> Column:
        pure = F.filter(z["cells"], lambda c: (F.abs(c["n"]) == 1) & (c["c"] == _check(c["k"])))
        found = F.array_distinct(F.transform(pure, lambda c: F.struct(c["k"].alias("k"), c["n"].alias("n"))))

        def taken(f: Column) -> Column:
            gone = F.flatten(F.transform(f, lambda x: _cells(x["k"], -x["n"], size, seed)))
            side = lambda s: F.transform(F.filter(f, lambda x: x["n"] == s), lambda x: x["k"])
            return F.when(F.size(f) == 0, z).otherwise(
                F.struct(_merged(F.concat(z["cells"], gone)).alias("cells"), F.concat(z["plus"], side(1)).alias("plus"), F.concat(z["minus"], side(-1)).alias("minus"))
            )

        return F.when(F.size(z["cells"]) == 0, z).otherwise(let(found, taken))

    return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), state, step)


def likely_difference(a: Column, b: Column, some: int = 32) -> Column:
    """About how many digests only one of two sorted sets has, from the least of their union (they are random numbers)."""

    def share(v: Column) -> Column:
        least = F.slice(F.array_sort(F.array_union(v["a"], v["b"])), 1, some)
        return F.size(F.array_intersect(F.array_intersect(least, v["a"]), v["b"])) / F.greatest(F.size(least), F.lit(1))

    near = let(F.struct(F.slice(a, 1, some).alias("a"), F.slice(b, 1, some).alias("b")), share)
    return let(near, lambda j: (F.size(a) + F.size(b)) * (1 - j) / (1 + j))


def difference(a: Column, b: Column, attempts: int = 5) -> Column:
    """struct<plus, minus>: the digests only a has, and only b has, recovered from sketches of growing size.

    The least digests of both sets tell how large the first sketches have to be; each retry has four times the cells. If even the
    last attempt leaves cells (which takes a cycle in sketches of over a hundred cells per digest), the sets themselves
    give the difference.
    """
    apart = likely_difference(a, b)

    def attempt(i: int, apart: Column) -> Column:
        size = power_size(apart * 0.7) * (4**i)
        done = let(size, lambda s: peel(subtract(sketch(a, s, i), sketch(b, s, i)), s, i))
        return let(done, lambda d: F.when(F.size(d["cells"]) == 0, F.struct(d["plus"].alias("plus"), d["minus"].alias("minus"))))

    exact = F.struct(F.array_except(a, b).alias("plus"), F.array_except(b, a).alias("minus"))
    return let(apart, lambda d: F.coalesce(*[attempt(i, d) for i in range(attempts)], exact))


def likeness(a: Column, b: Column) -> Column:
    """Shared by all paragraphs of two digest sets, from the recovered difference; 1 for two empty sets."""

    def share(d: Column) -> Column:
        apart = F.size(d["plus"]) + F.size(d["minus"])
        shared = (F.size(a) + F.size(b) - apart) / F.lit(2.0)
        return F.when(shared + apart == 0, F.lit(1.0)).otherwise(shared / (shared + apart))

    return F.when(a == b, F.lit(1.0)).otherwise(let(difference(a, b), share))


def fingerprint(digests: Column) -> Column:
    """A set's sketch as a string: its size, then place.count.XOR.check of each cell in use. Equal texts have equal ones."""
    size = power_size(F.size(digests) / 2)
    hexa = lambda x: F.lower(F.hex(x))
    cells = F.transform(sketch(digests, size), lambda c: F.concat_ws(".", c["i"], c["n"], hexa(c["k"]), hexa(c["c"].bitwiseAND(F.lit(0xFFFFFFFF)))))
    return F.concat(size.cast("string"), F.lit(":"), F.array_join(cells, ";"))


def with_next(docs: DataFrame, columns: list[str]) -> DataFrame:
    """docs and next_<column> of the next row by ascending doc_id (nulls last, ties by text; the first after the last).

    Rows go to ranges of doc_id that hold about as many rows each, cut at its quantiles, and find the next row
    there; the last row of a range takes the first row of the range after it. No task sees all rows.
    """
    spark = docs.sparkSession
    ranges = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))  # a few for each task, which evens out long texts
    cuts = sorted(set(docs.approxQuantile("doc_id", [i / ranges for i in range(1, ranges)], 0.2 / ranges))) if ranges > 1 else []
    steps = [2**i for i in range(max(1, len(cuts)).bit_length(), -1, -1)]
    bounds = F.array(*[F.lit(float(c)) for c in cuts]) if cuts else F.array().cast("array<double>")
    place = F.aggregate(F.lit(steps), F.lit(0), lambda z, s: F.when((z + s <= len(cuts)) & (F.get(bounds, z + s - 1) <= F.col("doc_id")), z + s).otherwise(z))
    docs = docs.withColumn("__h", F.xxhash64("text")).withColumn("__range", F.when(F.col("doc_id").isNull(), F.lit(len(cuts) + 1)).otherwise(place))
    order = ["doc_id", "__h", "text"]
    firsts = docs.groupBy("__range").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "__h")).alias("f"))
    near = Window.orderBy("__range")  # one row per range
    whole = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    firsts = firsts.select("__range", F.coalesce(F.lead("f").over(near), F.first("f").over(whole)).alias("f")).select(F.col("__range").alias("__after"), "f.doc_id", "f.__h")
    heads = docs.alias("d").join(F.broadcast(firsts).alias("f"), F.col("d.doc_id").eqNullSafe(F.col("f.doc_id")) & (F.col("d.__h") == F.col("f.__h")))
    heads = heads.select("__after", F.struct(*[F.col(f"d.{c}") for c in columns]).alias("__head")).dropDuplicates(["__after"])
    w = Window.partitionBy("__range").orderBy(F.col("doc_id").asc_nulls_last(), *order[1:])
    rows = docs.withColumn("__next", F.lead(F.struct(*columns)).over(w))
    rows = rows.join(heads, F.col("__range") == F.col("__after"), "left").withColumn("__next", F.coalesce("__next", "__head"))
    return rows.select(*[c for c in docs.columns if not c.startswith("__")], *[F.col(f"__next.{c}").alias(f"next_{c}") for c in columns])


def edited_versions(docs: DataFrame) -> DataFrame:
    """doc_id, text, edited text, next text and their digests (null texts count as empty).

    The edited text has its last floor(n/2) code points replaced by the first as many of the next document.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = with_next(docs.withColumn("digests", paragraph_digests(F.col("text"))), ["text", "digests"])
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - half), F.substring(F.col("next_text"), F.lit(1), half))
    return rows.withColumn("edited", edited).drop("next_text").withColumn("edited_digests", paragraph_digests(F.col("edited")))
