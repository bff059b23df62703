"""Masking and restoring lines of text: one dataflow in two directions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cloakframe.functions.text import blank, chunks, context, filled_hash, let, piece, running, word_hash
from cloakframe.operators.instructions import REPORT, decided, simple_replacements, skipped_rows
from cloakframe.operators.matching import KEY, Guard, exploded, found_lines, keyed, template_rank, value_frames
from cloakframe.runtime import discard, written


@dataclass
class Result:
    """lines: file, line_num, part, line, masked, changed; changed: those that changed. The rest: what a run reports.

    close() deletes the written tables that the frames read, once nothing reads them any more.
    """

    lines: DataFrame
    changed: DataFrame
    report: DataFrame
    generated: DataFrame
    restore: DataFrame
    matches: DataFrame
    tables: tuple[DataFrame, ...] = ()

    def close(self) -> None:
        discard(*self.tables)


def with_instructed(words: DataFrame, instructions: DataFrame) -> DataFrame:
    """Guard values and the texts of instructions with a replacement: their only one is the template, else blank."""
    more = simple_replacements(instructions).select("word_lc", F.when(F.size("values") == 1, F.col("values")[0]).otherwise("").alias("other"))
    return words.join(more, "word_lc", "full_outer").select("word_lc", F.coalesce("template", "other").alias("template"))


def hash_replacement(template: Column, word_lc: Column, default: str) -> Column:
    return filled_hash(F.when(blank(template), F.lit(default)).otherwise(template), word_hash(word_lc).cast("string"))


def generated_values(matches: DataFrame, default: str) -> DataFrame:
    """word, its one replacement (by the template of its match of highest priority) and made: it differs from the template."""
    order = F.struct(F.col("start") - F.col("end"), template_rank(F.col("template")), "file", "line_num", "part", "start", "src")
    one = matches.groupBy("word_lc").agg(F.min_by("template", order).alias("template"))
    one = one.select(F.col("word_lc").alias("word"), hash_replacement(F.col("template"), F.col("word_lc"), default).alias("replacement"), "template")
    return one.select("word", "replacement", (F.col("replacement") != F.coalesce("template", F.lit(""))).alias("made"))


def restored_values(matches: DataFrame, instructions: DataFrame) -> DataFrame:
    """word and its only original, or a mark that there is none or are several."""
    known = simple_replacements(instructions)
    rows = matches.select("word_lc").distinct().join(known, "word_lc", "left")
    value = (
        F.when(F.col("values").isNull(), F.concat(F.lit("<<NO_RESTORE:"), "word_lc", F.lit(">>")))
        .when(F.size("values") == 1, F.col("values")[0])
        .otherwise(F.concat(F.lit("<<AMBIGUOUS:"), "word_lc", F.lit(":"), F.array_join("values", "|"), F.lit(">>")))
    )
    return rows.select(F.col("word_lc").alias("word"), value.alias("replacement"))


def resolve(matches: DataFrame) -> DataFrame:
    """One row per line with its matches by place as an array ms, each with kept: not allowed, and no stronger one overlaps.

    Stronger is longer, then a literal template before one with variables before none, then the earlier start and
    source. A match that is itself overruled still overrules; allowed ones neither overrule nor are replaced. In a line
    with many matches each looks only at those between the first that reaches it and the last that it reaches.
    """
    allowed = F.coalesce("i_allow", F.lit(False))
    rank = F.struct(F.col("start") - F.col("end"), template_rank(F.col("template")), F.col("start"), F.col("src"), F.col("reason"))
    m = F.struct("start", "end", "src", rank.alias("rank"), allowed.alias("free"), "word", "word_lc", "reason", "context", "i_allow", "i_comment", "instructed", "value")
    per = matches.groupBy(*KEY).agg(F.sort_array(F.collect_list(m)).alias("ms"))
    powers = f"slice(array({', '.join(str(1 << i) for i in reversed(range(31)))}), -1 - cast(floor(log2(greatest(size(ms), 1))) as int), 1 + cast(floor(log2(greatest(size(ms), 1))) as int))"

    def before(values: str, fits: str) -> str:
        """How many of the ascending values fit (they come first)."""
        return f"aggregate({powers}, 0, (z, s) -> if(z + s <= size(ms) and get({values}, z + s - 1) {fits}, z + s, z))"

    stronger = lambda x: f"(not {x}.free and {x}.rank < a.rank and {x}.start < a.`end` and a.start < {x}.`end`)"
    kept = lambda found: f"named_struct('a', a, 'kept', not a.free and not {found})"
    some = f"exists(sequence(w.low, w.high - 1), j -> transform(array(get(ms, j)), x -> {stronger('x')})[0])"  # slice() goes through the whole array each time
    bounds = f"named_struct('low', {before('v.reach', '<= a.start')}, 'high', {before('v.starts', '< a.`end`')})"
    near = f"transform(ms, a -> transform(array({bounds}), w -> {kept(some)})[0])"
    reach = let("transform(ms, x -> x.`end`)", lambda e: running(e, "greatest({}, {})"))
    many = f"transform(array(named_struct('reach', {reach}, 'starts', transform(ms, x -> x.start))), v -> {near})[0]"
    few = f"transform(ms, a -> {kept(f'exists(ms, x -> {stronger("x")})')})"
    return per.withColumn("ms", F.expr(f"if(size(ms) <= 32, {few}, {many})"))


def rewrite(resolved: DataFrame, lines: DataFrame, keep: int = 15) -> DataFrame:
    """lines with their matches (ms), the masked line, and back: each replacement in it with its context, in order of place."""
    rows = resolved.join(lines.select(*KEY, "prefix", "line"), KEY).withColumn("kept", F.expr("transform(filter(ms, x -> x.kept), x -> x.a)"))

    def spliced(v: str) -> str:
        done = "coalesce(get(kept, {}).`end`, 0)"
        out = f"transform(kept, (k, i) -> concat({piece(v, done.format('i - 1'), f'k.start - {done.format("i - 1")}')}, k.value))"
        last = done.format("size(kept) - 1")
        return f"concat(array_join({out}, ''), {piece(v, last, f'length(line) - {last}')})"

    rows = rows.withColumn("masked", F.expr(let(chunks("line"), spliced)))
    grown = let("transform(kept, k -> length(k.value) - (k.`end` - k.start))", running)
    seen = context("v.parts", "v.n", "p.s", "p.e", keep)
    place = "named_struct('s', k.start + coalesce(get(v.grown, i - 1), 0), 'e', k.start + coalesce(get(v.grown, i - 1), 0) + length(k.value))"
    one = f"transform(array({place}), p -> named_struct('text', lower(k.value), 'context', concat(prefix, {seen}), 'word', k.word, 'reason', k.reason))[0]"
    back = f"transform(array(named_struct('parts', {chunks('masked')}, 'n', length(masked), 'grown', {grown})), v -> transform(kept, (k, i) -> {one}))[0]"
    return rows.withColumn("back", F.expr(back)).drop("kept")


def run(rows: DataFrame, guard: Guard, instructions: DataFrame | None = None, restore: bool = False, keep: int = 15, least: int = 1) -> Result:
    """Mask (or restore) lines (file, line_num, line; part and prefix for cells of tables).

    Lines are matched once: those with matches and what becomes of them are written tables, which all frames of the
    result read. Only ``lines`` goes through all the rows again.
    """
    spark = rows.sparkSession
    rows = keyed(rows)
    instructions = instructions if instructions is not None else spark.createDataFrame([], REPORT)
    live, skipped = skipped_rows(rows, instructions)
    seen = written(found_lines(live, guard, with_instructed(value_frames(spark, guard), instructions), keep), "matches")
    found = decided(exploded(seen), instructions, least).withColumn("instructed", F.coalesce(~blank(F.col("i_replacement")), F.lit(False)))
    plain = found.where("not instructed")
    values = restored_values(plain, instructions) if restore else generated_values(plain, guard.default_template)
    matched = found.join(values.select(F.col("word").alias("word_lc"), "replacement"), "word_lc", "left").withColumn("value", F.when(F.col("instructed"), F.col("i_replacement")).otherwise(F.col("replacement")))
    done = written(rewrite(resolve(matched), seen, keep), "masked")
    every = done.select(*KEY, F.explode("ms").alias("x")).select(*KEY, "x.a.*", "x.kept")
    free = F.col("free")
    comment = (
        F.when(free, F.concat(F.lit("Allowed: "), "reason", F.lit(", Suggested: "), "value"))
        .when(F.col("instructed"), F.concat(F.lit("Instruction "), F.coalesce("i_comment", F.lit(""))))
        .otherwise(F.concat(F.lit("Generated for "), "reason"))
    )
    report = every.where("free or kept").select(
        F.col("i_allow").alias("Allow"), F.col("word_lc").alias("Text"), F.col("context").alias("Context"), F.col("file").alias("File"),
        F.col("line_num").alias("Line"), F.when(~free, F.col("value")).alias("Replacement"), comment.alias("Comment"),
    ).unionByName(skipped)
    restored = done.select(*KEY, F.explode("back").alias("b")).select(
        F.lit(None).cast("boolean").alias("Allow"), F.col("b.text").alias("Text"), F.col("b.context").alias("Context"), F.col("file").alias("File"),
        F.col("line_num").alias("Line"), F.col("b.word").alias("Replacement"), F.concat(F.lit("Restore "), "b.reason").alias("Comment"),
    )
    changed = done.where("masked <> line").select(*KEY, "line", "masked")
    out = rows.join(changed.drop("line"), KEY, "left").select(*KEY, "line", F.coalesce("masked", "line").alias("masked"), F.col("masked").isNotNull().alias("changed"))
    generated = values if restore else values.where("made").select("word", "replacement")
    return Result(out, changed, report, generated, restored, every, (seen, done))


def sort_report(report: DataFrame) -> DataFrame:
    return report.orderBy(F.asc_nulls_first("Allow"), *[F.asc_nulls_last(c) for c in ("Text", "Context", "File", "Line")])


def cumulative(last: DataFrame, previous: DataFrame) -> DataFrame:
    """Restore rows of this run and of those before, one per text, context, file, line and replacement."""
    columns = ["Allow", "Text", "Context", "File", "Line", "Replacement", "Comment"]
    both = last.select(*columns, F.lit(0).alias("run")).unionByName(previous.select(*columns, F.lit(1).alias("run")))
    order = F.struct(F.coalesce(F.col("Allow").cast("int"), F.lit(2)), -F.length("Comment"), F.col("run"), F.col("Comment"))
    key = ["Text", "Context", "File", "Line", "Replacement"]
    best = both.groupBy(*key).agg(F.min_by(F.struct("Allow", "Comment"), order).alias("b"))
    return best.select(F.col("b.Allow").alias("Allow"), *key, F.col("b.Comment").alias("Comment"))


def files(result: Result) -> DataFrame:
    """file, original and masked text (joined by line ends) and changed."""
    one = result.lines.groupBy("file").agg(F.array_sort(F.collect_list(F.struct("line_num", "line", "masked"))).alias("l"))
    text = lambda c: F.array_join(F.transform("l", lambda x: x[c]), "\n")
    return one.select("file", text("line").alias("original"), text("masked").alias("masked")).withColumn("changed", F.col("original") != F.col("masked"))


def stats(result: Result) -> DataFrame:
    """Counters by name, as one aggregate over each of the run's frames."""
    n = F.count(F.lit(1))
    counted = lambda df, *named: [df.agg(*[c.cast("long").alias(k) for k, c in named])]
    r = result.report
    parts = (
        counted(result.lines, ("Read Lines", n), ("Read Bytes", F.coalesce(F.sum(F.length("line")), F.lit(0))), ("Read Files", F.count_distinct("file")), ("Changed Files", F.count_distinct(F.when(F.col("changed"), F.col("file")))))
        + counted(result.matches, ("Words Matched", n), ("Words Replaced", F.count_if("kept")), ("Words Conflicts", F.count_if(~F.col("free") & ~F.col("kept"))))
        + counted(r, ("Report Lines - All", n), ("Report Lines - Allow", F.count_if("Allow")), ("Report Lines - Disallow", F.count_if(~F.col("Allow"))), ("Report Lines - To Review", F.count_if(F.col("Allow").isNull())))
        + counted(result.generated, ("Words Replacements Generated", n))
    )
    out = None
    for p in parts:
        rows = p.unpivot([], p.columns, "name", "value")
        out = rows if out is None else out.unionAll(rows)
    return out.orderBy("name")
