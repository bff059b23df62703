"""Masking of tables: column templates filled from the same row, other text cells as lines."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cloakframe.functions.text import blank
from cloakframe.operators.instructions import REPORT, decided
from cloakframe.operators.matching import Guard
from cloakframe.plans.masking import Result, run


@dataclass
class TableConfig:
    """columns: filled by their template; dictionary: columns whose unmasked cells are dictionary candidates."""

    filename: str
    columns: dict[str, str] = field(default_factory=dict)
    dictionary: dict[str, str] = field(default_factory=dict)

    @property
    def word(self) -> str:
        """The text under which an instruction decides about the whole file."""
        return f"csv:{self.filename}:{','.join(self.columns)}".lower()


def template_parts(template: str) -> list[tuple[str, str | None]]:
    """(text, None) or ("", column) pieces of a row template: {column}, with ${ for a plain {."""
    out: list[tuple[str, str | None]] = []
    for m in re.finditer(r"\$(\{[^{}]*\}?)|\{([^{}]+)\}|([^{$]+|.)", template, re.S):
        out.append(("", m[2].split(":-")[0]) if m[2] else (m[1] or m[3], None))
    return out


def filled(template: str, header: list[str]) -> Column:
    """A template with {column} replaced by the row's cell; an unknown column leaves a mark."""
    cell = lambda p: F.coalesce(F.col(f"`{p}`").cast("string"), F.lit("")) if p in header else F.lit(f"_UNRESOLVED_{p}_")
    return F.concat(F.lit(""), *[F.lit(text) if name is None else cell(name) for text, name in template_parts(template)])


def missing_columns(config: TableConfig, header: list[str]) -> list[str]:
    """Errors of a configuration against a header."""
    lost = [c for c in [*config.columns, *config.dictionary] if c not in header]
    names = [n for t in config.columns.values() for _, n in template_parts(t) if n and n not in header]
    return [f"Missing CSV columns: {lost}"] * bool(lost) + [f"Missing CSV columns: {n}" for n in names]


def joined_context(matches: DataFrame, files: DataFrame) -> DataFrame:
    """files and the context of each: those of its first two kept matches and how many others there are."""
    kept = matches.where("kept")
    first = kept.withColumn("n", F.row_number().over(Window.partitionBy("file").orderBy("line_num", "part", "start"))).where("n <= 2")
    two = first.groupBy("file").agg(F.array_sort(F.collect_list(F.struct("n", "context"))).alias("two"))
    per = files.join(kept.groupBy("file").agg(F.count(F.lit(1)).alias("all")), "file", "left").join(two, "file", "left")
    text = F.array_join(F.transform("two", lambda x: x["context"]), ", ")
    context = F.when(F.col("two").isNull(), "No guarded words found").when(F.col("all") <= 2, text).otherwise(F.concat(text, F.lit(" and "), (F.col("all") - 2).cast("string"), F.lit(" others")))
    return per.select(*files.columns, context.alias("context"))


def file_decisions(matches: DataFrame, files: DataFrame, instructions: DataFrame, least: int = 1) -> DataFrame:
    """files (file, word_lc, put) with the context of their template cells and the instruction for the whole file."""
    per = joined_context(matches, files)
    zero = {c: F.lit(0) for c in ("line_num", "part", "start", "src")}
    return decided(per.withColumns(zero).withColumn("end", F.length("word_lc")), instructions, least)


def file_report(decisions: DataFrame) -> DataFrame:
    return decisions.select(
        F.col("i_allow").alias("Allow"), F.col("word_lc").alias("Text"), F.col("context").alias("Context"), F.col("file").alias("File"), F.lit(0).alias("Line"),
        F.col("put").alias("Replacement"), F.lit("CSV Column Template").alias("Comment"),
    )


def _cells(rows: DataFrame, key: str, config: TableConfig, names: list[str]) -> DataFrame:
    """Text cells as lines: part is the place of the column in names."""
    every = F.array(*[F.struct(F.lit(c).alias("c"), F.col(f"`{c}`").cast("string").alias("v")) for c in names]) if names else F.array().cast("array<struct<c:string,v:string>>")
    cells = rows.select(F.col(f"`{key}`").cast("long").alias("line_num"), F.posexplode(every).alias("part", "x")).where("x.v is not null and x.v <> ''")
    return cells.select(F.lit(config.filename).alias("file"), "line_num", "part", F.concat("x.c", F.lit(":")).alias("prefix"), F.col("x.v").alias("line"))


def mask_table(rows: DataFrame, key: str, config: TableConfig, guard: Guard, instructions: DataFrame | None = None, restore: bool = False) -> tuple[DataFrame, Result]:
    """The masked table and the run over its text cells (file <filename>, line_num the key, contexts <column>:<context>).

    Template columns are filled unless an instruction allows the file or the direction is restore; all other text
    columns go through the line pipeline. key has to be an integer column that tells rows apart.
    """
    instructions = instructions if instructions is not None else rows.sparkSession.createDataFrame([], REPORT)
    texts = [c for c, t in rows.dtypes if t == "string" and c != key and (restore or c not in config.columns)]
    result = run(_cells(rows, key, config, texts), guard, instructions, restore)
    per = result.changed.groupBy("line_num").agg(F.map_from_entries(F.collect_list(F.struct("part", "masked"))).alias("__m"))
    out = rows.join(per.withColumnRenamed("line_num", "__k"), F.col(f"`{key}`").cast("long") == F.col("__k"), "left")
    own = [c for c in rows.columns if c in config.columns]
    fill = {}
    if own and not restore:
        scanned = run(_cells(rows, key, config, own), guard, instructions)
        file = rows.sparkSession.createDataFrame([(config.filename, config.word, ",".join(config.columns.values()))], "file string, word_lc string, put string")
        told = file_decisions(scanned.matches, file, instructions)
        result.report = result.report.unionByName(file_report(told))
        out = out.crossJoin(F.broadcast(told.select(F.coalesce("i_allow", F.lit(False)).alias("__free"))))  # one row
        fill = {c: F.when(F.col("__free"), F.col(f"`{c}`")).otherwise(filled(config.columns[c], rows.columns)) for c in own}
    select = [fill[c].alias(c) if c in fill else F.coalesce(F.try_element_at("__m", F.lit(texts.index(c))), F.col(f"`{c}`")).alias(c) if c in texts else F.col(f"`{c}`") for c in rows.columns]
    return out.select(*select), result


def dictionary_candidates(rows: DataFrame, config: TableConfig, file_allowed: bool, restorable: DataFrame, masked: DataFrame | None = None) -> DataFrame:
    """Text, Replacement (empty), Scope and Comment of cells that a dictionary could take in.

    Template columns count if the file is allowed and the cell differs from its template; dictionary columns count
    where masking left the cell alone (masked: the table as mask_table gives it, with the same key columns, or null
    for a table that nothing masks). restorable: word_lc values.
    """
    parts = []
    if file_allowed:
        parts += [rows.select(F.col(f"`{c}`").cast("string").alias("t"), F.lit("template").alias("Scope"), (F.col(f"`{c}`").cast("string") != filled(t, rows.columns)).alias("ok")) for c, t in config.columns.items() if c in rows.columns]
    for c in config.dictionary:
        if c in rows.columns:
            cells = rows.select(F.col(f"`{c}`").cast("string").alias("t"))
            if masked is not None:  # a cell's masking depends on its text alone, but for instructions
                left = masked.select(F.col(f"`{c}`").cast("string").alias("t")).distinct()
                cells = cells.join(left, "t", "left_semi")
            parts.append(cells.select("t", F.lit("dictionary").alias("Scope"), F.lit(True).alias("ok")))
    every = parts[0]
    for p in parts[1:]:
        every = every.unionAll(p)
    every = every.where("ok").select(F.lower(F.trim("t")).alias("Text"), "Scope").where(~blank(F.col("Text"))).groupBy("Text").agg(F.min("Scope").alias("Scope"))
    return candidate_rows(every, restorable)


def candidate_rows(found: DataFrame, restorable: DataFrame) -> DataFrame:
    """Candidates (Text, Scope) with the comments that sort out those of no use, in report order."""
    known = restorable.select(F.col("word_lc").alias("Text"), F.lit(True).alias("r")).distinct()
    comment = F.when(F.col("r"), "Ignore: restorable").when(F.length("Text") < 3, "Ignore: too short")
    out = found.join(known, "Text", "left").select("Text", F.lit("").alias("Replacement"), "Scope", comment.alias("Comment"))
    return out.orderBy(F.col("Comment").isNull(), F.length("Text") >= 3, "Scope", "Text")
