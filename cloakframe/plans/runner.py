"""A whole run: a folder of texts, CSV files and archives is masked or restored, with all its reports.

mask_files() is the dataflow over files as rows; run_folder() reads a folder by a settings file, and writes the changed
files and the reports (folders of CSV part files in report order, which read_instructions() takes again).
"""

from __future__ import annotations

import warnings
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cloakframe.functions.text import EOL
from cloakframe.operators.instructions import REPORT, read_instructions, skipped_rows
from cloakframe.operators.matching import Guard, find, lines, value_frames
from cloakframe.plans import masking
from cloakframe.plans.tables import TableConfig, candidate_rows, file_decisions, file_report, template_parts
from cloakframe.runtime import discard, written
from cloakframe.sources.dictionaries import guard_of, read_settings, word_set
from cloakframe.sources.files import base_name, csv_cells, csv_config, csv_text, decoded, is_csv, is_empty, quote_all, read_files, write_files


@dataclass
class Csv:
    """How CSV files are read, and which of them (by base name, the first that fits) have which columns."""

    configs: list[TableConfig] = field(default_factory=list)
    delimiter: str = ","
    quote: str = '"'
    comment: str | None = None


@dataclass
class FolderRun:
    """changed: path, zip_path, file, text of changed files; restore: rows of this run, cumulative: also of earlier ones."""

    changed: DataFrame
    report: DataFrame
    restore: DataFrame
    cumulative: DataFrame
    generated: DataFrame
    errors: DataFrame
    candidates: DataFrame | None
    stats: DataFrame


def name_errors(files: DataFrame, guard: Guard, words: DataFrame | None = None) -> DataFrame:
    """An error for each guarded word in the base name of a file or of a folder above it, allowed or not."""
    ends = F.transform(F.regexp_extract_all("file", F.lit(r"[^/:\\]+"), F.lit(0)), lambda x, i: i)
    upto = F.transform(ends, lambda i: F.call_function("regexp_extract", F.col("file"), F.concat(F.lit(r"^[/:\\]*(?:[^/:\\]+[/:\\]+){"), i.cast("string"), F.lit(r"}[^/:\\]+")), F.lit(0)))
    names = files.select(F.explode(upto).alias("file")).distinct().select("file", F.lit(0).alias("line_num"), base_name().alias("line"))
    return find(names, guard, words).select(F.col("file").alias("File"), F.concat(F.lit("Guarded word: "), "reason").alias("Message")).distinct()


def _config(configs: list[TableConfig], value: Callable[[TableConfig], Column]) -> Column:
    """value of each file's CSV configuration, by the column cfg."""
    return F.coalesce(*[F.when(F.col("cfg") == i, value(c)) for i, c in enumerate(configs)])


def mask_files(
    files: DataFrame, guard: Guard, instructions: DataFrame | None = None, restore: bool = False, csv: Csv | None = None, previous: DataFrame | None = None,
    restorable: Guard | None = None, keep: int = 15, least: int = 1,
) -> FolderRun:
    """Mask (or restore) files: path, zip_path, file (reported path, unique), text (null: it could not be read) and error.

    previous: restore rows of earlier runs, for nothing else than the cumulative ones. restorable: the guard of the
    other direction, whose words are no dictionary candidates. An empty table gives empty results.
    """
    spark = files.sparkSession
    csv = csv or Csv()
    instructions = instructions if instructions is not None else spark.createDataFrame([], REPORT)
    live, skipped = skipped_rows(files, instructions)
    words = masking.with_instructed(value_frames(spark, guard), instructions)
    errors = name_errors(live, guard, words).unionAll(live.where("error is not null").select(F.col("file").alias("File"), F.col("error").alias("Message")))
    failed = live.where("text is null").select(
        F.lit(None).cast("boolean").alias("Allow"), F.lit("").alias("Text"), F.lit("").alias("Context"), F.col("file").alias("File"), F.lit(0).alias("Line"),
        F.lit("").alias("Replacement"), F.concat(F.lit("FAILED to process file "), "file").alias("Comment"),
    )
    told = live.where("text is not null").withColumn("cfg", csv_config([c.filename for c in csv.configs]))
    texts = lines(told.where("cfg is null"), "file", "text").select("file", "line_num", F.lit(0).alias("part"), F.lit("").alias("prefix"), "line")
    rows, report, candidates, cells, allowed = texts, failed.unionByName(skipped), None, None, None
    if csv.configs:
        of = told.where("cfg is not null")
        parsed = csv_cells(of, csv.delimiter, csv.quote, csv.comment).join(of.select("file", "cfg"), "file")
        parsed = written(parsed, "cells")
        heads = parsed.where("record_no = 0").groupBy("file", "cfg").agg(F.collect_set("col_name").alias("header"))
        templates = {} if restore else {(i, c): t for i, x in enumerate(csv.configs) for c, t in x.columns.items()}
        named = F.array(*[F.lit(f"{i}:{c}") for i, c in templates], F.lit("")) if templates else F.array(F.lit(""))
        at = F.concat(F.col("cfg").cast("string"), F.lit(":"), F.coalesce("col_name", F.lit("")))
        body = parsed.where("record_no > 0").withColumn("filled", F.array_contains(named, at))
        as_lines = body.select("file", F.col("record_no").alias("line_num"), F.col("col_idx").alias("part"), F.when(F.col("col_name").isNull(), "").otherwise(F.concat("col_name", F.lit(":"))).alias("prefix"), F.col("cell").alias("line"), "filled")
        scanned = masking.run(as_lines.where("filled").drop("filled"), guard, instructions, restore, keep, least)
        value = lambda f: _config(csv.configs, lambda c: F.lit(f(c)))
        per = heads.select("file", value(lambda c: c.word).alias("word_lc"), value(lambda c: ",".join(c.columns.values())).alias("put"))
        allowed = written(file_decisions(scanned.matches, per, instructions, least), "csv-files")
        report = report.unionByName(file_report(allowed))
        rows = texts.unionByName(as_lines.where("not filled").drop("filled"))
        errors = errors.unionAll(_column_errors(heads, csv.configs, restore))

    result = masking.run(rows, guard, instructions, restore, keep, least)
    report = result.report.unionByName(report)
    changed_files = result.changed.select("file").distinct()
    again = lines(told.where("cfg is null").join(changed_files, "file", "left_semi"), "file", "text").join(result.changed.where("part = 0").select("file", "line_num", "masked"), ["file", "line_num"], "left")
    out = again.groupBy("file").agg(F.array_sort(F.collect_list(F.struct("line_num", F.coalesce("masked", "line").alias("line")))).alias("l"))
    out = out.select("file", F.array_join(F.transform("l", lambda x: x["line"]), "\n").alias("text"))
    if csv.configs:
        cells, candidates = _csv_cells(parsed, body, allowed, result, csv.configs, restore)
        other = cells.where("masked <> cell").select("file").distinct()
        quoted = told.join(other, "file", "left_semi").select("file", quote_all(F.col("text"), csv.comment, csv.quote).alias("all"))
        out = out.unionByName(csv_text(cells.join(other, "file", "left_semi").select("file", "record_no", "col_idx", F.col("masked").alias("cell")), quoted, csv.delimiter, csv.quote))
        if restore:
            candidates = None
        else:
            known = find(candidates.select(F.col("Text").alias("file"), F.lit(0).alias("line_num"), F.col("Text").alias("line")), restorable or Guard()).select(F.col("file").alias("word_lc"))
            candidates = candidate_rows(candidates, known)
    changed = out.join(told.select("path", "zip_path", "file"), "file").select("path", "zip_path", "file", "text")
    none = spark.createDataFrame([], REPORT)
    made = none if restore else result.restore
    last, every = masking.cumulative(made, none), masking.cumulative(made, none if previous is None or restore else previous)
    generated = result.generated.limit(0) if restore else result.generated
    run = FolderRun(changed, report, last, every, generated, errors.distinct(), candidates, None)
    run.stats = _stats(run, result, files, live, told, skipped)
    return run


def _column_errors(heads: DataFrame, configs: list[TableConfig], restore: bool) -> DataFrame:
    """Configured columns, and columns that templates name, which a file's header lacks."""
    listed = lambda names: F.array(*[F.lit(n) for n in names]) if names else F.array().cast("array<string>")
    groups = [lambda c: [*c.dictionary]] + ([] if restore else [lambda c: [*c.columns]])
    out = None
    for g in groups:
        lost = F.array_except(_config(configs, lambda c, g=g: listed(g(c))), F.col("header"))
        part = heads.select("file", lost.alias("lost")).where(F.size("lost") > 0).select(F.col("file").alias("File"), F.concat(F.lit("Missing CSV columns: ["), F.array_join("lost", ", "), F.lit("]")).alias("Message"))
        out = part if out is None else out.unionAll(part)
    if not restore:  # only a template whose own column is there gets filled
        pairs = _config(configs, lambda c: F.array(*[F.struct(F.lit(k).alias("k"), F.lit(n).alias("n")) for k, t in c.columns.items() for _, n in template_parts(t) if n], F.struct(F.lit("").alias("k"), F.lit("").alias("n"))))
        named = heads.select("file", "header", F.explode(pairs).alias("p")).where("p.n <> '' and array_contains(header, p.k) and not array_contains(header, p.n)")
        out = out.unionAll(named.select(F.col("file").alias("File"), F.concat(F.lit("Missing CSV columns: "), "p.n").alias("Message")))
    return out


def _csv_cells(parsed: DataFrame, body: DataFrame, allowed: DataFrame, result: masking.Result, configs: list[TableConfig], restore: bool) -> tuple[DataFrame, DataFrame]:
    """All cells (header: record 0) with masked, and the texts that a dictionary could take in (Text, Scope)."""
    record = body.groupBy("file", "record_no").agg(F.map_from_entries(F.collect_set(F.struct(F.coalesce("col_name", F.concat(F.lit("\0"), "col_idx")), "cell"))).alias("m"))
    cases = []
    for i, c in enumerate(configs):
        for name, template in ({} if restore else c.columns).items():
            parts = [F.lit(text) if n is None else F.coalesce(F.try_element_at("m", F.lit(n)), F.lit(f"_UNRESOLVED_{n}_")) for text, n in template_parts(template)]
            cases.append(F.when((F.col("cfg") == i) & (F.col("col_name") == name), F.concat(*parts, F.lit(""))))
    own = F.coalesce(*cases) if cases else F.lit(None).cast("string")
    free = allowed.select("file", F.coalesce("i_allow", F.lit(False)).alias("free"))
    rows = body.join(record, ["file", "record_no"]).join(free, "file").withColumn("own", F.when(F.col("filled"), own))
    masked = result.changed.select("file", F.col("line_num").alias("record_no"), F.col("part").alias("col_idx"), "masked")
    rows = rows.join(masked, ["file", "record_no", "col_idx"], "left")
    rows = rows.withColumn("masked", F.when(F.col("filled"), F.when(F.col("free"), F.col("cell")).otherwise(F.col("own"))).otherwise(F.coalesce("masked", "cell")))
    listed = F.array(*[F.lit(f"{i}:{n}") for i, c in enumerate(configs) for n in c.dictionary], F.lit(""))
    taken = F.when(F.col("filled") & F.col("free") & (F.col("cell") != F.col("own")), "template").when(
        ~F.col("filled") & F.array_contains(listed, F.concat(F.col("cfg").cast("string"), F.lit(":"), "col_name")) & (F.col("masked") == F.col("cell")), "dictionary")
    found = rows.select(F.lower(F.trim("cell")).alias("Text"), taken.alias("Scope")).where("Scope is not null and Text <> ''").groupBy("Text").agg(F.min("Scope").alias("Scope"))
    head = parsed.where("record_no = 0").select("file", "record_no", "col_idx", "cell", F.col("cell").alias("masked"))
    return rows.select("file", "record_no", "col_idx", "cell", "masked").unionAll(head), found


def _stats(run: FolderRun, result: masking.Result, files: DataFrame, live: DataFrame, told: DataFrame, skipped: DataFrame) -> DataFrame:
    n, many = F.count(F.lit(1)), F.lit(0)
    size = F.length(F.regexp_replace("text", EOL, ""))
    parts = [
        told.agg(n.alias("Read Files"), F.coalesce(F.sum(size), many).alias("Read Bytes"), F.count_if(is_csv()).alias("Read Csv Files"), F.count_distinct(F.when(F.col("zip_path").isNotNull(), F.col("path"))).alias("Read Zip Files"),
                 F.coalesce(F.sum(F.when(F.col("text") != "", F.size(F.split("text", EOL, -1)))), many).alias("Read Lines"), F.count_if(F.col("cfg").isNotNull()).alias("Changed Csv Column Template Files")),
        run.changed.agg(n.alias("Changed Files"), F.count_distinct(F.when(F.col("zip_path").isNotNull(), F.col("path"))).alias("Changed Zip Files")),
        live.where("text is null").select("file").unionAll(skipped.select("File")).agg(n.alias("Failed Files")),
        result.matches.agg(n.alias("Words Matched"), F.count_if("kept").alias("Words Replaced"), F.count_if(~F.col("free") & ~F.col("kept")).alias("Words Conflicts")),
        run.report.agg(n.alias("Report Lines - All"), F.count_if("Allow").alias("Report Lines - Allow"), F.count_if(~F.col("Allow")).alias("Report Lines - Disallow"), F.count_if(F.col("Allow").isNull()).alias("Report Lines - To Review")),
        run.generated.agg(n.alias("Words Replacements Generated")),
        run.cumulative.agg(n.alias("Restore Report Lines - Cumulative")),
        run.restore.agg(n.alias("Restore Report Lines - Last")),
        run.errors.agg(n.alias("File Errors")),
    ]
    if run.candidates is not None:
        parts.append(run.candidates.agg(n.alias("Words CSV Dictionary Candidate")))
    out = None
    for p in parts:
        rows = p.select(*[F.col(f"`{c}`").cast("long").alias(c) for c in p.columns]).unpivot([], p.columns, "name", "value")
        out = rows if out is None else out.unionAll(rows)
    return out.orderBy("name")


def write_csv(rows: DataFrame, path: str | None, header: bool = True) -> str | None:
    """Rows in their order as a folder of CSV part files (header alone if there are none); no path, no report."""
    if path:
        rows.write.mode("overwrite").csv(path, header=header, escape='"', emptyValue="", nullValue="")
    return path


def run_folder(spark: SparkSession, settings: dict | str) -> FolderRun:
    """A run by settings (a file or what it holds): reads read.folder, writes changed files and the reports.

    scan.direction is replace (default) or restore. Changed files go to write.folder, with a warning if it was not
    empty, or over the originals if write.inplace. An unreadable file becomes an error and a report row.
    """
    s = read_settings(settings) if isinstance(settings, str) else settings
    direction = ((s.get("scan") or {}).get("direction") or "replace").strip().lower() or "replace"
    if direction not in ("replace", "restore"):
        raise ValueError(f"scan.direction: {direction}")
    restore, own = direction == "restore", s.get(direction) or {}
    folder, write, told = s["read"]["folder"], s.get("write") or {}, s.get("context") or {}
    paths = lambda kind: [*(((own.get("file") or {}).get(kind) or {}).get("values") or []), *(w for f in ((own.get("file") or {}).get(kind) or {}).get("valueFiles") or [] for w in word_set(f))]
    pruned: dict[str, int] = {}
    raw = read_files(spark, folder, paths("guard") or ["**/", "**/*"], paths("ignore"), pruned)
    files = written(decoded(raw).select("path", "zip_path", "file", "text", F.regexp_replace("error", "^FAILED", "Failed").alias("error")), "files")
    discard(raw)
    instructed = lambda d: read_instructions(spark, (d.get("instruction") or {}).get("files") or []).drop("src")
    c = s.get("csv") or {}
    listed = [TableConfig(x["filename"], x.get("columns") or {}, x.get("dictionary") or {}) for x in c.get("files") or []] if c.get("enabled") else []
    csv = Csv(listed, c.get("delim") or ",", c.get("quote") or '"', c.get("commentMarker"))
    other = s.get("restore") or {}
    run = mask_files(
        files, guard_of(own), instructed(own), restore, csv, instructed(other), guard_of(other), told.get("keepLength", 15), told.get("minCompareLength", 1)
    )
    pruned = spark.createDataFrame([(f"Ignored {k.title()}", v) for k, v in sorted(pruned.items())], "name string, value long")
    run.stats = written(run.stats.unionAll(pruned), "stats").orderBy("name")
    write_csv(masking.sort_report(run.report), own.get("report"))
    if not restore:
        write_csv(masking.sort_report(run.restore), own.get("restoreInstructionLast"))
        write_csv(masking.sort_report(run.cumulative), own.get("restoreInstructionCumulative"))
        if not run.generated.isEmpty():
            write_csv(run.generated.orderBy("word"), own.get("generatedReplacement"), header=False)
        if run.candidates is not None and not run.candidates.isEmpty():
            write_csv(run.candidates, c.get("dictionaryCandidate"))
    write_csv(run.errors.orderBy("File", "Message"), own.get("fileError"))
    if write.get("inplace"):
        discard(write_files(run.changed, folder, folder))
    elif target := write.get("folder"):
        if not is_empty(target):
            warnings.warn(f"{target} was not empty before the run", stacklevel=2)
        discard(write_files(run.changed, target, folder))
    return run
