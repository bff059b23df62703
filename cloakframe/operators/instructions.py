"""Review instructions: reading, index, and the one that decides a match."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cloakframe.functions.text import blank, path_regex, path_regex_column

SCHEMA = "Allow string, Text string, Context string, File string, Line string, Replacement string, Comment string"
REPORT = "Allow boolean, Text string, Context string, File string, Line int, Replacement string, Comment string"


def to_boolean(c: Column) -> Column:
    """Blank is null; y, yes, true and 1 are true; all else is false."""
    return F.when(~blank(c), F.lower(F.trim(c)).isin("y", "yes", "true", "1"))


def read_instructions(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Report files as instructions, by the names in their headers: trimmed cells, missing columns empty, missing files nothing.

    Allow and Text are required.
    """
    out = spark.createDataFrame([], REPORT + ", src int")
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for i, p in enumerate(paths):
        path = jvm.org.apache.hadoop.fs.Path(p)
        if path.getFileSystem(conf).exists(path):
            raw = spark.read.csv(p, header=True, escape='"', multiLine=True, ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)
            names = {c.strip(): c for c in raw.columns}
            if lost := {"Allow", "Text"} - set(names):
                raise ValueError(f"{p}: no column {sorted(lost)}")
            columns = [c.split()[0] for c in SCHEMA.split(", ")]
            rows = raw.select(*[(F.col(f"`{names[c]}`") if c in names else F.lit("")).alias(c) for c in columns])
            out = out.unionByName(typed(rows).withColumn("src", F.lit(i)))
    return out


def typed(raw: DataFrame) -> DataFrame:
    text = lambda c: F.trim(F.coalesce(F.col(c).cast("string"), F.lit("")))
    return raw.select(
        to_boolean(F.col("Allow").cast("string")).alias("Allow"), text("Text").alias("Text"), text("Context").alias("Context"), text("File").alias("File"),
        F.when(text("Line") != "", text("Line").cast("int")).alias("Line"), text("Replacement").alias("Replacement"), text("Comment").alias("Comment"),
    )


def prepared(instructions: DataFrame) -> DataFrame:
    """Distinct instructions with lower-cased text and context and the file pattern as a regular expression."""
    rows = instructions.select("Allow", F.lower("Text").alias("Text"), F.lower("Context").alias("Context"), "File", "Line", "Replacement", "Comment").distinct()
    return rows.withColumn("file_rx", path_regex_column(F.col("File")))


def simple_replacements(instructions: DataFrame) -> DataFrame:
    """word_lc and the set of its non-blank replacements."""
    rows = instructions.where(~blank(F.col("Text")) & ~blank(F.col("Replacement")))
    return rows.groupBy(F.lower("Text").alias("word_lc")).agg(F.array_sort(F.collect_set("Replacement")).alias("values"))


NO_LINE = -1


def indexed(instructions: DataFrame) -> DataFrame:
    """Instructions by what they have to meet: text, told (context), path (blank, a plain path or null for a pattern), line.

    Of those that meet alike one is kept, the best; an instruction for a line stands for its file, too. at and size say
    where in its context the text begins and how long that is (null: the context is blank or does not hold the text).
    """
    i = prepared(instructions).where(~blank(F.col("Text")))
    context, file, line = F.when(blank(F.col("Context")), "").otherwise(F.col("Context")), F.col("File"), F.col("Line").cast("long")
    plain = F.when(blank(file), F.array(F.lit(""))).when(file.rlike(r"[*?]"), F.array(F.lit(None).cast("string"))).otherwise(F.array_distinct(F.array(file, F.replace(file, F.lit("\\"), F.lit("/")))))
    lines = F.when(blank(file) | line.isNull(), F.array(F.lit(NO_LINE).cast("long"))).otherwise(F.array(F.lit(NO_LINE).cast("long"), line))
    order = F.struct(F.coalesce(F.col("Allow").cast("int"), F.lit(2)).alias("rank"), F.col("Replacement").alias("put"), F.col("Comment").alias("comment"))
    rows = i.select(F.col("Text").alias("text"), context.alias("told"), F.length("Context").alias("width"), F.length("File").alias("length"), F.col("file_rx"), "Allow", order.alias("order"), F.explode(plain).alias("path"), lines.alias("lines"))
    rows = rows.withColumn("line", F.explode("lines"))
    best = F.min_by(F.struct("width", "length", F.col("Allow").alias("allow"), "order"), F.struct(-F.col("width"), -F.col("length"), "order"))
    rows = rows.groupBy("text", "told", "path", F.when(F.col("path").isNull(), F.col("file_rx")).alias("file_rx"), "line").agg(best.alias("i"))
    return rows.withColumns({"at": F.expr("nullif(instr(told, text), 0) - 1"), "size": F.length("told")})


def decided(matches: DataFrame, instructions: DataFrame, least: int = 1) -> DataFrame:
    """Matches (with their context) and the instruction that fits best: i_allow, i_replacement, i_comment (or nulls).

    It fits by text, context (blank, equal, or a part long enough that holds the word) and file (blank, equal or
    pattern); of several, the one for this very line wins, then longer context, longer file, false before true.

    A match looks its instructions up by equal keys: its text with each part of its context that some instruction of
    that text could have (the place of the text in it and the length are known from the instructions; there are few such
    shapes, as contexts are short), with no file, its file, or its file and line. So the work follows the instructions
    that fit, not all those of the word. Only file patterns are tried one by one, on matches whose text and context fit.
    """
    told = indexed(instructions)
    none = {"i_allow": "boolean", "i_replacement": "string", "i_comment": "string"}
    if told.isEmpty():
        return matches.withColumns({c: F.lit(None).cast(t) for c, t in none.items()})
    key = ["file", "line_num", "part", "start", "end", "src"]
    shapes = told.where("at is not null").groupBy("text").agg(F.collect_set(F.struct("at", "size")).alias("shapes"))
    m = matches.select(*key, F.col("word_lc").alias("text"), F.lower("context").alias("ctx")).join(shapes, "text", "left")
    # all places of the text in the context, and what a part of each shape around them reads
    places = "transform(filter(sequence(1, greatest(length(ctx) - length(text) + 1, 1)), p -> substring(ctx, p, length(text)) = text), p -> p - 1)"
    around = f"flatten(transform({places}, p -> transform(filter(shapes, s -> s.at <= p and p - s.at + s.size <= length(ctx) and s.size < length(ctx) and s.size >= length(text) + {int(least)}), s -> substring(ctx, p - s.at + 1, s.size))))"
    m = m.withColumn("told", F.expr(f"explode(array_distinct(concat(array('', ctx), coalesce({around}, array()))))")).drop("shapes", "ctx")
    paths = f"array(struct('' as path, {NO_LINE}L as line), struct(file as path, {NO_LINE}L as line), struct(file as path, cast(line_num as bigint) as line))"
    by_path = m.withColumn("p", F.expr(f"explode({paths})")).select(*key, "text", "told", "p.path", "p.line")
    hit = by_path.join(told.where("path is not null").select("text", "told", "path", "line", "i"), ["text", "told", "path", "line"]).select(*key, F.when(F.col("line") == NO_LINE, 1).otherwise(0).alias("far"), "i")
    wide = m.join(told.where("path is null").select("text", "told", "file_rx", "line", "i"), ["text", "told"]).where(f"file rlike file_rx and line in ({NO_LINE}, line_num)")
    hit = hit.unionByName(wide.select(*key, F.when(F.col("line") == NO_LINE, 1).otherwise(0).alias("far"), "i"))
    order = F.struct("far", -F.col("i.width"), -F.col("i.length"), "i.order")
    best = hit.groupBy(*key).agg(F.min_by("i", order).alias("b"))
    out = matches.join(best, key, "left")
    return out.select(*matches.columns, F.col("b.allow").alias("i_allow"), F.col("b.order.put").alias("i_replacement"), F.col("b.order.comment").alias("i_comment"))


def skipped_rows(rows: DataFrame, instructions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of the files that are not skipped, and a report row for each skipped file.

    Instructions without a text skip their files whole, whatever Allow says. Plain paths meet the rows in a join; only
    patterns, which people write, become one expression.
    """
    told = instructions.where(blank(F.col("Text")) & ~blank(F.col("File"))).select(F.lower("File").alias("skip_file")).distinct()
    patterns = [r.skip_file for r in told.where(F.col("skip_file").rlike(r"[*?]")).orderBy("skip_file").collect()]
    plain, empty = told.where(~F.col("skip_file").rlike(r"[*?]")), rows.sparkSession.createDataFrame([], REPORT)
    live, gone = rows, None
    if patterns:
        fits = F.lower("file").rlike("|".join(f"(?:{path_regex(p)})" for p in patterns))
        live, gone = live.where(~fits), rows.where(fits).select("file")
    if not plain.isEmpty():
        same = F.lower("file") == F.col("skip_file")
        also = live.join(plain, same, "left_semi").select("file")
        live, gone = live.join(plain, same, "left_anti"), also if gone is None else gone.unionAll(also)
    if gone is None:
        return rows, empty
    report = gone.distinct().select(
        F.lit(True).alias("Allow"), F.lit("").alias("Text"), F.lit("").alias("Context"), F.col("file").alias("File"), F.lit(0).alias("Line"),
        F.lit(None).cast("string").alias("Replacement"), F.lit("Ignore file due to previous failure").alias("Comment"),
    )
    return live, report
