"""The registered masking queries and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cloakframe.functions.text import path_guarded, word_hash
from cloakframe.operators.instructions import SCHEMA, decided, skipped_rows, typed
from cloakframe.operators.matching import Guard, find, lines, tokens, value_frames
from cloakframe.plans import masking
from cloakframe.plans.runner import Csv, FolderRun, mask_files
from cloakframe.plans.tables import TableConfig, dictionary_candidates, mask_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

EMAIL, IP = r"\w[\w.-]+@\w+(\.\w+)+", r"\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}"
GUARD = Guard(
    {"idiot": "", "stupid": "x{hash}", "trash": "litter", "license": "", "cc": "", "cc by-nc": "", "mail": ""},
    {EMAIL: "u{hash}@mail.local", IP: "h{hash}.domain.local"},
    {"127.0.0.1", "license"},
    [r"w\d{3,}", r"^1\d\."],
)
INSTRUCTIONS = [
    ("true", "idiot", "the idiot", "", "", "", "seen"),
    ("false", "idiot", "", "", "", "fool", "any"),
    ("", "stupid", "", "*7", "", "", ""),
    ("yes", "trash", "", "**/*1", "", "", "odd"),
    ("false", "moron", "", "", "", "m0", "new word"),
]


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _lines(spark: SparkSession, sf_dir: str, name: str = "documents", key: str = "doc_id") -> DataFrame:
    return lines(spark.read.parquet(f"{sf_dir}/{name}.parquet").select(key, "text"), key, "text")


def _instructions(spark: SparkSession) -> DataFrame:
    return typed(spark.createDataFrame(INSTRUCTIONS, SCHEMA))


def _run(spark: SparkSession, sf_dir: str) -> masking.Result:
    return masking.run(_lines(spark, sf_dir), GUARD, _instructions(spark))


def _text(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _values(rows) -> str:
    return ", ".join("(" + ", ".join(_text(x) for x in r) + ")" for r in rows)


_WORD = r"[\p{L}\p{Nl}\p{Nd}]"
_LINES = r"""l AS (
  SELECT CAST(doc_id AS VARCHAR) AS file, CAST(i AS INTEGER) AS line_num, p[i] AS line
  FROM (SELECT doc_id, regexp_split_to_array(text, '\r\n|\n|\r') AS p FROM documents WHERE text <> ''), unnest(range(1, len(p) + 1)) AS u(i))"""


def _found(name: str, of: str, rx: str) -> str:
    """A CTE with the matches of a pattern in the expression `of` of every line."""
    rx = _text(rx)
    return f"""{name} AS (
  SELECT file, line_num, line, h[i] AS hit, CAST(coalesce(list_sum(list_transform(g[1:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(h[1:i - 1], lambda x: length(x))), 0) AS INTEGER) AS s
  FROM (SELECT file, line_num, line, regexp_extract_all({of}, {rx}, 0) AS h, regexp_split_to_array({of}, {rx}) AS g FROM l WHERE regexp_matches({of}, {rx})) z, unnest(range(1, len(h) + 1)) AS u(i))"""


def _whole(t: str) -> str:
    return f"NOT (s > 0 AND regexp_matches(substring(line, s, 1), '{_WORD}')) AND NOT regexp_matches(substring(line, s + length({t}) + 1, 1), '{_WORD}')"


def _matches_sql() -> str:
    words = [(k, v) for k, v in GUARD.values.items() if k.isalnum()] + [("moron", "m0")]
    phrases = [(k, v) for k, v in GUARD.values.items() if not k.isalnum()]
    ctes = [_LINES, _found("tok", "line", _WORD + "+"), f"words(w, template) AS (VALUES {_values(words)})"]
    parts = ["SELECT file, line_num, line, s, CAST(s + length(hit) AS INTEGER) AS e, hit AS word, w AS word_lc, 'Value ' || w AS reason, template, 0 AS src FROM tok JOIN words ON lower(hit) = w"]
    for n, (p, reason, t) in enumerate([(k, f"Value {k}", v) for k, v in phrases] + [(p, f"Pattern {p}", t) for p, t in GUARD.patterns.items()]):
        ctes.append(_found(f"p{n}", "lower(line)", p))
        parts.append(f"SELECT file, line_num, line, s, CAST(s + length(hit) AS INTEGER), substring(line, s + 1, length(hit)), hit, {_text(reason)}, {_text(t)}, {n + 1} FROM p{n} WHERE {_whole('hit')}")
    ignore = " AND ".join([f"word_lc NOT IN ({', '.join(_text(v) for v in sorted(GUARD.ignore_values))})"] + [f"NOT regexp_matches(word_lc, {_text(p)})" for p in GUARD.ignore_patterns])
    ctes.append("every AS (" + "\n  UNION ALL ".join(parts) + ")")
    ctes.append(f"m AS (SELECT * FROM every WHERE {ignore})")
    return ",\n".join(ctes)


_HASH = """(SELECT CASE WHEN v > 2147483647 THEN 4294967296 - v ELSE v END FROM (SELECT list_reduce(list_transform(string_split(repeat({w}, CAST(CASE WHEN length({w}) >= 20 THEN 1 ELSE power(2, ceil(log2(20.0 / length({w})))) END AS INTEGER)), ''), lambda x: CAST(unicode(x) AS BIGINT)), lambda a, b: (a * 31 + b) % 4294967296) AS v))"""


def _context_sql(line: str, s: str, e: str) -> str:
    a0 = f"(CASE WHEN {s} - 15 < 0 OR ({s} > 15 AND {s} - 17 < 0) THEN 0 ELSE {s} - 15 END)"
    e0 = f"(CASE WHEN {e} + 15 > length({line}) OR ({e} + 15 < length({line}) AND {e} + 17 > length({line})) THEN length({line}) ELSE {e} + 15 END)"
    a1 = f"({a0} + length(regexp_extract(substring({line}, {a0} + 1, greatest({s} - 1 - {a0}, 0)), '^[\\x00-\\x20]*')))"
    e1 = f"({e0} - length(regexp_extract(substring({line}, {e} + 2, greatest({e0} - {e} - 1, 0)), '[\\x00-\\x20]*$')))"
    return f"(CASE WHEN {a1} > 0 THEN '..' ELSE '' END || substring({line}, {a1} + 1, {e1} - {a1}) || CASE WHEN {e1} < length({line}) THEN '..' ELSE '' END)"


def _decided_sql() -> str:
    rows = []
    for allow, text, ctx, file, line, put, comment in INSTRUCTIONS:
        rx = {"": "", "*7": "^[^/]*7$", "**/*1": "^(?:[^/]+/)*[^/]*1$"}[file]
        a = "NULL" if not allow else "TRUE" if allow.lower() in ("y", "yes", "true", "1") else "FALSE"
        rows.append(f"(CAST({a} AS BOOLEAN), {_text(text)}, {_text(ctx)}, {_text(file)}, {_text(rx)}, {_text(put)}, {_text(comment)})")
    return _matches_sql() + f""",
ins(i_allow, i_text, i_ctx, i_file, i_rx, i_put, i_comment) AS (VALUES {', '.join(rows)}),
c AS (SELECT *, {_context_sql('line', 's', 'e')} AS context FROM m),
d AS (
  SELECT * FROM c LEFT JOIN ins ON i_text = word_lc
    AND (i_ctx = '' OR i_ctx = lower(context) OR (length(context) > length(i_ctx) AND length(i_ctx) >= length(word_lc) + 1 AND contains(lower(context), i_ctx) AND contains(i_ctx, word_lc)))
    AND (i_file = '' OR i_file = file OR regexp_matches(file, i_rx))
  QUALIFY row_number() OVER (PARTITION BY file, line_num, s, e, src ORDER BY length(i_ctx) DESC, length(i_file) DESC, CASE WHEN i_allow IS NULL THEN 2 WHEN i_allow THEN 1 ELSE 0 END, i_put, i_comment) = 1),
t AS (SELECT *, CASE WHEN template = '' THEN 2 WHEN contains(template, '{{') THEN 1 ELSE 0 END AS rank FROM d),
gen AS (
  SELECT word_lc AS gw, template AS gt, replace(CASE WHEN template = '' THEN 'w{{hash}}' ELSE template END, '{{hash}}', CAST({_HASH.format(w='word_lc')} AS VARCHAR)) AS gv
  FROM (SELECT word_lc, template FROM t WHERE coalesce(i_put, '') = '' QUALIFY row_number() OVER (PARTITION BY word_lc ORDER BY s - e, rank, file, line_num, s, src) = 1)),
v AS (SELECT t.*, coalesce(i_allow, FALSE) AS free, CASE WHEN coalesce(i_put, '') <> '' THEN i_put ELSE gv END AS val FROM t LEFT JOIN gen ON gw = word_lc),
k AS (
  SELECT *, NOT free AND NOT EXISTS (
    SELECT 1 FROM v x WHERE x.file = v.file AND x.line_num = v.line_num AND NOT x.free AND x.s < v.e AND v.s < x.e
      AND (x.s - x.e, x.rank, x.s, x.src, x.reason) < (v.s - v.e, v.rank, v.s, v.src, v.reason)) AS kept
  FROM v),
places AS (
  SELECT *, coalesce(lag(e) OVER w, 0) AS prior, lead(s) OVER w IS NULL AS final,
    s + coalesce(sum(length(val) - (e - s)) OVER (PARTITION BY file, line_num ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS place0
  FROM k WHERE kept WINDOW w AS (PARTITION BY file, line_num ORDER BY s)),
p AS (SELECT *, CAST(place0 AS BIGINT) AS place FROM places),
masked AS (
  SELECT file, line_num, string_agg(substring(line, prior + 1, s - prior) || val || CASE WHEN final THEN substring(line, e + 1) ELSE '' END, '' ORDER BY s) AS masked
  FROM p GROUP BY file, line_num)"""


_RUN = "WITH " + _decided_sql()
_M = "WITH " + _matches_sql()
_REPORT = """SELECT i_allow AS "Allow", word_lc AS "Text", context AS "Context", file AS "File", line_num AS "Line", CASE WHEN NOT free THEN val END AS "Replacement",
  CASE WHEN free THEN 'Allowed: ' || reason || ', Suggested: ' || val WHEN coalesce(i_put, '') <> '' THEN 'Instruction ' || i_comment ELSE 'Generated for ' || reason END AS "Comment"
FROM k WHERE free OR kept"""
_BACK = f"""SELECT CAST(NULL AS BOOLEAN) AS "Allow", lower(val) AS "Text", {_context_sql('masked', 'place', '(place + length(val))')} AS "Context", file AS "File", line_num AS "Line", word AS "Replacement", 'Restore ' || reason AS "Comment"
FROM p JOIN masked USING (file, line_num)"""


@query(f"WITH {_LINES} SELECT file, line_num, line FROM l")
def lines_split(spark, sf_dir):
    return _lines(spark, sf_dir)


@query(f"WITH {_LINES}, {_found('tok', 'line', _WORD + '+')} SELECT lower(hit) AS word_lc, count(*) AS n, CAST(sum(s) AS BIGINT) AS places FROM tok GROUP BY lower(hit)")
def token_counts(spark, sf_dir):
    return tokens(_lines(spark, sf_dir)).groupBy("word_lc").agg(F.count(F.lit(1)).alias("n"), F.sum("start").alias("places"))


_COLUMNS = 'file, line_num, s AS "start", e AS "end", word, word_lc, reason, template'


def _shown(m: DataFrame) -> DataFrame:
    return m.select("file", "line_num", "start", "end", "word", "word_lc", "reason", F.coalesce("template", F.lit("")).alias("template"))


@query(f"{_M} SELECT {_COLUMNS} FROM every WHERE src = 0 AND word_lc <> 'moron'")
def dict_match_words(spark, sf_dir):
    return _shown(find(_lines(spark, sf_dir), Guard({k: v for k, v in GUARD.values.items() if k.isalnum()})))


@query(f"{_M} SELECT {_COLUMNS} FROM every WHERE src > 0")
def phrase_and_pattern_matches(spark, sf_dir):
    return _shown(find(_lines(spark, sf_dir), Guard({k: v for k, v in GUARD.values.items() if not k.isalnum()}, GUARD.patterns)))


@query(f"{_M} SELECT {_COLUMNS} FROM every WHERE reason = {_text('Pattern ' + EMAIL)}")
def pattern_match_email(spark, sf_dir):
    return _shown(find(_lines(spark, sf_dir), Guard({}, {EMAIL: GUARD.patterns[EMAIL]})))


@query(f"{_M} SELECT {_COLUMNS} FROM every WHERE reason = {_text('Pattern ' + IP)}")
def pattern_match_ip(spark, sf_dir):
    return _shown(find(_lines(spark, sf_dir), Guard({}, {IP: GUARD.patterns[IP]})))


@query(f"{_M} SELECT {_COLUMNS} FROM m WHERE word_lc <> 'moron'")
def ignore_filter(spark, sf_dir):
    return _shown(find(_lines(spark, sf_dir), GUARD))


@query(f'{_RUN} SELECT file, line_num, s AS "start", e AS "end", word_lc, i_allow AS allow, i_put AS replacement, i_comment AS comment FROM d')
def instruction_top1(spark, sf_dir):
    instructions = _instructions(spark)
    words = masking.with_instructed(value_frames(spark, GUARD), instructions)
    found = decided(find(_lines(spark, sf_dir), GUARD, words), instructions)
    return found.select("file", "line_num", "start", "end", "word_lc", F.col("i_allow").alias("allow"), F.col("i_replacement").alias("replacement"), F.col("i_comment").alias("comment"))


@query(f'{_RUN} SELECT file, line_num, s AS "start", e AS "end", word_lc, kept, free AS allowed FROM k')
def overlap_resolved(spark, sf_dir):
    return _run(spark, sf_dir).matches.select("file", "line_num", "start", "end", "word_lc", "kept", F.col("free").alias("allowed"))


@query(f"WITH {_LINES}, {_found('tok', 'line', _WORD + '+')}, w AS (SELECT DISTINCT lower(hit) AS word FROM tok) SELECT word, 'w' || CAST({_HASH.format(w='word')} AS VARCHAR) AS replacement FROM w")
def hash_replacement(spark, sf_dir):
    words = tokens(_lines(spark, sf_dir)).select(F.col("word_lc").alias("word")).distinct()
    return words.select("word", F.concat(F.lit("w"), word_hash(F.col("word")).cast("string")).alias("replacement"))


@query(f"{_RUN} SELECT gw AS word, gv AS replacement FROM gen WHERE gt = '' OR gv <> gt")
def generated_replacements(spark, sf_dir):
    return _run(spark, sf_dir).generated


@query(f"{_RUN} SELECT file, line_num, masked FROM masked JOIN l USING (file, line_num) WHERE masked <> line")
def masked_lines(spark, sf_dir):
    return _run(spark, sf_dir).changed.select("file", "line_num", "masked")


@query(f"{_RUN} SELECT file, string_agg(line, chr(10) ORDER BY line_num) AS original, string_agg(coalesce(masked, line), chr(10) ORDER BY line_num) AS masked, coalesce(bool_or(masked <> line), FALSE) AS changed FROM l LEFT JOIN masked USING (file, line_num) GROUP BY file")
def masked_files(spark, sf_dir):
    return masking.files(_run(spark, sf_dir))


@query(f"{_RUN} {_REPORT}")
def report(spark, sf_dir):
    return _run(spark, sf_dir).report


@query(f"{_RUN} {_BACK}")
def restore_instructions(spark, sf_dir):
    return _run(spark, sf_dir).restore


@query(f"""{_RUN}, r AS ({_REPORT}) SELECT count(*) AS all_rows, count(*) FILTER (WHERE "Allow") AS allow, count(*) FILTER (WHERE NOT "Allow") AS disallow, count(*) FILTER (WHERE "Allow" IS NULL) AS to_review FROM r""")
def report_stats(spark, sf_dir):
    r = _run(spark, sf_dir).report
    return r.agg(F.count(F.lit(1)).alias("all_rows"), F.count_if("Allow").alias("allow"), F.count_if(~F.col("Allow")).alias("disallow"), F.count_if(F.col("Allow").isNull()).alias("to_review"))


@query(f"""{_RUN}, r AS ({_REPORT})
SELECT 'Read Lines' AS name, count(*) AS value FROM l UNION ALL SELECT 'Read Bytes', CAST(sum(length(line)) AS BIGINT) FROM l UNION ALL SELECT 'Read Files', count(DISTINCT file) FROM l
UNION ALL SELECT 'Changed Files', count(DISTINCT file) FROM masked JOIN l USING (file, line_num) WHERE masked <> line UNION ALL SELECT 'Words Matched', count(*) FROM k UNION ALL SELECT 'Words Replaced', count(*) FROM p UNION ALL SELECT 'Words Conflicts', count(*) FROM k WHERE NOT free AND NOT kept
UNION ALL SELECT 'Report Lines - All', count(*) FROM r UNION ALL SELECT 'Report Lines - Allow', count(*) FROM r WHERE "Allow" UNION ALL SELECT 'Report Lines - Disallow', count(*) FROM r WHERE NOT "Allow"
UNION ALL SELECT 'Report Lines - To Review', count(*) FROM r WHERE "Allow" IS NULL UNION ALL SELECT 'Words Replacements Generated', count(*) FROM gen WHERE gt = '' OR gv <> gt""")
def stats(spark, sf_dir):
    return masking.stats(_run(spark, sf_dir))


@query(f"""{_RUN}, r AS ({_BACK}), x AS (SELECT "Text" AS word, list_sort(list(DISTINCT "Replacement")) AS vs FROM r GROUP BY "Text")
SELECT word, CASE WHEN len(vs) = 1 THEN vs[1] ELSE '<<AMBIGUOUS:' || word || ':' || array_to_string(vs, '|') || '>>' END AS replacement FROM x
UNION ALL SELECT 'w0123456789', '<<NO_RESTORE:w0123456789>>'""")
def restore_lookup(spark, sf_dir):
    back = _run(spark, sf_dir).restore
    words = back.select(F.col("Text").alias("word_lc")).unionAll(spark.createDataFrame([("w0123456789",)], "word_lc string"))
    return masking.restored_values(words, back)


@query(f"""{_RUN}, r AS ({_BACK}), b AS (SELECT *, 0 AS run FROM r UNION ALL SELECT * REPLACE ('Restore earlier run' AS "Comment"), 1 AS run FROM r)
SELECT "Allow", "Text", "Context", "File", "Line", "Replacement", "Comment" FROM b QUALIFY row_number() OVER (PARTITION BY "Text", "Context", "File", "Line", "Replacement" ORDER BY length("Comment") DESC, run, "Comment") = 1""")
def restore_cumulative(spark, sf_dir):
    last = _run(spark, sf_dir).restore
    return masking.cumulative(last, last.withColumn("Comment", F.lit("Restore earlier run")))


@query(f"WITH {_LINES} SELECT file, line_num, line, 'moron' AS also FROM l WHERE regexp_matches(lower(line), '(^|[^\\p{{L}}\\p{{Nl}}\\p{{Nd}}])moron($|[^\\p{{L}}\\p{{Nl}}\\p{{Nd}}])')")
def restore_roundtrip(spark, sf_dir):
    """Lines that masking and then restoring by the run's own rows does not give back.

    Words, phrases, e-mails, addresses and instructed words all come back, each by the row of its own place. What
    stood there before like a replacement does not: `trash` becomes `moron` here, and lines have `moron` of their own.
    """
    guard = Guard(GUARD.values | {"trash": "moron"}, GUARD.patterns, GUARD.ignore_values, GUARD.ignore_patterns)
    told = typed(spark.createDataFrame(INSTRUCTIONS[:3], SCHEMA))
    rows = _lines(spark, sf_dir)
    first = masking.run(rows, guard, told)
    # lines as they are (part 0) and what masking made of those that it changed (1): no line meets the changed ones before it
    # was searched, and what restoring makes of a line that masking changed counts no more
    changed = first.changed.select("file", "line_num", "line", "masked")
    both = rows.select("file", "line_num", F.lit(0).alias("part"), "line").unionAll(changed.select("file", "line_num", F.lit(1).alias("part"), F.col("masked").alias("line")))
    back = masking.run(both, Guard({}, {}), first.restore, restore=True).changed.select("file", "line_num", "part", "line", F.col("masked").alias("restored"))
    at = ["file", "line_num"]
    alone = back.where("part = 0").drop("part").join(changed.select(*at), at, "left_anti")
    again = changed.join(back.where("part = 1").select(*at, "restored"), at, "left").select(*at, "line", F.coalesce("restored", "masked").alias("restored"))
    return alone.unionByName(again).where("restored <> line").select(*at, "line", F.lit("moron").alias("also"))


_PHRASES = "SELECT DISTINCT lower(array_to_string(string_split(text, ' ')[1:3], ' ')) AS p FROM benchmark WHERE len(string_split(text, ' ')) > 2"


@query(f"""WITH {_LINES}, ph AS ({_PHRASES}),
x AS (SELECT file, line_num, line, p, string_split(lower(line), p) AS g FROM l JOIN ph ON contains(lower(line), p)),
occ AS (SELECT file, line_num, line, p, CAST(list_sum(list_transform(g[1:i], lambda y: length(y))) + (i - 1) * length(p) AS INTEGER) AS s FROM x, unnest(range(1, len(g))) AS u(i))
SELECT file, line_num, s AS "start", CAST(s + length(p) AS INTEGER) AS "end", p AS word_lc, 'Value ' || p AS reason FROM occ WHERE {_whole('p')}""")
def instructed_phrases(spark, sf_dir):
    """Phrases that instructions name (the first three words of every benchmark item) in all documents."""
    b = spark.read.parquet(f"{sf_dir}/benchmark.parquet").where(F.size(F.split("text", " ", -1)) > 2)
    told = b.select(F.lit("").alias("Allow"), F.array_join(F.slice(F.split("text", " ", -1), 1, 3), " ").alias("Text"), *[F.lit("").alias(c) for c in ("Context", "File", "Line")], F.concat(F.lit("b"), "item_id").alias("Replacement"), F.lit("").alias("Comment"))
    words = masking.with_instructed(value_frames(spark, Guard()), typed(told))
    return find(_lines(spark, sf_dir), Guard(), words).select("file", "line_num", "start", "end", "word_lc", "reason")


_RX = "SELECT DISTINCT regexp_replace(lower(string_split(text, ' ')[1]), '[^a-z]', '', 'g') || '\\s+' || regexp_replace(lower(string_split(text, ' ')[2]), '[^a-z]', '', 'g') || '\\w*' AS rx FROM benchmark WHERE len(regexp_replace(lower(string_split(text, ' ')[1]), '[^a-z]', '', 'g')) > 1"


@query(f"""WITH {_LINES}, px AS ({_RX}),
x AS (SELECT file, line_num, line, rx, regexp_extract_all(lower(line), rx, 0) AS h, regexp_split_to_array(lower(line), rx) AS g FROM l JOIN px ON regexp_matches(lower(line), rx)),
occ AS (SELECT file, line_num, line, rx, h[i] AS hit, CAST(list_sum(list_transform(g[1:i], lambda y: length(y))) + coalesce(list_sum(list_transform(h[1:i - 1], lambda y: length(y))), 0) AS INTEGER) AS s FROM x, unnest(range(1, len(h) + 1)) AS u(i))
SELECT file, line_num, s AS "start", CAST(s + length(hit) AS INTEGER) AS "end", hit AS word_lc, 'Pattern ' || rx AS reason FROM occ WHERE {_whole('hit')}""")
def many_patterns(spark, sf_dir):
    """A pattern for each benchmark item (its first two words, any space between them, any ending) in all documents."""
    b = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    word = lambda i: F.regexp_replace(F.lower(F.get(F.split("text", " ", -1), F.lit(i))), "[^a-z]", "")
    rx = b.select(F.concat(word(0), F.lit(r"\s+"), word(1), F.lit(r"\w*")).alias("rx"), word(0).alias("w")).where("length(w) > 1 and rx is not null").select("rx").distinct()
    guard = Guard({}, {r.rx: "p{hash}" for r in rx.orderBy("rx").collect()})  # patterns are settings; the table of items has a fixed size
    return find(_lines(spark, sf_dir), guard).select("file", "line_num", "start", "end", "word_lc", "reason")


@query(f"""{_RUN}, f AS (SELECT *, row_number() OVER (PARTITION BY file, line_num, word_lc, lower(context) ORDER BY s, src) AS n FROM t)
SELECT file, line_num, s AS "start", e AS "end", word_lc, 'r' || file || '-' || line_num || '-' || min(s) OVER (PARTITION BY file, line_num, word_lc, lower(context)) AS replacement FROM f""")
def instructions_by_line(spark, sf_dir):
    """Every match decided by the instruction made for its own file, line and context: as many instructions as matches."""
    found = find(_lines(spark, sf_dir), GUARD, masking.with_instructed(value_frames(spark, GUARD), _instructions(spark)))
    own = found.groupBy("file", "line_num", "word_lc", F.lower("context").alias("context")).agg(F.min("start").alias("s"))
    told = own.select(F.lit(None).cast("boolean").alias("Allow"), F.col("word_lc").alias("Text"), F.col("context").alias("Context"), F.col("file").alias("File"), F.col("line_num").alias("Line"),
                      F.concat(F.lit("r"), "file", F.lit("-"), "line_num", F.lit("-"), "s").alias("Replacement"), F.lit("").alias("Comment"))
    return decided(found, told).select("file", "line_num", "start", "end", "word_lc", F.col("i_replacement").alias("replacement"))


@query("""SELECT CASE WHEN c_nationkey % 3 = 0 THEN NULL WHEN c_nationkey % 3 = 1 THEN TRUE ELSE FALSE END AS "Allow", c_name AS "Text", 'name: "' || c_name || '", ' || c_mktsegment AS "Context", 'customer.csv' AS "File",
  CAST(c_custkey AS INTEGER) AS "Line", 'n' || c_custkey AS "Replacement", '' AS "Comment" FROM customer""")
def instruction_reader(spark, sf_dir):
    """Instructions from a CSV of all customers, whose columns come in another order, one of them unknown, one left out."""
    import uuid

    from cloakframe.operators.instructions import read_instructions
    from cloakframe.runtime import shared_dir

    path = f"{shared_dir(spark)}/cloakframe/told-{uuid.uuid4().hex}"
    allow = F.when(F.col("c_nationkey") % 3 == 0, "").when(F.col("c_nationkey") % 3 == 1, "Yes").otherwise("no")
    rows = spark.read.parquet(f"{sf_dir}/customer.parquet").select(
        F.concat(F.lit(" "), "c_name").alias("Text"), F.lit("zzz").alias("Note"), allow.alias("Allow"), F.concat(F.lit("n"), "c_custkey").alias("Replacement"), F.lit("customer.csv").alias("File"),
        F.col("c_custkey").alias("Line"), F.concat(F.lit('name: "'), "c_name", F.lit('", '), "c_mktsegment").alias("Context"))
    rows.write.csv(path, header=True, escape='"', emptyValue="", nullValue="")
    return read_instructions(spark, [path, path + "-none"]).drop("src")


_TABLE = Guard({"customer": "", "building": "b{hash}"}, {})


@query("""SELECT c_custkey, 'n' || c_custkey AS c_name, c_nationkey, c_acctbal,
  CASE WHEN lower(c_mktsegment) = 'building' THEN 'b{h}' ELSE c_mktsegment END AS c_mktsegment FROM customer""")
def csv_template_customer(spark, sf_dir):
    return mask_table(spark.read.parquet(f"{sf_dir}/customer.parquet"), "c_custkey", TableConfig("customer.csv", {"c_name": "n{c_custkey}"}, {"c_mktsegment": ""}), _TABLE)[0]


def _java_hash(word: str) -> int:
    while len(word) < 20:
        word += word
    v = 0
    for c in word:
        v = (31 * v + ord(c)) % (1 << 32)
    return v if v < 1 << 31 else (1 << 32) - v




@query("SELECT s_suppkey, 'n' || s_suppkey || '_' || s_nationkey AS s_name, s_nationkey, s_acctbal FROM supplier")
def csv_template_supplier(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/supplier.parquet")
    return mask_table(rows, "s_suppkey", TableConfig("supplier.csv", {"s_name": "n{s_suppkey}_{s_nationkey}"}), _TABLE)[0]


@query("SELECT s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier")
def csv_template_allowed(spark, sf_dir):
    """An instruction for the file, by the context of its template cells, leaves them alone."""
    rows = spark.read.parquet(f"{sf_dir}/supplier.parquet")
    told = typed(spark.createDataFrame([("true", "csv:supplier.csv:s_name", "No guarded words found", "supplier.csv", "", "", "seen")], SCHEMA))
    return mask_table(rows, "s_suppkey", TableConfig("supplier.csv", {"s_name": "n{s_suppkey}"}), _TABLE, told)[0]


@query("""SELECT CAST(NULL AS BOOLEAN) AS "Allow", 'building' AS "Text", 'c_mktsegment:' || c_mktsegment AS "Context", 'customer.csv' AS "File", c_custkey AS "Line", 'b{h}' AS "Replacement", 'Generated for Value building' AS "Comment"
FROM customer WHERE lower(c_mktsegment) = 'building'
UNION ALL SELECT NULL, 'csv:customer.csv:c_name', 'No guarded words found', 'customer.csv', 0, 'n{c_custkey}', 'CSV Column Template'""")
def csv_report(spark, sf_dir):
    """Report of a table's run: contexts by column, records by key, and the row for the file's templates."""
    guard = Guard({"building": "b{hash}"})
    return mask_table(spark.read.parquet(f"{sf_dir}/customer.parquet"), "c_custkey", TableConfig("customer.csv", {"c_name": "n{c_custkey}"}), guard)[1].report


@query("""WITH c AS (SELECT DISTINCT lower(trim(c_mktsegment)) AS t FROM customer WHERE trim(c_mktsegment) <> '' AND lower(c_mktsegment) <> 'building')
SELECT t AS "Text", '' AS "Replacement", 'dictionary' AS "Scope", CASE WHEN t = 'machinery' THEN 'Ignore: restorable' WHEN length(t) < 3 THEN 'Ignore: too short' END AS "Comment" FROM c""")
def dictionary_candidate_rows(spark, sf_dir):
    known = spark.createDataFrame([("machinery",)], "word_lc string")
    rows, config = spark.read.parquet(f"{sf_dir}/customer.parquet"), TableConfig("customer.csv", {}, {"c_mktsegment": ""})
    return dictionary_candidates(rows, config, False, known, mask_table(rows, "c_custkey", config, _TABLE)[0])


for _name in ("csv_template_customer", "csv_report"):
    SQL[_name] = SQL[_name].replace("{h}", str(_java_hash("building")))


_CSV = Csv([TableConfig("customer_*.csv", {"c_name": "n{c_custkey}"}, {"c_mktsegment": "", "c_phone": ""})])


def _folder(spark: SparkSession, sf_dir: str) -> FolderRun:
    """A run over the documents as text files and the customers as a CSV file for each nation."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("text is not null").select(F.col("doc_id").cast("string").alias("file"), "text")
    rows = spark.read.parquet(f"{sf_dir}/customer.parquet").groupBy("c_nationkey").agg(F.array_sort(F.collect_list(F.struct("c_custkey", "c_name", "c_mktsegment"))).alias("r"))
    cells = F.transform("r", lambda x: F.concat_ws(",", x["c_custkey"].cast("string"), x["c_name"], x["c_mktsegment"]))
    tables = rows.select(F.concat(F.lit("mail/customer_"), "c_nationkey", F.lit(".csv")).alias("file"), F.concat(F.lit("c_custkey,c_name,c_mktsegment\n"), F.array_join(cells, "\n")).alias("text"))
    none = F.lit(None).cast("string")
    files = docs.unionAll(tables).select(F.col("file").alias("path"), none.alias("zip_path"), "file", "text", none.alias("error"))
    return mask_files(files, GUARD, _instructions(spark), csv=_CSV, restorable=Guard({"machinery": ""}))


@query(f"""{_RUN}, texts AS (SELECT file, string_agg(line, chr(10) ORDER BY line_num) AS original, string_agg(coalesce(masked, line), chr(10) ORDER BY line_num) AS text FROM l LEFT JOIN masked USING (file, line_num) GROUP BY file)
SELECT file, text FROM texts WHERE text <> original
UNION ALL SELECT 'mail/customer_' || c_nationkey || '.csv', 'c_custkey,c_name,c_mktsegment' || chr(10) || string_agg(c_custkey || ',n' || c_custkey || ',' || c_mktsegment, chr(10) ORDER BY c_custkey) FROM customer GROUP BY c_nationkey""")
def folder_run_changed(spark, sf_dir):
    return _folder(spark, sf_dir).changed.select("file", "text")


@query(f"""{_RUN}, r AS ({_REPORT}) SELECT * FROM r
UNION ALL SELECT DISTINCT CAST(NULL AS BOOLEAN), 'csv:customer_*.csv:c_name', 'No guarded words found', 'mail/customer_' || c_nationkey || '.csv', 0, 'n{{c_custkey}}', 'CSV Column Template' FROM customer""")
def folder_run_report(spark, sf_dir):
    return _folder(spark, sf_dir).report


@query("""SELECT 'mail' AS "File", 'Guarded word: Value mail' AS "Message" UNION ALL SELECT DISTINCT 'mail/customer_' || c_nationkey || '.csv', 'Missing CSV columns: [c_phone]' FROM customer""")
def folder_run_errors(spark, sf_dir):
    return _folder(spark, sf_dir).errors


@query("""SELECT DISTINCT lower(c_mktsegment) AS "Text", '' AS "Replacement", 'dictionary' AS "Scope", CASE WHEN lower(c_mktsegment) = 'machinery' THEN 'Ignore: restorable' END AS "Comment" FROM customer""")
def folder_run_candidates(spark, sf_dir):
    return _folder(spark, sf_dir).candidates


_COUNTERS = {  # of the run over documents and customers, as scalar expressions
    "Read Files": "(SELECT count(*) FROM documents WHERE text IS NOT NULL) + n_csv",
    "Read Bytes": "(SELECT sum(length(line)) FROM l) + (SELECT sum(length(c_custkey || ',' || c_name || ',' || c_mktsegment)) FROM customer) + n_csv * length('c_custkey,c_name,c_mktsegment')",
    "Read Lines": "(SELECT count(*) FROM l) + (SELECT count(*) FROM customer) + n_csv",
    "Read Csv Files": "n_csv",
    "Read Zip Files": "0",
    "Changed Files": "(SELECT count(DISTINCT file) FROM masked JOIN l USING (file, line_num) WHERE masked <> line) + n_csv",
    "Changed Zip Files": "0",
    "Changed Csv Column Template Files": "n_csv",
    "Failed Files": "0",
    "File Errors": "1 + n_csv",
    "Words Matched": "(SELECT count(*) FROM k)",
    "Words Replaced": "(SELECT count(*) FROM p)",
    "Words Conflicts": "(SELECT count(*) FROM k WHERE NOT free AND NOT kept)",
    "Words Replacements Generated": "(SELECT count(*) FROM gen WHERE gt = '' OR gv <> gt)",
    "Words CSV Dictionary Candidate": "(SELECT count(DISTINCT lower(trim(c_mktsegment))) FROM customer WHERE trim(c_mktsegment) <> '')",
    "Report Lines - All": "(SELECT count(*) FROM r) + n_csv",
    "Report Lines - Allow": '(SELECT count(*) FROM r WHERE "Allow")',
    "Report Lines - Disallow": '(SELECT count(*) FROM r WHERE NOT "Allow")',
    "Report Lines - To Review": '(SELECT count(*) FROM r WHERE "Allow" IS NULL) + n_csv',
    "Restore Report Lines - Last": "(SELECT count(*) FROM b)",
    "Restore Report Lines - Cumulative": "(SELECT count(*) FROM b)",
}


@query(f"""{_RUN}, r AS ({_REPORT}), b AS (SELECT DISTINCT "Text", "Context", "File", "Line", "Replacement" FROM ({_BACK})), n AS (SELECT count(DISTINCT c_nationkey) AS n_csv FROM customer)
""" + "\nUNION ALL ".join(f"SELECT {_text(k)} AS name, CAST({v} AS BIGINT) AS value FROM n" for k, v in _COUNTERS.items()))
def folder_run_stats(spark, sf_dir):
    """All counters of a run over files."""
    return _folder(spark, sf_dir).stats


@query("""SELECT 'mail/customer_' || c_nationkey || '.csv' AS file, '''c_custkey'',''c_name'',''c_mktsegment''' || chr(10) || string_agg('''' || c_custkey || ''',''n' || c_custkey || ''',''' || c_mktsegment || '''', chr(10) ORDER BY c_custkey) AS text FROM customer GROUP BY c_nationkey""")
def csv_quoting_kept(spark, sf_dir):
    """CSV files that quote every cell, by a quote of their own, keep doing so."""
    cells = F.concat(F.lit("'"), F.concat_ws("','", F.col("c_custkey").cast("string"), "c_name", "c_mktsegment"), F.lit("'"))
    rows = spark.read.parquet(f"{sf_dir}/customer.parquet").groupBy("c_nationkey").agg(F.array_sort(F.collect_list(F.struct("c_custkey", cells.alias("r")))).alias("r"))
    text = F.concat(F.lit("'c_custkey','c_name','c_mktsegment'\n"), F.array_join(F.transform("r", lambda x: x["r"]), "\n"))
    name, none = F.concat(F.lit("mail/customer_"), "c_nationkey", F.lit(".csv")), F.lit(None).cast("string")
    files = rows.select(name.alias("path"), none.alias("zip_path"), name.alias("file"), text.alias("text"), none.alias("error"))
    return mask_files(files, Guard(), csv=Csv([TableConfig("customer_*.csv", {"c_name": "n{c_custkey}"})], quote="'")).changed.select("file", "text")


@query(r"""SELECT page_id, p AS path FROM (SELECT page_id, regexp_extract(url, '^[a-z]+://([^?#]*)', 1) AS p FROM pages)
WHERE regexp_matches(lower(p), '^(?:[^/]+/)*(?:en|fr)/[^/]*$') AND NOT regexp_matches(lower(p), '^www\.[^/]*/.*$')""")
def path_filter(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", F.regexp_extract("url", r"^[a-z]+://([^?#]*)", 1).alias("path"))
    return pages.where(path_guarded(F.col("path"), ["**/en/*", "**/FR/*"], ["www.*/**"]))


@query(f"WITH {_LINES} SELECT file, line_num, line FROM l WHERE NOT regexp_matches(file, '^[^/]*5$') AND file <> '17'")
def allow_file_skip(spark, sf_dir):
    told = typed(spark.createDataFrame([("true", "", "", "*5", "", "", ""), ("", "", "", "17", "", "", "plain name")], SCHEMA))
    return skipped_rows(_lines(spark, sf_dir), told)[0].select("file", "line_num", "line")


@query()
def file_scan_charset_zip(spark, sf_dir):
    """All documents written as a tree of files and archives in the shared folder and read back, one row each.

    About a quarter are entries of archives, and another quarter ISO-8859-1 where the text allows it and is not UTF-8
    as well; a null text becomes an empty file.
    """
    from cloakframe.runtime import discard
    from cloakframe.sources.files import decoded, read_files, write_files

    root = _tree(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    docs = docs.withColumn("part", F.pmod(F.xxhash64("text"), F.lit(4))).withColumn("n", F.monotonically_increasing_id())
    folder, name = F.floor(F.col("n") / 200).cast("string"), F.concat_ws("-", F.col("n").cast("string"), F.col("doc_id").cast("string"))
    plain, inside = F.concat(F.lit("text/"), folder, F.lit("/"), name, F.lit(".txt")), F.concat(F.lit("in/"), name, F.lit(".txt"))
    latin = F.col("text").rlike(r"^[\x{0}-\x{FF}]*\z") & F.col("text").rlike(r"[\x{C0}-\x{FF}](?![\x{80}-\x{BF}])")
    rows = docs.select(
        F.when(F.col("part") == 0, F.concat(F.lit("zip/"), folder, F.lit(".zip"))).otherwise(plain).alias("path"),
        F.when(F.col("part") == 0, inside).alias("zip_path"),
        "text",
        F.when((F.col("part") == 1) & latin, F.lit("iso-8859-1")).alias("charset"),
    )
    discard(write_files(rows, root))
    found = decoded(read_files(spark, root))
    doc_id = F.regexp_extract("file", r"/[0-9]+-(-?[0-9]+)\.txt$", 1)
    return found.select(
        F.when(doc_id != "", doc_id.cast("long")).alias("doc_id"), F.col("zip_path").isNotNull().alias("zipped"), F.length("text").cast("long").alias("n_chars"), F.sha2("text", 256).alias("text_sha256"), "error"
    )


def _tree(spark: SparkSession) -> str:
    import uuid

    from cloakframe.runtime import shared_dir
    from cloakframe.sources.files import local

    return f"{local(shared_dir(spark))}/tree-{uuid.uuid4().hex}"
