"""Terms, patterns and instructions in bulk against plain searches, and in long lines."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from cloakframe.functions.literals import required_literal
from cloakframe.operators import matching
from cloakframe.operators.instructions import SCHEMA, decided, typed
from cloakframe.operators.matching import Guard, find
from cloakframe.plans.queries import QUERIES
from tests.test_masking import rows


def plain_values(lines, values):
    """Whole-word occurrences of values by searching from left to right, each from where the last one ended."""
    out = []
    for n, line in enumerate(lines):
        low = line.lower()
        for v in values:
            at = low.find(v)
            while at >= 0:
                end = at + len(v)
                if not (at and line[at - 1].isalnum()) and not line[end : end + 1].isalnum():
                    out.append((n + 1, at, end, v))
                at = low.find(v, end)
    return sorted(out)


def found(df):
    return sorted((r.line_num, r.start, r.end, r.word_lc) for r in df.collect())


def texts(seed, n=60):
    r = random.Random(seed)
    return ["".join(r.choice(["a", "b", "A", " ", " ", "-", "*", "x1", ". "]) for _ in range(r.randint(0, 40))) for _ in range(n)]


VALUES = ["a", "b", "a a", "a b", "a-b", "a b a", "-a", "a*", "**", "***", "*", "- -", "x1 a", "a a a", "ab", "b. a", ". ", " a", "x1x1", "-"]


@pytest.mark.parametrize("small", [5_000, 0])
def test_terms_are_those_of_a_plain_search(spark, monkeypatch, small):
    monkeypatch.setattr(matching, "SMALL", small)
    lines = texts(1) + ["xa a a", "a aa a a", "A A A", "*****", "a"]
    values = [v for v in VALUES if v.strip()]
    words = [v for v in values if v.isalnum()]
    got = found(find(rows(spark, *lines), Guard(dict.fromkeys(values, ""))))
    assert got == plain_values(lines, values) and len(got) > 100 and words


def test_sixteen_thousand_phrases_in_a_line(spark):
    for phrase, line in (("big deal", "Big Deal, " * 16_000), ("a a", "a " * 32_000)):
        t = rows(spark, line).cache()
        t.count()
        began = time.time()
        out = find(t, Guard({phrase: ""})).agg(F.count("*"), F.max("end")).first()
        assert out[0] == 16_000 and time.time() - began < 25
        assert out[1] == line.rstrip(", ").__len__()


def test_phrases_that_begin_alike(spark):
    n = 30_000
    words = spark.range(n).select(F.concat(F.lit("the very same beginning "), F.col("id").cast("string")).alias("word_lc"), F.lit("").alias("template"))
    lines = [f"so The very same beginning {i} of {i}" for i in (0, 7, n - 1, n)] * 50
    began = time.time()
    df = find(rows(spark, *lines), Guard(), words)
    got = df.collect()
    assert len(got) == 150 and {r.word_lc[-5:] for r in got} == {"ing 0", "ing 7", "29999"} and time.time() - began < 60
    plan = df._jdf.queryExecution().analyzed().toString()
    assert "ResolvedHint" not in plan  # Spark chooses how terms travel


def test_many_patterns_are_data(spark):
    r = random.Random(3)
    names = ["".join(r.choice("abcdefgh") for _ in range(6)) for _ in range(5_000)]
    patterns = {rf"{w}\d+": "p" for w in names} | {rf"(?:{w}|zz)[xy]+": "" for w in names[:3]} | {r"\bq{2}": "q"}
    lines = [f"{r.choice(names)}{i} and {names[1]}y, qq {r.choice(names)} zzx" for i in range(80)]
    want = []
    for n, line in enumerate(lines):
        for p in patterns:
            for m in re.finditer(p, line):
                s, e = m.span()
                if not (s and line[s - 1].isalnum()) and not line[e : e + 1].isalnum():
                    want.append((n + 1, s, e, f"Pattern {p}"))
    began = time.time()
    df = find(rows(spark, *lines), Guard({}, patterns))
    df._jdf.queryExecution().executedPlan()
    assert time.time() - began < 10
    got = sorted((x.line_num, x.start, x.end, x.reason) for x in df.collect())
    # of the alternatives with one span those after the first that has a template count no more
    first = {}
    order = {f"Pattern {p}": i for i, p in enumerate(patterns)}
    for x in sorted(want, key=lambda x: order[x[3]]):
        if not any(patterns[y[8:]] for y in first.get(x[:3], [])):
            first.setdefault(x[:3], []).append(x[3])
    assert got == sorted((*k, y) for k, v in first.items() for y in v) and len(got) > 200


def shuffled(spark):
    return spark.sparkContext._jsc.sc().statusStore().executorSummary("driver").totalShuffleWrite()


def test_lines_do_not_travel_for_patterns_that_they_may_hold(spark):
    r = random.Random(5)
    names = sorted({"".join(r.choice("abcdefgh") for _ in range(5)) for _ in range(60)})
    patterns = {rf"{w}\s+x\w*": "p" for w in names} | {r"qq\s+x": "p"}
    lines = [" ".join(r.choice(names) + r.choice("0123456789") for _ in range(600)) for _ in range(200)]
    lines[7] += f" {names[3]}  xyz, {names[3]} x qq x"
    df = find(rows(spark, *lines), Guard({"acme": ""}, patterns))
    before = shuffled(spark)
    got = sorted((x.line_num, x.word_lc) for x in df.collect())
    time.sleep(1)  # the counters follow the tasks
    assert got == [(8, f"{names[3]}  xyz"), (8, f"{names[3]} x"), (8, "qq x")]
    assert shuffled(spark) - before < sum(map(len, lines)) / 4


def test_tokens_and_lines_without_terms_do_not_travel(spark, monkeypatch):
    monkeypatch.setattr(matching, "SMALL", 0)
    r = random.Random(6)
    lines = [" ".join("".join(r.choice("abcdefgh") for _ in range(5)) for _ in range(600)) for _ in range(200)]
    lines[7] += " zebra cross, Zebra 12 x@y.io"
    df = find(rows(spark, *lines), Guard(dict.fromkeys(["zebra", "zebra cross", "12", "none such"], ""), {r"\w+@\w+\.io": ""}))
    before = shuffled(spark)
    got = sorted((x.line_num, x.word_lc) for x in df.collect())
    time.sleep(1)
    assert got == [(8, "12"), (8, "x@y.io"), (8, "zebra"), (8, "zebra"), (8, "zebra cross")]
    assert shuffled(spark) - before < sum(map(len, lines)) / 4


def test_patterns_are_tried_where_their_literal_stands(spark):
    began = time.time()
    got = find(rows(spark, "x" * 400_000, "Ask me@acme.org now", "no at"), Guard({}, {r"\w[\w.-]+@\w+(\.\w+)+": "u"})).collect()
    assert [(x.line_num, x.word_lc) for x in got] == [(2, "me@acme.org")] and time.time() - began < 60  # as many steps as pairs of letters before


def test_runs_of_tokens_are_made_in_lines_that_may_have_a_first_token(spark, monkeypatch):
    monkeypatch.setattr(matching, "SMALL", 0)
    made = matching._token_hits
    monkeypatch.setattr(matching, "_token_hits", lambda ks, firsts: made(ks, firsts).replace("lower(x.word)", "if(lower(x.word) = 'w7', raise_error('a run of tokens is made'), lower(x.word))"))
    lines = [" ".join(f"{c}{i}" for i in range(300)) for c in "vwxyz"] + ["ΑΣ.α, İ zebra, Zebra  12 u12@mail.local u12@mail", "CROSS zebra u12"]
    guard = Guard(dict.fromkeys(["zebra", "zebra  12", "u12@mail.local", "ας", "none such"], ""), {r"u\d+@\w+$": ""})
    got = sorted((x.line_num, x.word_lc) for x in find(rows(spark, *lines), guard).collect())
    assert got == [(6, "u12@mail"), (6, "u12@mail.local"), (6, "zebra"), (6, "zebra"), (6, "zebra  12"), (6, "ας"), (7, "zebra")]


@pytest.mark.parametrize("small", [matching.SMALL, 8])
def test_a_round_trip_moves_changed_lines_only(spark, monkeypatch, tmp_path, small):
    monkeypatch.setattr(matching, "SMALL", small)  # 8: few terms mask, many restore
    r = random.Random(8)
    lines = [" ".join("".join(r.choice("abcdefgh") for _ in range(6)) for _ in range(300)) for _ in range(1000)]
    for i in range(0, 1000, 50):
        lines[i] += f" trash m{i}@x.org 10.2.3.{i % 256} idiot, cc by-nc" + " Moron" * (i % 100 == 0)
    lines[7], lines[9], lines[11] = lines[7] + " moron", lines[9] + " MORON!", lines[11] + " moron1"
    docs = [(i, "\r\n".join(lines[i : i + 10])) for i in range(0, 1000, 10)]
    spark.createDataFrame(docs, "doc_id long, text string").repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    before, join = shuffled(spark), "spark.sql.autoBroadcastJoinThreshold"
    was = spark.conf.get(join)
    spark.conf.set(join, "-1")  # as with large tables: the changed lines are not sent to every task
    try:
        got = QUERIES["restore_roundtrip"](spark, str(tmp_path)).collect()
    finally:
        spark.conf.set(join, was)
    time.sleep(1)
    want = sorted((str(i // 10 * 10), i % 10 + 1, x, "moron") for i, x in enumerate(lines) if re.search(r"\bmoron\b", x.lower()))
    assert sorted(map(tuple, got)) == want and len(want) == 12
    assert shuffled(spark) - before < sum(map(len, lines)) / 2


@pytest.mark.parametrize("pattern, literal", [
    (r"acme\d+", "acme"), (r"\w[\w.-]+@\w+(\.\w+)+", None), (r"ab|cdef", None), (r"abc?def", "def"), (r"abc+def", "abc"), (r"x(abcd)yzw", "yzw"), (r"a\.b\.c", "a.b.c"), (r"[abc]{3}hello{2}", "hell"),
    (r"(?i)abcd", None), (r"\Qabcd\E", None), (r"abcdAxyz", "abcdAxyz"), (r"^start.end$", "start"), (r"abcd{0,2}ef", "abc"), (r"", None), (r"[^]a]bcd[[x]y]efgh", "efgh"), (r"(?si)abcd", None),
])
def test_required_literals(pattern, literal):
    assert required_literal(pattern) == literal


def test_places_in_lines_that_grow_in_lower_case(spark):
    guard = Guard({"acme": "", "acme corp": "C"}, {r"\w[\w.-]+@\w+(\.\w+)+": "u"})
    got = [(r.line_num, r.start, r.end, r.word) for r in find(rows(spark, "İİİİ acme corp", "İ mail sales@acme.com now", "xİ acme"), guard).orderBy("line_num", "start", "end").collect()]
    assert got == [(1, 5, 9, "acme"), (1, 5, 14, "acme corp"), (2, 7, 21, "sales@acme.com"), (2, 13, 17, "acme"), (3, 3, 7, "acme")]


def plain_decision(m, told, least):
    """The instruction that fits a match best, by trying all."""
    fits = []
    for allow, text, ctx, file, line, put, comment in told:
        c, t = ctx.lower(), m["context"].lower()
        near = not c or c == t or (len(t) > len(c) >= len(m["word_lc"]) + least and c in t and m["word_lc"] in c)
        rx = "^" + re.escape(file).replace(r"\*\*/", "(?:[^/]+/)*").replace(r"\*", "[^/]*") + "$"
        if text.lower() == m["word_lc"] and near and (not file or file == m["file"] or re.match(rx, m["file"])):
            exact = 0 if file and line and int(line) == m["line_num"] else 1
            rank = {"": 2, "true": 1, "false": 0}[allow]
            fits.append(((exact, -len(ctx), -len(file), rank, put, comment), (None if rank == 2 else rank == 1, put, comment)))
    return min(fits)[1] if fits else (None, None, None)


@pytest.mark.parametrize("least", [1, 4])
def test_decisions_are_those_of_all_instructions(spark, least):
    r = random.Random(least)
    ctx = ["", "", "the acme of", "acme", "acme acme", "e acme", "acme o", "xacmey", "say acme", "none here", "The ACME of it", "bb", "b b"]
    told = [(r.choice(["", "true", "false"]), r.choice(["acme", "ACME", "b", ""]), r.choice(ctx), r.choice(["", "a/f.txt", "a\\f.txt", "**/*.txt", "a/*", "g"]), r.choice(["", "1", "2", "3"]), r.choice(["", "P", "Q"]), r.choice(["", "c"])) for _ in range(150)]
    matches = [(r.choice(["a/f.txt", "g", "x/y.txt"]), r.randint(1, 4), 0, i, i + 4, r.choice(["acme", "b"]), r.choice(["The acme of it", "acme", "say acme acme", "b b b", "b", "xacmey", "No guarded words found"]), 0) for i in range(80)]
    m = spark.createDataFrame(matches, "file string, line_num int, part int, start int, end int, word_lc string, context string, src int")
    got = {x.start: (x.i_allow, x.i_replacement, x.i_comment) for x in decided(m, typed(spark.createDataFrame(told, SCHEMA)), least).collect()}
    norm = [(*t[:3], t[3].replace("\\", "/"), *t[4:]) for t in told]
    for x in m.collect():
        assert got[x.start] == plain_decision(x.asDict(), norm, least), x


def test_a_hot_word_with_many_instructions(spark):
    n = 100_000
    told = spark.range(n).select(F.lit(None).cast("boolean").alias("Allow"), F.lit("acme").alias("Text"), F.concat(F.lit("acme "), F.col("id").cast("string")).alias("Context"), F.lit("").alias("File"), F.lit(None).cast("int").alias("Line"), F.concat(F.lit("r"), F.col("id").cast("string")).alias("Replacement"), F.lit("").alias("Comment"))
    m = spark.range(20_000).select(F.lit("f").alias("file"), F.col("id").cast("int").alias("line_num"), F.lit(0).alias("part"), F.lit(0).alias("start"), F.lit(4).alias("end"), F.lit("acme").alias("word_lc"), F.concat(F.lit("an Acme "), F.col("id").cast("string"), F.lit(" or")).alias("context"), F.lit(0).alias("src"))
    began = time.time()
    got = decided(m, told).selectExpr("count_if(i_replacement = concat('r', line_num))", "count(*)").first()
    assert tuple(got) == (20_000, 20_000) and time.time() - began < 60  # the product would be two thousand million pairs
