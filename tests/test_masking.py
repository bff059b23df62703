import hashlib

import pytest

from cloakframe.functions.text import chunks, context, path_regex, path_regex_column, word_hash
from cloakframe.operators.instructions import SCHEMA, typed
from cloakframe.operators.matching import Guard, lines
from cloakframe.plans.masking import cumulative, files, run, sort_report, stats
from cloakframe.plans.tables import TableConfig, dictionary_candidates, mask_table, missing_columns
from cloakframe.sources.files import csv_cells, decoded, quote_all, read_files, write_files
from pyspark.sql import functions as F

GUARD = Guard({"acme": ""}, {r"\w[\w.-]+@\w+(\.\w+)+": "u{hash}@mail.local"})
RESTORE = Guard({}, {r"w\d{3,}": ""})
FILE = "text/sample-text.txt"


def rows(spark, *texts):
    return spark.createDataFrame([(FILE, i + 1, t) for i, t in enumerate(texts)], "file string, line_num int, line string")


def told(spark, *given):
    return typed(spark.createDataFrame([tuple([*g, *[""] * (7 - len(g))]) for g in given], SCHEMA))


def masked(result):
    return [r.masked for r in result.lines.orderBy("line_num").collect()]


def test_unreviewed_word(spark):
    r = run(rows(spark, "Company: ACME"), GUARD)
    assert masked(r) == ["Company: w281027120"]
    assert [tuple(x) for x in sort_report(r.report).collect()] == [(None, "acme", "Company: ACME", FILE, 1, "w281027120", "Generated for Value acme")]
    assert [tuple(x) for x in r.generated.collect()] == [("acme", "w281027120")]


def test_wider_match_wins(spark):
    assert masked(run(rows(spark, "Company email: sales@acme.com"), GUARD)) == ["Company email: u125255358@mail.local"]


@pytest.mark.parametrize("given", [("true", "acme", "String acme"), ("true", "acme", "", "**/sample*.txt"), ("true", "acme", 'String acme = "MyCompany";', FILE, "1", "w281027120", "")])
def test_false_positive(spark, given):
    line = 'String acme = "MyCompany";'
    r = run(rows(spark, line), GUARD, told(spark, given))
    assert masked(r) == [line]
    assert [tuple(x) for x in r.report.collect()] == [(True, "acme", line, FILE, 1, None, "Allowed: Value acme, Suggested: w281027120")]


def test_restore_with_new_occurrences(spark):
    m = run(rows(spark, "Company: ACME", "Full name: Acme Corp"), GUARD)
    back = run(rows(spark, *masked(m), "New usage: w281027120", "Non-existing: w0123456789"), RESTORE, m.restore, restore=True)
    assert masked(back) == ["Company: ACME", "Full name: Acme Corp", "New usage: <<AMBIGUOUS:w281027120:ACME|Acme>>", "Non-existing: <<NO_RESTORE:w0123456789>>"]
    both = cumulative(m.restore, m.restore.withColumn("Comment", F.lit("x")))
    assert both.count() == 2 and {r.Comment for r in both.collect()} == {"Restore Value acme"}


def test_overruled_match_still_overrules(spark):
    guard = Guard({}, {"abcdefghij": "A", "ijklmnop": "B", "pqr": "C"})
    guard.patterns = {"ab cd ef": "A", "ef gh": "B", "gh i": "C"}
    assert masked(run(rows(spark, "ab cd ef gh i"), guard)) == ["A gh i"]


def test_lines_and_empty_inputs(spark):
    t = spark.createDataFrame([(1, "win\r\nlinux\nmac\rmixed empty\r\n\rwith EOL\n"), (2, ""), (3, None)], "id long, text string")
    assert [r.line for r in lines(t, "id", "text").orderBy("line_num").collect()] == ["win", "linux", "mac", "mixed empty", "", "with EOL", ""]
    r = run(rows(spark).limit(0), GUARD)
    assert r.lines.count() == r.report.count() == r.restore.count() == files(r).count() == 0
    assert {x.name: x.value for x in stats(r).collect()}["Words Matched"] == 0


def test_hash_and_context(spark):
    line = "0123456789 0123456789 acme 0123456789 0123456789"
    t = spark.createDataFrame([("acme", line, 22, 26), ("", "x" * 2000 + " acme", 2001, 2005), ("a", "acme", 0, 4)], "w string, l string, s int, e int").withColumn("c", F.expr(chunks("l")))
    r = t.select(word_hash(F.col("w")), F.expr(context("c", "length(l)", "s", "e"))).collect()
    assert [tuple(x) for x in r[:1]] == [(281027120, "..789 0123456789 acme 0123456789 012..")]  # the hash is a fixed value
    assert [x[1] for x in r[1:]] == [".." + "x" * 14 + " acme", "acme"] and r[1][0] == 0


@pytest.mark.parametrize("pattern, yes, no", [("**/*.txt", ["a.txt", "x/y/a.txt"], ["a.csv"]), ("src/*/x?", ["src/a/x1"], ["src/a/b/x1", "src/a/x"]), ("**/target/", ["target/", "a/target/"], ["target"]), ("src/**", ["src", "src/a/b"], ["srcs"]), ("a/**b", ["a/b", "a/xb"], ["a/x/b"]), ("**/a/**/b(1)", ["a/b(1)", "x/a/y/z/b(1)"], ["a/b1"])])
def test_path_patterns(spark, pattern, yes, no):
    import re

    assert all(re.match(path_regex(pattern), y) for y in yes) and not any(re.match(path_regex(pattern), n) for n in no)
    assert spark.range(1).select(path_regex_column(F.lit(pattern))).first()[0] == path_regex(pattern)


def test_table_template_and_candidates(spark):
    t = spark.createDataFrame([(10, "Batman", "VIP_BAT", "Favorite customer of Acme Corp"), (20, None, "w12345", "")], "Id int, Name string, Mnemonic string, Description string")
    c = TableConfig("customer.csv", {"Name": "n{Id}"}, {"Mnemonic": ""})
    out, _ = mask_table(t, "Id", c, GUARD)
    assert [tuple(r) for r in out.orderBy("Id").collect()] == [(10, "n10", "VIP_BAT", "Favorite customer of w281027120 Corp"), (20, "n20", "w12345", "")]
    found = dictionary_candidates(t, c, True, spark.createDataFrame([("w12345",)], "word_lc string"))
    assert [(r.Text, r.Scope, r.Comment) for r in found.collect()] == [("w12345", "dictionary", "Ignore: restorable"), ("vip_bat", "dictionary", None), ("batman", "template", None)]
    assert missing_columns(TableConfig("x", {"Nope": "n{Zip}"}), t.columns) == ["Missing CSV columns: ['Nope']", "Missing CSV columns: Zip"]


def test_files_archives_and_charsets(spark, tmp_path):
    import zipfile

    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "u.txt").write_bytes("tímido".encode())
    (tmp_path / "a" / "l.txt").write_bytes("tímido".encode("latin-1"))
    (tmp_path / "skip.bin").write_bytes(b"x")
    with zipfile.ZipFile(tmp_path / "z.dat", "w") as z:
        z.writestr("in/e.csv", 'id,name\n1,"Acme, Inc"\n')
    found = decoded(read_files(spark, str(tmp_path), ["**/", "**/*"], ["**/*.bin"]))
    got = {r.file: (r.text, r.error) for r in found.collect()}
    assert got["a/u.txt"] == ("tímido", None) and got["a/l.txt"] == ("tímido", "UTF-8 encoding incompatible") and set(got) == {"a/u.txt", "a/l.txt", "z.dat:in/e.csv"}
    cells = csv_cells(found.where("file like '%.csv'"))
    assert [(r.record_no, r.col_name, r.cell) for r in cells.orderBy("record_no", "col_idx").collect()] == [(0, "id", "id"), (0, "name", "name"), (1, "id", "1"), (1, "name", "Acme, Inc")]
    out = tmp_path / "out"
    new = found.where("file like 'z.dat%'").select("path", "zip_path", F.lit("new").alias("text"))
    assert write_files(new, str(out), str(tmp_path)).count() == 1
    assert zipfile.ZipFile(out / "z.dat").read("in/e.csv") == b"new"
    assert spark.range(1).select(quote_all(F.lit('"a","b"\n')), quote_all(F.lit("a\n")), quote_all(F.lit('# x\n"a"'), "#")).first() == (True, False, True)


def test_file_scan_gives_the_documents_table_back(spark, tmp_path):
    from cloakframe.plans.queries import file_scan_charset_zip

    rows = [(i, f"tímido {i}\r\nund schön\n" if i % 3 else f"plain {i} 日本" if i % 2 else f"ascii {i}") for i in range(300)]
    rows += [(300, None), (301, ""), (7, "tímido 7 again"), (7, "tímido 7 again"), (None, "no id"), (-5, "Ã©")]
    t = spark.createDataFrame(rows, "doc_id long, text string")
    t.write.parquet(str(tmp_path / "documents.parquet"))
    got = file_scan_charset_zip(spark, str(tmp_path)).collect()
    key = lambda r: (r[0] is None, r)
    want = [(i, len(x or ""), hashlib.sha256((x or "").encode()).hexdigest()) for i, x in rows]
    assert sorted(((r.doc_id, r.n_chars, r.text_sha256) for r in got), key=key) == sorted(want, key=key)
    assert {r.zipped for r in got} == {True, False} and {r.error for r in got} == {None, "UTF-8 encoding incompatible"}
