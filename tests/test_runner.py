import json
import zipfile

import pytest
from pyspark.sql import functions as F

from cloakframe.operators.instructions import read_instructions
from cloakframe.operators.matching import Guard, find, value_frames
from cloakframe.plans.masking import run, with_instructed
from cloakframe.plans.runner import run_folder
from cloakframe.sources.dictionaries import read_settings, word_set
from cloakframe.sources.files import _records, local
from tests.test_masking import FILE, masked, rows, told


def settings(tmp_path, direction="replace", folder="in", **more):
    s = {
        "scan": {"direction": direction, "target": str(tmp_path / "target")},
        "read": {"folder": str(tmp_path / folder)},
        "write": {"folder": "${scan.target}/" + direction},
        "csv": {"enabled": True, "commentMarker": "#", "dictionaryCandidate": "${scan.target}/candidates", "files": [{"filename": "cust*.csv", "columns": {"name": "n{id}", "gone": "x{zip}"}, "dictionary": {"code": ""}}]},
    }
    for d in ("replace", "restore"):
        s[d] = {k: "${scan.target}/" + f"{d}-{k}" for k in ("report", "restoreInstructionLast", "restoreInstructionCumulative", "generatedReplacement", "fileError")}
        s[d]["file"] = {"guard": {"values": ["**/", "**/*"]}, "ignore": {"values": ["**/skipped/", "**/*.bin"]}}
    s["replace"]["word"] = {"guard": {"values": {"Acme": "", "big deal": "p{hash}"}, "patterns": {r"[\w[\w.-]+@\w+(\.\w+)+]": "u{hash}@mail.local"}}}
    s["restore"]["instruction"] = {"files": ["${scan.target}/replace-restoreInstructionCumulative"]}
    s.update(more)
    (tmp_path / "settings.json").write_text(json.dumps(s))
    return str(tmp_path / "settings.json")


def make(tmp_path):
    (tmp_path / "in" / "acme").mkdir(parents=True)
    (tmp_path / "in" / "skipped").mkdir()
    (tmp_path / "in" / "skipped" / "s.txt").write_text("acme")
    (tmp_path / "in" / "x.bin").write_text("acme")
    (tmp_path / "in" / "acme" / "a.txt").write_text("By ACME for sales@acme.com,\na Big Deal\n")
    (tmp_path / "in" / "plain.txt").write_text("nothing here")
    (tmp_path / "in" / "latin.txt").write_bytes("Acmé and acme".encode("latin-1"))
    (tmp_path / "in" / "cust1.csv").write_text('# made by hand\n"id","name","code","note"\n"1","Bat, man","VIP_BAT","ask acme"\n"2","Acme\n# Inc","v1",""\n')
    with zipfile.ZipFile(tmp_path / "in" / "z.dat", "w") as z:
        z.writestr("d/e.txt", "acme")
        z.writestr("d/f.txt", "none")


def test_run_over_a_folder_and_back(spark, tmp_path):
    make(tmp_path)
    r = run_folder(spark, settings(tmp_path))
    out = tmp_path / "target" / "replace"
    assert (out / "acme" / "a.txt").read_text().splitlines()[1].startswith("a p") and "ACME" not in (out / "acme" / "a.txt").read_text()
    assert (out / "cust1.csv").read_text() == '"id","name","code","note"\n"1","n1","VIP_BAT","ask w281027120"\n"2","n2","v1",""'
    assert zipfile.ZipFile(out / "z.dat").read("d/e.txt") == b"w281027120" and zipfile.ZipFile(out / "z.dat").read("d/f.txt") == b"none"
    assert (out / "latin.txt").read_text() == "Acmé and w281027120" and not (out / "plain.txt").exists() and not (out / "skipped").exists()
    report = read_instructions(spark, [str(tmp_path / "target" / "replace-report")])
    kinds = {(x.Text, x.File, x.Line): x for x in report.collect()}
    assert kinds["csv:cust*.csv:name,gone", "cust1.csv", 0].Context == "name:Acme\n# Inc"
    assert kinds["acme", "cust1.csv", 1].Context == "note:ask acme" and kinds["big deal", "acme/a.txt", 2].Comment == "Generated for Value big deal"
    errors = {(x[0], x[1]) for x in spark.read.csv(str(tmp_path / "target" / "replace-fileError"), header=True).collect()}
    assert errors == {("acme", "Guarded word: Value acme"), ("latin.txt", "UTF-8 encoding incompatible"), ("cust1.csv", "Missing CSV columns: [gone]")}
    got = {x.name: x.value for x in r.stats.collect()}
    assert got["Ignored Folders"] == 1 and got["Ignored Files"] == 1 and got["Changed Files"] == 4 and got["Changed Zip Files"] == got["Read Zip Files"] == 1 and got["File Errors"] == 3
    assert [(x.Text, x.Scope, x.Comment) for x in r.candidates.collect()] == [("v1", "dictionary", "Ignore: too short"), ("vip_bat", "dictionary", None)]
    back = run_folder(spark, settings(tmp_path, "restore", "target/replace"))
    again = tmp_path / "target" / "restore"
    assert (again / "acme" / "a.txt").read_text() == (tmp_path / "in" / "acme" / "a.txt").read_text()
    assert (again / "latin.txt").read_text() == "Acmé and acme" and zipfile.ZipFile(again / "z.dat").read("d/e.txt") == b"acme"
    assert '"1","n1","VIP_BAT","ask acme"' in (again / "cust1.csv").read_text() and back.candidates is None  # templates are not undone


def test_allowed_csv_file_and_inplace(spark, tmp_path):
    make(tmp_path)
    (tmp_path / "told.csv").write_text('Text,Allow\n"csv:cust*.csv:name,gone",yes\n')
    path = settings(tmp_path)
    s = json.loads((tmp_path / "settings.json").read_text())
    s["replace"]["instruction"], s["write"] = {"files": [str(tmp_path / "told.csv"), "no such file"]}, {"inplace": True}
    (tmp_path / "settings.json").write_text(json.dumps(s))
    r = run_folder(spark, path)
    assert (tmp_path / "in" / "cust1.csv").read_text().splitlines()[1] == '"1","Bat, man","VIP_BAT","ask w281027120"'
    assert {(x.Text, x.Scope) for x in r.candidates.collect()} == {("bat, man", "template"), ("acme\n# inc", "template"), ("vip_bat", "dictionary"), ("v1", "dictionary")}


def test_empty_folder_and_broken_settings(spark, tmp_path):
    (tmp_path / "in").mkdir()
    r = run_folder(spark, settings(tmp_path))
    assert r.changed.count() == r.report.count() == r.errors.count() == 0 and (tmp_path / "target" / "replace-report").is_dir()
    with pytest.raises(ValueError):
        run_folder(spark, settings(tmp_path, "sideways"))
    with pytest.raises(KeyError):
        read_settings(settings(tmp_path, read={"folder": "${no.such}"}))
    with pytest.raises(ValueError):
        local("hdfs://host/x")
    with pytest.raises(NotADirectoryError):
        run_folder(spark, settings(tmp_path, folder="nowhere"))


def test_settings_import(tmp_path):
    (tmp_path / "own.json").write_text('{"read": {"threads": 3}, "write": {"folder": "${scan.target:out}/x"}}')
    (tmp_path / "s.json").write_text('{"spring": {"config": {"import": ["own.json", "optional:none.json"]}}, "read": {"threads": 1, "folder": "f"}}')
    s = read_settings(str(tmp_path / "s.json"))
    assert s["read"] == {"threads": 3, "folder": "f"} and s["write"]["folder"] == "out/x"
    (tmp_path / "set.csv").write_text("#tag,x\nword\n")
    assert word_set(str(tmp_path / "set.csv")) == ["#tag", "word"]


def test_instructions_by_header(spark, tmp_path):
    (tmp_path / "i.csv").write_text('Text,Note,Allow, Replacement\n" ACME ",zzz,yes,\nx,,0,"a ""b"""\n')
    got = [tuple(r)[:7] for r in read_instructions(spark, [str(tmp_path / "i.csv")]).orderBy("Text").collect()]
    assert got == [(True, "ACME", "", "", None, "", ""), (False, "x", "", "", None, 'a "b"', "")]


def test_phrases_of_instructions(spark):
    words = with_instructed(value_frames(spark, Guard({"a a": "", "***": "stars"})), told(spark, ("", "sales@acme.com", "", "", "", "S", "")))
    t = rows(spark, "a a a a a", "x *** y a**", "to sales@acme.com.au and sales@acme.com!", "sales@acme.comx")
    got = [(r.line_num, r.start, r.word_lc, r.template) for r in find(t, Guard(), words).orderBy("line_num", "start").collect()]
    assert got == [(1, 0, "a a", ""), (1, 4, "a a", ""), (2, 2, "***", "stars"), (3, 3, "sales@acme.com", "S"), (3, 25, "sales@acme.com", "S")]


def test_many_terms_meet_tokens_without_a_broadcast(spark, monkeypatch):
    from cloakframe.operators import matching

    t = rows(spark, "Acme and big deal with acme", "none", "x@y.zz")
    guard = Guard({"acme": "", "big deal": "p"}, {r"\w@\w\.\w+": "m"}, {"none"})
    want = find(t, guard).orderBy("line_num", "start").collect()
    monkeypatch.setattr(matching, "SMALL", 0)
    assert find(t, guard).orderBy("line_num", "start").collect() == want and len(want) == 4


def test_long_lines(spark):
    import time

    text = lambda n: " ".join(f"acme{i % 7} acme" for i in range(n // 2))
    took = {}
    for n in (4_000, 32_000):
        t = rows(spark, text(n)).cache()
        t.count()
        began = time.time()
        out = run(t, Guard({"acme": ""}))
        assert out.matches.count() == n // 2 and out.changed.select(F.length("masked")).first()[0] == len(text(n)) + n // 2 * 6
        took[n] = time.time() - began
    assert took[32_000] < 8 * took[4_000] + 10


def test_comment_lines_only_where_records_begin():
    assert list(_records('#x\na,b\n"c\n#d",e\n#f\n\ng,h', ",", '"', "#")) == [["a", "b"], ["c\n#d", "e"], ["g", "h"]]


def test_template_default_and_escape(spark):
    assert masked(run(rows(spark, "acme"), Guard({"acme": "${hash}-{hash:-x}-{y:-z}-{y}"}))) == ["{hash}-281027120-z-{y}"] and FILE


def test_stream_equals_table(spark, tmp_path):
    from cloakframe.streaming.masking import mask_stream

    for i in range(3):
        rows(spark, f"acme {i}", "none").withColumn("file", F.lit(f"f{i}")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("file string, line_num int, line string").option("maxFilesPerTrigger", 2).parquet(str(tmp_path / "in"))
    mask_stream(stream, Guard({"acme": ""}), str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out" / "lines")).select("file", "line_num", "masked").collect()
    assert sorted(map(tuple, got)) == sorted([(f"f{i}", 1, f"w281027120 {i}") for i in range(3)] + [(f"f{i}", 2, "none") for i in range(3)])
    assert spark.read.parquet(str(tmp_path / "out" / "restore")).count() == 3
