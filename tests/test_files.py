"""Quoting of CSV files by their own quote; tables of a run that are closed; folders and archives read and written by tasks."""

import hashlib
import io
import os
import zipfile

import pytest
from pyspark.sql import functions as F

from cloakframe.operators.matching import Guard
from cloakframe.plans.masking import run
from cloakframe.plans.runner import Csv, mask_files
from cloakframe.plans.tables import TableConfig
from cloakframe.runtime import shared_dir
from cloakframe.sources.files import _moved, decoded, is_empty, listing, pieces, quote_all, read_files, store, write_files
from tests.test_masking import rows


def test_the_quote_of_a_file_decides_about_quoting(spark):
    ask = [quote_all(F.lit("'a','b'\\n"), None, "'"), quote_all(F.lit("'a','b'\\n")), quote_all(F.lit('"a"'), None, "'"), quote_all(F.lit("# x\n'a'"), "#", "'")]
    assert spark.range(1).select(*[c.alias(str(i)) for i, c in enumerate(ask)]).first() == (True, False, False, True)


def test_fully_quoted_files_stay_so(spark):
    text = "'id','name'\n'1','Bat, man'\n'2','it''s acme'"
    files = spark.createDataFrame([("c.csv", None, "c.csv", text, None)], "path string, zip_path string, file string, text string, error string")
    done = mask_files(files, Guard({"acme": ""}), csv=Csv([TableConfig("c.csv", {})], quote="'")).changed.collect()
    assert [r.text for r in done] == ["'id','name'\n'1','Bat, man'\n'2','it''s w281027120'"]


def test_a_closed_run_leaves_no_tables(spark):
    r = run(rows(spark, "acme"), Guard({"acme": ""}))
    assert r.changed.count() == 1
    left = [t.stored.removeprefix("file://") for t in r.tables]
    assert all(map(os.path.isdir, left)) and all(p.startswith(shared_dir(spark).removeprefix("file://")) for p in left)
    r.close()
    assert not any(map(os.path.exists, left))


def tree(top):
    for i in range(4):
        for j in range(3):
            (top / f"a{i}" / f"b{j}" / "c").mkdir(parents=True)
            (top / f"a{i}" / f"b{j}" / "c" / f"{i}{j}.txt").write_text(f"{i}{j}")
            (top / f"a{i}" / f"x{j}.bin").write_text("no")
    (top / "a1" / "skip").mkdir()
    (top / "a1" / "skip" / "y.txt").write_text("no")
    os.symlink(top, top / "a2" / "loop")


def test_listing_spreads_over_rounds_and_equals_a_walk(spark, tmp_path):
    tree(tmp_path)
    want = {os.path.relpath(os.path.join(t, n), tmp_path) for t, _, names in os.walk(tmp_path) for n in names}
    want = {x for x in want if not x.endswith(".bin") and "/skip/" not in x}
    for budget in (1, 2, 256):
        got = listing(spark, str(tmp_path), ["**/", "**/*"], ["**/skip/", "**/*.bin"], budget)
        kinds = {k: {r.path for r in got.where(F.col("kind") == k).collect()} for k in ("file", "ignored file", "ignored folder", "error", "folder")}
        assert kinds["file"] == want and len(kinds["ignored file"]) == 12 and kinds["ignored folder"] == {"a1/skip/"} and not kinds["error"] | kinds["folder"]
        assert got.count() == len(want) + 13 and {r.size for r in got.where("kind = 'file'").collect()} == {2}


def test_archives_are_read_in_ranges(spark, tmp_path):
    inner = io.BytesIO()
    with zipfile.ZipFile(inner, "w") as z:
        z.writestr("n", "n")
    with zipfile.ZipFile(tmp_path / "z.dat", "w", zipfile.ZIP_DEFLATED) as z:
        for i in range(200):
            z.writestr(f"d{i % 3}/{i}.txt", f"text {i} " * (1 + i % 7))
        z.writestr("d0/inner.zip", inner.getvalue())
        z.mkdir("empty")
    with zipfile.ZipFile(tmp_path / "none.zip", "w") as z:
        z.mkdir("empty")
    (tmp_path / "broken.zip").write_bytes(b"PK\x03\x04 and no more")
    (tmp_path / "empty.txt").write_text("")
    found = listing(spark, str(tmp_path))
    cut = [r for r in pieces(found, str(tmp_path), span=1).where("path = 'z.dat'").orderBy("first").collect()]
    assert 32 <= len(cut) <= 65 and cut[0].first == 0 and cut[-1].last == 202 and all(a.last == b.first for a, b in zip(cut, cut[1:]))
    got = {r.file: r for r in decoded(read_files(spark, str(tmp_path), ["**/", "**/*"], ["d2/"])).collect()}
    assert {f for f in got if f.endswith(".txt") and ":" in f} == {f"z.dat:d{i % 3}/{i}.txt" for i in range(200) if i % 3 < 2}
    assert got["z.dat:d1/40.txt"].text == "text 40 " * 6 and got["z.dat:d0/inner.zip"].error == "archive inside an archive"
    assert got["broken.zip"].error.startswith("FAILED to process file broken.zip") and got["empty.txt"].text == "" and "none.zip" not in got


def test_one_broken_entry_leaves_the_others(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "z.zip", "w") as z:
        z.writestr("a.txt", "aaaa")
        z.writestr("b.txt", "bbbb")
    raw = (tmp_path / "z.zip").read_bytes().replace(b"aaaa", b"axaa")  # its checksum is wrong now
    (tmp_path / "z.zip").write_bytes(raw)
    got = {r.zip_path: r for r in read_files(spark, str(tmp_path)).collect()}
    assert got["b.txt"].content == b"bbbb" and got["a.txt"].content is None and "z.zip:a.txt" in got["a.txt"].error


WRITE = "path string, zip_path string, text string, charset string"


def test_files_are_complete_or_untouched(spark, tmp_path):
    (tmp_path / "t.txt").write_text("before")
    good = spark.createDataFrame([("t.txt", None, "after", None), ("n/u.txt", None, None, None)], WRITE)
    bad = good.unionAll(spark.createDataFrame([("v.txt", None, "€", "iso-8859-1")], WRITE))
    with pytest.raises(Exception, match="encode"):
        write_files(bad, str(tmp_path))
    assert sorted(os.listdir(tmp_path)) == ["t.txt"] and (tmp_path / "t.txt").read_text() == "before"
    assert {(r.path, r.entries) for r in write_files(good, str(tmp_path)).collect()} == {("t.txt", 1), ("n/u.txt", 1)}
    assert sorted(os.listdir(tmp_path)) == ["n", "t.txt"] and (tmp_path / "t.txt").read_text() == "after" and (tmp_path / "n" / "u.txt").read_text() == ""
    assert write_files(good.limit(0), str(tmp_path)).count() == 0


def test_a_move_that_is_tried_again(tmp_path):
    fs, top = store(str(tmp_path))
    (tmp_path / "s").write_text("new")
    for _ in range(2):
        _moved(fs, f"{top}/s", f"{top}/d/t")
    assert (tmp_path / "d" / "t").read_text() == "new"
    with pytest.raises(OSError):
        _moved(fs, f"{top}/s", f"{top}/d/u")


def test_archives_are_rewritten_member_by_member(spark, tmp_path):
    (tmp_path / "in").mkdir()
    with zipfile.ZipFile(tmp_path / "in" / "z.zip", "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("b.txt", "b" * 5000)
        z.writestr(zipfile.ZipInfo("stored.txt", (2001, 2, 3, 4, 5, 6)), "kept")
        z.writestr("a.txt", "a")
    rows = [("z.zip", "b.txt", "new b", None), ("z.zip", "z/more.txt", "more", None), ("y.zip", "k", "y", None), ("y.zip", "j", "y", None), ("same.txt", None, "one", None), ("same.txt", None, "two", None)]
    for _ in range(2):  # a second run gives the same
        write_files(spark.createDataFrame(rows, WRITE).repartition(4), str(tmp_path / "out"), str(tmp_path / "in"))
        with zipfile.ZipFile(tmp_path / "out" / "z.zip") as z:
            assert z.namelist() == ["b.txt", "stored.txt", "a.txt", "z/more.txt"] and [z.read(n) for n in z.namelist()] == [b"new b", b"kept", b"a", b"more"]
            assert z.getinfo("stored.txt").date_time == (2001, 2, 3, 4, 5, 6) and z.getinfo("stored.txt").compress_type == zipfile.ZIP_STORED and z.testzip() is None
        with zipfile.ZipFile(tmp_path / "out" / "y.zip") as z:
            assert z.namelist() == ["j", "k"]
        assert (tmp_path / "out" / "same.txt").read_text() == min("one", "two", key=lambda t: hashlib.md5(t.encode()).hexdigest())
        assert sorted(os.listdir(tmp_path / "out")) == ["same.txt", "y.zip", "z.zip"]


def test_stores():
    assert store("file:///a/b/")[1] == "/a/b" and store("/a/b")[1] == "/a/b" and is_empty("/no/such/folder")
