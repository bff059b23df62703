"""Folders of text and CSV files and ZIP archives as DataFrames, and back.

The folder is one that all executors see: a shared mount, or a store with a scheme that pyarrow.fs knows (hdfs, s3, gs).
Folders are listed, archives cut into ranges of entries, and bytes read and written by tasks; paths stay in tables.
"""

from __future__ import annotations

import copy
import csv
import hashlib
import io
import os
import re
import shutil
import uuid
import zipfile
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cloakframe.functions.text import path_regex
from cloakframe.runtime import discard, ship, written

FILE_SCHEMA = "path string, zip_path string, file string, content binary, error string"
LISTED = "path string, size long, kind string, error string"
PIECE = "path string, size long, first int, last int, error string"
ARCHIVE = b"PK\x03\x04"
SPAN = 32 << 20  # bytes of an archive's entries that one row of work reads


def _filter(guard: list[str], ignore: list[str]) -> Callable[[str], bool]:
    """Does a relative path (of a folder: with a slash at its end) pass? Patterns are compiled once."""
    made = lambda ps: [(p.replace("\\", "/").endswith("/"), re.compile(path_regex(p.lower()))) for p in ps]
    good, bad = made(guard), made(ignore)

    def fits(name: str) -> bool:
        name = name.replace("\\", "/").lower()
        some = lambda rxs: any(rx.match(name) for folder, rx in rxs if folder == name.endswith("/"))
        return some(good) and not some(bad)

    return fits


def local(folder: str) -> str:
    """A folder of a mount as a path to open(); one of another store is refused, not taken for a relative path."""
    scheme, colon, rest = folder.partition("://")
    if colon and scheme != "file":
        raise ValueError(f"{folder}: not on a mount but in {scheme}")
    return rest if colon else folder.removeprefix("file:")


def store(folder: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a folder and the folder's path in it."""
    scheme, colon, rest = folder.partition("://")
    if not colon or scheme == "file":
        return pafs.LocalFileSystem(), os.path.abspath(local(folder))
    fs, path = pafs.FileSystem.from_uri(f"{ {'s3a': 's3', 's3n': 's3'}.get(scheme, scheme) }://{rest}")
    return fs, path.rstrip("/")


def _reading(fs: pafs.FileSystem, path: str):
    return open(path, "rb") if isinstance(fs, pafs.LocalFileSystem) else fs.open_input_file(path)


def _writing(fs: pafs.FileSystem, path: str):
    return open(path, "wb") if isinstance(fs, pafs.LocalFileSystem) else fs.open_output_stream(path)


def _children(fs: pafs.FileSystem, folder: str) -> Iterator[tuple[str, bool, int]]:
    """name, is it a folder, and size of all in a folder; links to folders are neither followed nor files."""
    if isinstance(fs, pafs.LocalFileSystem):
        with os.scandir(folder) as found:
            for e in found:
                if e.is_dir(follow_symlinks=False):
                    yield e.name, True, 0
                elif e.is_file():
                    yield e.name, False, e.stat().st_size
    else:
        for e in fs.get_file_info(pafs.FileSelector(folder)):
            yield e.base_name, e.type == pafs.FileType.Directory, e.size or 0


def is_empty(folder: str) -> bool:
    """Is there no such folder, or nothing in it?"""
    fs, path = store(folder)
    return fs.get_file_info(path).type != pafs.FileType.Directory or next(_children(fs, path), None) is None


def _tables(rows: Iterator[tuple], schema: pa.Schema, many: int = 4096, size: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Rows as batches of at most many rows, each ended by the row that makes its bytes reach size."""
    some, held = [], 0

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*some), schema)], schema=schema)

    for r in rows:
        some.append(r)
        held += sum(len(x) for x in r if isinstance(x, (bytes, str)))
        if len(some) >= many or held >= size:
            yield batch()
            some, held = [], 0
    if some:
        yield batch()


_ARROW = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}


def _mapped(rows: DataFrame, made: Callable[[tuple], Iterator[tuple]], schema: str) -> DataFrame:
    """The rows that made gives for each row, in tasks; small batches, so that no task holds many contents."""
    fields = pa.schema([(n, _ARROW[t]) for n, t in (f.split() for f in schema.split(", "))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _tables((out for b in batches for row in zip(*(c.to_pylist() for c in b.columns)) for out in made(row)), fields)

    return rows.mapInArrow(run, schema)


def listing(spark: SparkSession, root: str, guard: list[str] = ("**/", "**/*"), ignore: list[str] = (), budget: int = 256) -> DataFrame:
    """path (relative), size, kind and error of all below root, as a written table.

    kind is file (its folders and it pass the filters), ignored file, ignored folder or error (a folder that cannot be
    listed, a name that is no Unicode text). A task lists the folders below its own, up to budget of them; those that
    are then left go to the next round, dealt anew over all tasks. So a small tree takes one round and a large one
    spreads; no list of paths goes through the driver, which only counts what is left.
    """
    ship(spark)
    fs, top = store(root)
    if fs.get_file_info(top).type != pafs.FileType.Directory:
        raise NotADirectoryError(root)
    guard, ignore = list(guard), list(ignore)

    def below(row: tuple) -> Iterator[tuple]:
        fs, top = store(root)
        fits, todo, left = _filter(guard, ignore), [row[0]], budget
        while todo:
            at = todo.pop()
            if not left:
                yield at, 0, "folder", None
                continue
            left -= 1
            try:
                for name, folder, size in _children(fs, f"{top}/{at}"):
                    path = f"{at}{name}/" if folder else at + name
                    try:
                        path.encode()
                    except UnicodeEncodeError:
                        yield path.encode("utf-8", "replace").decode(), size, "error", "its name is no Unicode text"
                        continue
                    if not fits(path):
                        yield path, size, "ignored folder" if folder else "ignored file", None
                    elif folder:
                        todo.append(path)
                    else:
                        yield path, size, "file", None
            except OSError as x:
                yield at, 0, "error", str(x)

    rounds, todo, open_ = [], spark.createDataFrame([("",)], "path string").coalesce(1), 1
    while open_:
        rounds.append(written(_mapped(todo, below, LISTED), "listing"))
        todo = rounds[-1].where("kind = 'folder'").select("path")
        open_ = todo.count()
        todo = todo.repartition(max(1, min(open_, 4 * spark.sparkContext.defaultParallelism)))
    if len(rounds) == 1:
        return rounds[0]
    paths = [r.stored for r in rounds]
    out = written(spark.read.schema(rounds[0].schema).parquet(*paths).where("kind <> 'folder'"), "listing", few=True)
    discard(*rounds)
    return out


def pieces(found: DataFrame, root: str, guard: list[str] = ("**/", "**/*"), ignore: list[str] = (), span: int = SPAN) -> DataFrame:
    """The work that reading the files of a listing is, one row each: a file, or a range of an archive's entries.

    first and last (exclusive) are places in the archive's directory. A range ends where its entries reach span bytes,
    or a 64th of the archive if that is more: each range reads the directory again.
    """
    ship(found.sparkSession)

    def cut(row: tuple) -> Iterator[tuple]:
        path, size, error = row
        if error is not None:
            yield path, size, None, None, error
            return
        try:
            fs, top = store(root)
            with _reading(fs, f"{top}/{path}") as f:
                if f.read(4) != ARCHIVE:
                    yield path, size, None, None, None
                    return
                f.seek(0)
                with zipfile.ZipFile(f) as z:
                    sizes = [e.file_size for e in z.infolist()]
            limit, first, held = max(span, sum(sizes) // 64), 0, 0
            for i, n in enumerate(sizes):
                held += n
                if held >= limit or i + 1 == len(sizes):
                    yield path, held, first, i + 1, None
                    first, held = i + 1, 0
        except Exception as x:  # one bad file must not end the run: it becomes an error row
            yield path, size, None, None, str(x)

    return _mapped(found.where("kind in ('file', 'error')").select("path", "size", "error"), cut, PIECE)


def read_files(spark: SparkSession, root: str, guard: list[str] = ("**/", "**/*"), ignore: list[str] = (), skipped: dict[str, int] | None = None) -> DataFrame:
    """path, zip_path, file (reported path), content and error of each file; archives give a row per entry.

    An archive is known by its first bytes, not by its name; its entries are read by several tasks, one at a time. An
    archive inside an archive stays as it is, with an error row; what cannot be read gives an error too. skipped gets
    the numbers of files and folders that do not pass the filters. The table .stored of the result holds the work to do;
    discard() it when the result has been read.
    """
    guard, ignore = list(guard), list(ignore)
    found = listing(spark, root, guard, ignore)
    cores = 4 * spark.sparkContext.defaultParallelism
    n = {r.kind: (r["n"], r.bytes) for r in found.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes")).collect()}  # four kinds
    if skipped is not None:
        skipped.update(files=n.get("ignored file", (0,))[0], folders=n.get("ignored folder", (0,))[0])
    tasks = lambda rows, size: max(1, min(rows, cores), rows // 2048, size // (64 << 20))
    rows, size = n.get("file", (0, 0))
    todo = written(pieces(found.repartition(tasks(rows, 0)), root, guard, ignore), "pieces")
    rows, size = todo.agg(F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0))).first()

    def read(row: tuple) -> Iterator[tuple]:
        path, _, first, last, error = row
        failed = lambda file, x, inside=None: (path, inside, file, None, f"FAILED to process file {file}: {x}")
        if error is not None:
            yield failed(path, error)
            return
        try:
            fs, top = store(root)
            with _reading(fs, f"{top}/{path}") as f:
                if first is None:
                    yield path, None, path, f.read(), None
                    return
                fits = _filter(guard, ignore)
                with zipfile.ZipFile(f) as z:
                    for e in z.infolist()[first:last]:
                        parts = e.filename.split("/")
                        folders = ["/".join(parts[:i]) + "/" for i in range(1, len(parts))]
                        if e.is_dir() or not all(map(fits, [*folders, e.filename])):
                            continue
                        file = f"{path}:{e.filename}"
                        try:
                            data = z.read(e)
                        except Exception as x:  # the other entries are read all the same
                            yield failed(file, x, e.filename)
                            continue
                        nested = data[:4] == ARCHIVE
                        yield path, e.filename, file, None if nested else data, "archive inside an archive" if nested else None
        except Exception as x:
            yield failed(path, x)

    out = _mapped(todo.repartition(tasks(rows, size)), read, FILE_SCHEMA)
    discard(found)
    out.stored = todo.stored
    return out


def decoded(files: DataFrame) -> DataFrame:
    """files with text: UTF-8, or else ISO-8859-1 with the error that UTF-8 did not fit."""
    good = F.is_valid_utf8(F.col("content").cast("string"))
    text = F.when(good, F.col("content").cast("string")).otherwise(F.decode("content", "ISO-8859-1"))
    return files.withColumn("text", text).withColumn("error", F.when(F.col("content").isNotNull() & ~good, "UTF-8 encoding incompatible").otherwise(F.col("error")))


def is_csv(path: str = "file"):
    return F.lower(F.col(path)).endswith(".csv")


def base_name(path: str = "file"):
    return F.regexp_extract(F.col(path), r"([^/:\\]*)$", 1)


def csv_config(patterns: list[str], path: str = "file"):
    """Index of the first pattern that the file's base name fits; null for none."""
    cases = [F.when(base_name(path).rlike(path_regex(p)), F.lit(i)) for i, p in enumerate(patterns)]
    return F.coalesce(*cases) if cases else F.lit(None).cast("int")


def quote_all(text, comment: str | None = None, quote: str = '"'):
    """Does a CSV text quote every cell? Judged by its first line that is no comment; a text without such a line does."""
    lines = F.split(F.regexp_replace(text, r"(\r\n|\n|\r)\z", ""), "\r\n|\n|\r", -1)
    if comment:
        lines = F.filter(lines, lambda x: ~x.startswith(comment))
    return F.when((text == "") | (F.size(lines) == 0), True).otherwise(F.get(lines, F.lit(0)).startswith(quote))


def _records(text: str, delimiter: str, quote: str, comment: str | None) -> Iterator[list[str]]:
    """The records of a CSV text; a line that starts with the comment marker is one only where a record begins."""
    begins = True

    def feed() -> Iterator[str]:
        nonlocal begins
        for x in io.StringIO(text, newline=""):
            if begins and comment and x.startswith(comment):
                continue
            begins = False
            yield x

    reader = csv.reader(feed(), delimiter=delimiter, quotechar=quote)
    while True:
        begins = True
        try:
            record = next(reader)
        except StopIteration:
            return
        if record:
            yield record


def csv_cells(files: DataFrame, delimiter: str = ",", quote: str = '"', comment: str | None = None) -> DataFrame:
    """file, record_no (0: header), col_idx, col_name and cell of CSV texts of any header."""
    ship(files.sparkSession)

    def cells(row: tuple) -> Iterator[tuple]:
        head = None
        for n, record in enumerate(_records(row[1] or "", delimiter, quote, comment)):
            head = head or record
            yield from ((row[0], n, i, head[i] if i < len(head) else None, c) for i, c in enumerate(record))

    return _mapped(files.select("file", "text"), cells, "file string, record_no int, col_idx int, col_name string, cell string")


def csv_text(cells: DataFrame, quoted: DataFrame, delimiter: str = ",", quote: str = '"') -> DataFrame:
    """file and text of masked cells (file, record_no, col_idx, cell), quoted as `quoted` (file, all) says."""
    ship(cells.sparkSession)
    rows = cells.groupBy("file", "record_no").agg(F.transform(F.array_sort(F.collect_list(F.struct("col_idx", "cell"))), lambda x: x["cell"]).alias("r"))
    rows = rows.groupBy("file").agg(F.transform(F.array_sort(F.collect_list(F.struct("record_no", "r"))), lambda x: x["r"]).alias("records")).join(quoted, "file")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = []
            for records, every in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                out = io.StringIO()
                csv.writer(out, delimiter=delimiter, quotechar=quote, quoting=csv.QUOTE_ALL if every else csv.QUOTE_MINIMAL, lineterminator="\n").writerows(records)
                texts.append(out.getvalue().removesuffix("\n"))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], names=["file", "text"])

    return rows.select("file", "records", "all").mapInArrow(run, "file string, text string")


def _moved(fs: pafs.FileSystem, staged: str, target: str) -> None:
    """Put a staged file in its place, over what is there; done once however often tasks try."""
    fs.create_dir(os.path.dirname(target), recursive=True)
    try:
        fs.move(staged, target)
    except OSError:
        gone = fs.get_file_info(staged).type == pafs.FileType.NotFound
        if not gone or fs.get_file_info(target).type != pafs.FileType.File:
            raise


def write_files(changed: DataFrame, root: str, source: str | None = None) -> DataFrame:
    """Write (path, zip_path, text) under root; gives path and entries (1 for a plain file) of each file written.

    Texts are first staged by the tasks that hold them, each attempt under names of its own, in a folder below root; the
    written table of these names has those of one attempt per task. Entries of one archive are then put into a copy of
    source's archive (a new one if there is none), member by member, and at last all complete files are moved into
    place. So a failure before that leaves root as it was, and a task that runs twice leaves one complete file. Texts
    are UTF-8 unless a column charset says otherwise. Of several rows of one file, or entry, that of the least digest counts, of a
    plain file and entries of the same path the plain file.
    """
    spark = changed.sparkSession
    ship(spark)
    charset = F.col("charset") if "charset" in changed.columns else F.lit(None).cast("string")
    run, tables, made = f".staging-{uuid.uuid4().hex}", [], set()  # made: folders that a task has made
    fs, top = store(root)
    fs.create_dir(f"{top}/{run}", recursive=True)

    def put(content: bytes) -> str:
        fs, top = store(root)
        name = uuid.uuid4().hex
        folder = f"{run}/{name[:2]}"
        if folder not in made:
            fs.create_dir(f"{top}/{folder}", recursive=True)
            made.add(folder)
        with _writing(fs, f"{top}/{folder}/{name}") as f:
            f.write(content)
        return f"{folder}/{name}"

    def stage(row: tuple) -> Iterator[tuple]:
        path, inside, text, charset = row
        content = (text or "").encode(charset or "utf-8")
        yield path, inside, hashlib.md5(content).hexdigest(), put(content)

    def assemble(table: pa.Table) -> pa.Table:
        fs, top = store(root)
        path, name = table.column("path")[0].as_py(), put(b"")
        entries = dict(zip(table.column("zip_path").to_pylist(), table.column("staged").to_pylist()))
        done = set()
        with _writing(fs, f"{top}/{name}") as out, zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as new:

            def add(info: zipfile.ZipInfo, src) -> None:
                with src, new.open(info, "w", force_zip64=info.file_size > zipfile.ZIP64_LIMIT // 2) as dst:
                    shutil.copyfileobj(src, dst, 1 << 20)

            old_fs, old_top = store(source or root)
            if old_fs.get_file_info(f"{old_top}/{path}").type == pafs.FileType.File:
                with _reading(old_fs, f"{old_top}/{path}") as f, zipfile.ZipFile(f) as old:
                    for e in old.infolist():
                        info, mine = copy.copy(e), entries.get(e.filename)
                        done.add(e.filename)
                        if mine is not None:
                            info.file_size = fs.get_file_info(f"{top}/{mine}").size
                        add(info, _reading(fs, f"{top}/{mine}") if mine is not None else old.open(e))
            for inside in sorted(entries.keys() - done):
                info = zipfile.ZipInfo(inside)
                info.compress_type, info.file_size = zipfile.ZIP_DEFLATED, fs.get_file_info(f"{top}/{entries[inside]}").size
                add(info, _reading(fs, f"{top}/{entries[inside]}"))
        return pa.table({"path": pa.array([path]), "staged": pa.array([name]), "entries": pa.array([len(entries)], pa.int32())})

    def move(row: tuple) -> Iterator[tuple]:
        fs, top = store(root)
        _moved(fs, f"{top}/{row[1]}", f"{top}/{row[0]}")
        yield row[0], row[2]

    try:
        rows = changed.select("path", "zip_path", F.col("text").cast("string").alias("text"), charset.alias("charset"))
        tables.append(written(_mapped(rows, stage, "path string, zip_path string, digest string, staged string"), "staged"))
        one = tables[0].groupBy("path", "zip_path").agg(F.min(F.struct("digest", "staged"))["staged"].alias("staged"))
        plain = one.where("zip_path is null").select("path", "staged", F.lit(1).alias("entries"))
        inside = one.where("zip_path is not null").join(plain, "path", "left_anti")
        archives = inside.groupBy("path").applyInArrow(assemble, "path string, staged string, entries int")
        tables.append(written(plain.unionByName(archives), "complete"))
        return written(_mapped(tables[1], move, "path string, entries int"), "moved")
    finally:
        discard(*tables)
        fs.delete_dir(f"{top}/{run}")
