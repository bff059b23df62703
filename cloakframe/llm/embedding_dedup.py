"""Near-duplicate vectors by product quantisation: inverted lists, residual codes, exact cosine at the end.

Vectors are compared as unit vectors, where cosine >= t means a distance of at most r = sqrt(2 - 2t). The two filters
use bounds, so that they lose no pair:

* lists: a vector that lies within r of another lies within r of the plane between their lists' centroids, so that a
  vector probes every list whose plane is that near;
* codes: the distance to a stored vector is at least the distance to its code (a sum of table entries, one for each
  subspace) less the error of that code, which is stored with it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cloakframe.llm.components import connected_components
from cloakframe.runtime import discard, frugal, ship, written

SLACK = 1e-5  # rounding of distances


@dataclass
class Index:
    """lists: centroids (lists x dimensions); codes: centroids of residuals for each subspace (parts x 256 x width)."""

    lists: np.ndarray
    codes: np.ndarray

    def __post_init__(self):
        square = (self.lists**2).sum(1)
        self.width = self.lists.shape[1]
        self.between = np.sqrt(np.maximum(square[:, None] + square[None] - 2 * self.lists @ self.lists.T, 1e-18))


def _means(x: np.ndarray, k: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    """k-means: at most k centroids of the rows of x."""
    c = np.unique(x[rng.permutation(len(x))[:k]], axis=0)
    for _ in range(rounds):
        near = np.argmax(x @ c.T - (c * c).sum(1) / 2, axis=1)
        n = np.bincount(near, minlength=len(c))
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        c = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], c)
    return c


def train(x: np.ndarray, lists: int, parts: int = 8, seed: int = 5) -> Index:
    """An index for unit vectors like the rows of x."""
    rng = np.random.default_rng(seed)
    x = np.pad(x, ((0, 0), (0, -x.shape[1] % parts)))
    centroids = _means(x, lists, 10, rng)
    rest = x - centroids[np.argmax(x @ centroids.T - (centroids * centroids).sum(1) / 2, axis=1)]
    books = [_means(r, 256, 8, rng) for r in np.split(rest, parts, axis=1)]
    books = [np.concatenate([b, np.full((256 - len(b), b.shape[1]), 1e3)]) for b in books]  # unused codes lie far off
    return Index(centroids, np.stack(books))


def _units(rows: list, width: int) -> tuple[np.ndarray, list[bytes]]:
    """The first width coordinates of the unit vectors (short ones filled up with zeros), and the vectors as bytes."""
    out, raw = np.zeros((len(rows), width)), []
    for i, v in enumerate(rows):
        top = np.abs(v).max()
        u = v / top  # the norm of very large or very small numbers would leave the range of doubles
        u = u / np.sqrt(u @ u)
        n = min(width, len(u))
        out[i, :n] = u[:n]
        raw.append(u.tobytes())
    return out, raw


def _valid(column: pa.ListArray) -> list[np.ndarray | None]:
    """The vectors of a column; None for those that are null, empty or zero, or hold nulls or non-finite numbers."""
    at, values = column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False)  # nulls become NaN
    rows = [values[at[i] : at[i + 1]] if ok else values[:0] for i, ok in enumerate(column.is_valid().to_pylist())]
    return [v if len(v) and np.isfinite(v).all() and v.any() else None for v in rows]


def _placed(index: Index, x: np.ndarray, r: float) -> tuple[np.ndarray, list[list[int]], np.ndarray, np.ndarray]:
    """Of unit vectors: own list, later lists to probe, residual codes and the errors of these."""
    c = index.lists
    square = (c * c).sum(1) - 2 * x @ c.T  # less |x|^2
    own = square.argmin(1)
    near = (square - square[np.arange(len(x)), own][:, None]) / (2 * index.between[own]) <= r + SLACK
    near &= np.arange(len(c))[None] > own[:, None]
    rest = np.stack(np.split(x - c[own], len(index.codes), axis=1))
    far = (index.codes**2).sum(-1)[:, None] - 2 * rest @ index.codes.transpose(0, 2, 1)
    codes = far.argmin(2)
    error = np.sqrt(((rest - np.take_along_axis(index.codes, codes[:, :, None], 1)) ** 2).sum((0, 2)))
    return own, [np.flatnonzero(n).tolist() for n in near], codes.T.astype(np.uint8), error


def _compare(index: Index, centre: int, stored: dict, asked: dict | None, r: float, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Places of linked pairs (stored, asked); asked None: pairs within stored, each once."""
    inner = asked is None
    asked = stored if inner else asked
    parts = len(index.codes)
    found: list[tuple[np.ndarray, np.ndarray]] = []
    reach = r + stored["error"] + SLACK
    step = max(1, (1 << 20) // max(1, len(reach)))
    for at in range(0, len(asked["unit"]), step):
        rest = np.split(asked["unit"][at : at + step] - index.lists[centre], parts, axis=1)
        far = np.zeros((len(rest[0]), len(reach)))
        for m in range(parts):
            table = ((rest[m][:, None] - index.codes[m][None]) ** 2).sum(-1)
            far += table[:, stored["codes"][:, m]]
        q, s = np.nonzero(far <= (reach * reach)[None])
        q += at
        if inner:
            q, s = q[s < q], s[s < q]
        for i in range(0, len(q), 1 << 15):  # exact cosine in double precision
            qs, ss = q[i : i + (1 << 15)], s[i : i + (1 << 15)]
            linked = np.einsum("ij,ij->i", asked["full"][qs], stored["full"][ss]) >= least
            found.append((ss[linked], qs[linked]))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate([a for a, _ in found]), np.concatenate([b for _, b in found])


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of n nodes the smallest node that the pairs (a, b) connect it with."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def assign(vectors: DataFrame, index: Index, id_column: str, vector_column: str, label_column: str, r: float) -> DataFrame:
    """Every row: uid, id, label, dim, digest, unit, list, probes, codes and error (from digest on null if it links with nothing)."""
    ship(vectors.sparkSession)
    id_kind, label_kind = (dict(vectors.dtypes)[c] for c in (id_column, label_column))
    schema = f"uid long, id {id_kind}, label {label_kind}, dim int, digest binary, unit binary, list int, probes array<int>, codes binary, error double"

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in (whole.slice(i, 512) for i in range(0, whole.num_rows, 512)):
                found = [v if has else None for v, has in zip(_valid(b.column(3)), b.column(2).is_valid().to_pylist())]
                at = [i for i, v in enumerate(found) if v is not None]
                columns: list[list] = [[None] * b.num_rows for _ in range(7)]
                if at:
                    x, raw = _units([found[i] for i in at], index.width)
                    own, probes, codes, error = _placed(index, x, r)
                    for k, i in enumerate(at):
                        values = (len(found[i]), hashlib.blake2b(raw[k], digest_size=16).digest(), raw[k], int(own[k]), probes[k], codes[k].tobytes(), float(error[k]))
                        for column, v in zip(columns, values):
                            column[i] = v
                kinds = (pa.int32(), pa.binary(), pa.binary(), pa.int32(), pa.list_(pa.int32()), pa.binary(), pa.float64())
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), *(pa.array(c, k) for c, k in zip(columns, kinds))], names=[f.split()[0] for f in schema.split(", ")])

    rows = vectors.select(F.monotonically_increasing_id().alias("uid"), F.col(id_column).alias("id"), F.col(label_column).alias("label"), F.col(vector_column).cast("array<double>").alias("v"))
    return rows.mapInArrow(run, schema)


def linked_blocks(cells: DataFrame, index: Index, r: float, least: float) -> DataFrame:
    """(uid, links, root) from each block pair: links of a vector in it, and the first vector of its block that it hangs on."""
    width = index.width

    def side(t: pa.Table) -> dict:
        full = np.frombuffer(b"".join(t["unit"].to_pylist()), np.float64).reshape(t.num_rows, -1)
        unit = np.zeros((t.num_rows, width))
        unit[:, : min(width, full.shape[1])] = full[:, :width]
        codes = np.frombuffer(b"".join(t["codes"].to_pylist()), np.uint8).reshape(t.num_rows, -1)
        return {"full": full, "unit": unit, "codes": codes, "error": t["error"].to_numpy()}

    def run(key: tuple, t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        first = t["side"].to_numpy() == 0
        uid, copies = t["uid"].to_numpy(), t["copies"].to_numpy()
        s, q = np.flatnonzero(first), np.flatnonzero(~first)
        a = b = np.zeros(0, np.int64)
        if len(s):
            if key[3].as_py() == key[4].as_py():
                a, b = _compare(index, key[2].as_py(), side(t.take(s)), None, r, least)
                a, b = s[a], s[b]
            elif len(q):
                a, b = _compare(index, key[2].as_py(), side(t.take(s)), side(t.take(q)), r, least)
                a, b = s[a], q[b]
        links = np.bincount(a, copies[b], len(uid)) + np.bincount(b, copies[a], len(uid)) if len(a) else np.zeros(len(uid))
        root, hit = _roots(len(uid), a, b), links > 0
        return pa.table({"uid": uid[hit], "links": links[hit].astype(np.int64), "root": uid[root[hit]]})

    return cells.groupBy("label", "dim", "list", "i", "j").applyInArrow(run, "uid long, links long, root long")


def embedding_near_dedup(vectors: DataFrame, least: float = 0.98, id_column: str = "vec_id", vector_column: str = "embedding", label_column: str = "label", limit: int = 20_000, block: int = 2_048) -> DataFrame:
    """Per row: id, n_links (other vectors of its label with cosine >= least), component_id (least id reachable) and kept.

    Vectors that are null, empty or zero, or hold nulls or non-finite numbers, and those without a label link with
    nothing; so do vectors of different lengths. Repeated rows are vectors of their own. A row without an id counts as
    a vector; its component is named by the others in it, and it is never kept. Other columns are not carried.

    The index is fitted on at most limit rows, chosen by a hash of the vector; all rows are indexed and compared, and
    no link is lost (see above). Equal vectors are compared once. Rows of a list are dealt to blocks of about block rows,
    and pairs of blocks to tasks, so that a list may hold any share of the rows; pairs stay within a task, from which
    come the numbers of links and, for each vector, one edge to what it hangs on there.
    """
    spark = vectors.sparkSession
    r = float(np.sqrt(max(0.0, 2 - 2 * least)))
    place = F.xxhash64(F.col(vector_column), F.lit(23))
    # the share is cut by a count first, so that no more than about twice limit rows come to one place
    some = vectors.where(F.col(vector_column).isNotNull() & F.col(label_column).isNotNull())
    n = some.count()
    share = min(1.0, 2 * limit / max(1, n))
    chosen = some.select(F.col(vector_column).cast("array<double>").alias("v"), place.alias("p")).where(F.pmod("p", F.lit(1 << 30)) < share * (1 << 30)).orderBy("p").limit(limit)
    good = [v for v in _valid(pa.array([row.v for row in chosen.collect()], pa.list_(pa.float64()))) if v is not None]
    if not good:
        good = [np.ones(1)]
    width = int(np.bincount([len(v) for v in good]).argmax())
    index = train(_units(good, width)[0], min(1024, max(8, n // 2000)))
    rows = written(assign(vectors, index, id_column, vector_column, label_column, r), "vectors")

    key = ["label", "dim", "digest"]
    fit = rows.where("digest is not null")
    groups = fit.groupBy(*key).agg(F.min("uid").alias("uid"), F.count(F.lit(1)).alias("copies")).select("uid", *key, "copies")
    reps = written(fit.drop("id", "digest").join(groups.select("uid", "copies"), "uid"), "representatives")
    sent = reps.select("uid", "copies", "unit", "codes", "error", "label", "dim", F.explode(F.concat(F.array("list"), "probes")).alias("cell"), F.col("list").alias("own"))
    sent = sent.withColumns({"asks": F.col("cell") != F.col("own"), "list": F.col("cell")}).drop("cell", "own")
    sizes = sent.groupBy("label", "dim", "list").agg(F.ceil(F.count_if(~F.col("asks")) / block).alias("n"), F.ceil(F.count_if("asks") / block).alias("m"))
    sent = sent.join(sizes.where("n > 0"), ["label", "dim", "list"])
    # stored rows form blocks 0 to n-1, the rows that only ask follow as n to n+m-1; a task (i, j) has stored block i and block j
    at = F.pmod(F.xxhash64("uid"), F.when(F.col("asks"), F.col("m")).otherwise(F.col("n"))) + F.when(F.col("asks"), F.col("n")).otherwise(0)
    sent = sent.withColumn("at", at)
    as_first = F.transform(F.sequence(F.col("at"), F.col("n") + F.col("m") - 1), lambda j: F.struct(F.col("at").alias("i"), j.alias("j"), F.lit(0).alias("side")))
    as_second = F.transform(F.filter(F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1), lambda i: i < F.col("at")), lambda i: F.struct(i.alias("i"), F.col("at").alias("j"), F.lit(1).alias("side")))
    tasks = F.when(F.col("asks"), as_second).otherwise(F.concat(as_first, as_second))
    cells = sent.select("uid", "copies", "unit", "codes", "error", "label", "dim", "list", F.explode(tasks).alias("t")).select("*", "t.*").drop("t")
    found = written(linked_blocks(cells, index, r, least), "links", few=True)

    edges = connected_components(found.select(F.col("uid").alias("a"), F.col("root").alias("b")))
    counted = found.groupBy("uid").agg(F.sum("links").alias("links"))
    about = groups.join(counted, "uid", "left").join(edges.select(F.col("node").alias("uid"), "component"), "uid", "left")
    about = about.select(*key, (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "uid").alias("component"))
    every = rows.select("uid", "id", *key).join(about, key, "left").select("id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "uid").alias("component"))
    every = written(every, "members")
    names = every.groupBy("component").agg(F.min("id").alias("component_id"))
    out = every.join(names, "component").select(F.col("id").alias(id_column), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept"))
    discard(rows, reps, found, edges)
    return out
