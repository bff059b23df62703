"""N-gram Jaccard self-join by prefix filters under several global token orders.

A pair with Jaccard similarity >= t must share a token among the first n - ceil(t n) + 1 tokens of both sets,
under any one order of all tokens. Order 1 puts the most frequent tokens last (so that passages which many
documents share make no candidates) and generates the candidates from its posting lists. A posting also tells how many
tokens come before it, which bounds what a pair can still share. Orders 2 and 3 are two hash orders; a candidate
whose prefixes do not meet under both of them too is dropped before any text travels: the prefixes of the classes in
question, four bytes a token, meet in blocks of pairs. Only what is left is verified on the texts.

Texts with equal shingle sets form a class; only classes are joined. A posting list of up to ``small`` classes
gives all its pairs. A longer one first gives stars around a few leaders; once their verified links are merged
into components, the pairs of the list that lie in different components follow, block by block: a list is cut by set
size (a partner's is at most a third larger) and then into blocks, and a task sees two blocks at a time. So no link
between components is lost, and a large group of near copies is not expanded into its pairs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cloakframe.llm.components import connected_components
from cloakframe.llm.shingles import U, mix, set_signature, shingle_sets
from cloakframe.runtime import discard, frugal, ship, written

_ORDER2, _ORDER3 = U(0xA0761D6478BD642F), U(0xE7037ED1A0B428DB)


def _prefix_size(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1


def _ranks(s: np.ndarray, hot: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Sort keys of order 1: 0 for tokens that are not frequent, else the token's place among the frequent."""
    tokens, rank = hot
    out = np.zeros(len(s), np.int64)
    if len(tokens):
        at = np.minimum(np.searchsorted(tokens, s), len(tokens) - 1)
        hit = tokens[at] == s
        out[hit] = rank[at[hit]] + 1
    return out


def _prefix(s: np.ndarray, percent: int, hot: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    p = _prefix_size(len(s), percent)
    r = _ranks(s, hot)
    cold = s[r == 0]  # s is sorted, so these are in hash order
    if len(cold) >= p:
        return cold[:p]
    rest = np.flatnonzero(r)
    rest = rest[np.argsort(r[rest], kind="stable")][: p - len(cold)]
    return np.concatenate([cold, s[rest]])


def _prefixes(s: np.ndarray, percent: int) -> bytes:
    """The prefixes of a set under the two hash orders, four bytes a token, one after the other."""
    p = _prefix_size(len(s), percent)
    return b"".join((np.sort(np.partition(mix(s ^ order), p - 1)[:p]) >> U(32)).astype("<u4").tobytes() for order in (_ORDER2, _ORDER3))


def _meet(a: bytes, b: bytes) -> bool:
    """Do two sets' prefixes share a token under each of the hash orders?"""
    for half in (0, 1):
        x, y = (np.frombuffer(z, "<u4").reshape(2, -1)[half] for z in (a, b))
        both = np.sort(np.concatenate([np.unique(x), np.unique(y)]))
        if not (both[1:] == both[:-1]).any():
            return False
    return True


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    if not len(a) or not len(b) or 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    both = np.sort(np.concatenate([a, b]))
    shared = int((both[1:] == both[:-1]).sum())
    return 100 * shared >= percent * (len(a) + len(b) - shared)


def _scan(k: int):
    """doc_id, n, sig per document; and (kind 1) the tokens that several classes of a task hold, with their count."""

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        held: list[np.ndarray] = []
        size = 0

        def counted() -> pa.RecordBatch:
            t, c = np.unique(np.concatenate([np.zeros(0, U), *held]), return_counts=True)
            t, c = t[c > 1], c[c > 1]
            return out(1, np.zeros(len(t), np.int64), c, t.view(np.int64))

        def out(kind, ids, n, sig):
            return pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(sig), kind, np.int32)), ids if isinstance(ids, pa.Array) else pa.array(ids, pa.int64()), pa.array(n, pa.int64()), pa.array(sig, pa.int64())],
                names=["kind", "doc_id", "n", "sig"],
            )

        for b in batches:
            n, sig = [], []
            for s in shingle_sets(b.column(1), k):
                g = set_signature(s)
                n.append(len(s))
                sig.append(g)
                if g not in seen:
                    seen.add(g)
                    held.append(s)
                    size += len(s)
                if size > 4_000_000:
                    yield counted()
                    held, size = [], 0
            yield out(0, b.column(0).cast(pa.int64()), n, sig)
        yield counted()

    return run


def _postings(k: int, percent: int, hot, buckets: int):
    """Packed (token, class, set size, place in the class's order) postings of the prefixes under order 1, cut into hash buckets of tokens."""

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = hot.value
        seen: set[int] = set()
        tok, node, size, held = [], [], [], 0

        def flush() -> pa.RecordBatch:
            t = np.concatenate(tok)
            rec = np.empty(len(t), dtype=[("t", "<u8"), ("c", "<i8"), ("n", "<i4"), ("p", "<i4")])
            lens = [len(x) for x in tok]
            rec["t"], rec["c"], rec["n"] = t, np.repeat(np.array(node, np.int64), lens), np.repeat(np.array(size, np.int32), lens)
            rec["p"] = np.concatenate([np.arange(n, dtype=np.int32) for n in lens])
            bucket = ((t >> U(20)) % U(buckets)).astype(np.int32)
            at = np.argsort(bucket, kind="stable")
            rec, bucket = rec[at], bucket[at]
            ids, first = np.unique(bucket, return_index=True)
            ends = [*first[1:], len(rec)]
            return pa.RecordBatch.from_arrays([pa.array(ids), pa.array([rec[a:b].tobytes() for a, b in zip(first, ends)], pa.binary())], names=["bucket", "blob"])

        for b in batches:
            for s in shingle_sets(b.column(1), k):
                g = set_signature(s)
                if not len(s) or g in seen:
                    continue
                seen.add(g)
                p = _prefix(s, percent, order)
                tok.append(p)
                node.append(g)
                size.append(len(s))
                held += len(p)
                if held > 2_000_000:
                    yield flush()
                    tok, node, size, held = [], [], [], 0
        if tok:
            yield flush()

    return run


def _can(n1, p1, n2, p2, percent: int):
    """Positional filter: with the first shared token at places p1 and p2 of n1 and n2, is the similarity in reach?

    At most the tokens from there on are shared. A later shared token gives a lower bound, so a pair that is in
    reach passes at its first one, and one that is not passes nowhere.
    """
    most = np.minimum(n1 - p1, n2 - p2)
    return (100 * np.minimum(n1, n2) >= percent * np.maximum(n1, n2)) & (most * (100 + percent) >= percent * (n1 + n2))


def _pairs_of(c: np.ndarray, n: np.ndarray, p: np.ndarray, percent: int, label: np.ndarray | None = None) -> np.ndarray:
    """All (a < b) pairs of a token's list that pass the filters (and differ in label)."""
    found = []
    order = np.argsort(n, kind="stable")
    c, n, p = c[order], n[order], p[order]
    label = label[order] if label is not None else None
    far = np.searchsorted(n, n * 100 // percent, side="right")
    for i in range(len(c) - 1):
        j = slice(i + 1, far[i])
        ok = _can(n[i], p[i], n[j], p[j], percent)
        if label is not None:
            ok &= label[j] != label[i]
        x = c[j][ok]
        if len(x):
            found.append(np.stack([np.minimum(x, c[i]), np.maximum(x, c[i])], 1))
    return np.concatenate(found) if found else np.zeros((0, 2), np.int64)


class _Pairs:
    """Distinct pairs, kept distinct as they come: many tokens of a shared passage name the same ones."""

    def __init__(self):
        self.held, self.size, self.lists = [np.zeros((0, 2), np.int64)], 0, set()

    def first(self, members: np.ndarray) -> bool:
        """Is this list of classes new? (Tokens that stand side by side mostly have the same list.)"""
        g = hashlib.blake2b(members.tobytes(), digest_size=12).digest()
        if g in self.lists:
            return False
        self.lists.add(g)
        return True

    def add(self, p: np.ndarray) -> None:
        self.held.append(p)
        self.size += len(p)
        if self.size > 500_000:
            self.held = [self.distinct()]
            self.size = 0

    def distinct(self) -> np.ndarray:
        p = np.concatenate(self.held)
        p = p[np.lexsort((p[:, 1], p[:, 0]))]
        if len(p):
            p = p[np.concatenate([[True], (p[1:] != p[:-1]).any(1)])]
        return p


def _candidates(percent: int, small: int, leaders: int):
    """kind 0: candidate pairs (a, b). kind 1: (a=token, b=class, n, p) of the lists that are longer than small.

    Rows come sorted by bucket, and one bucket at a time is held.
    """

    def of_bucket(blobs: list[bytes]) -> Iterator[pa.RecordBatch]:
        rec = np.frombuffer(b"".join(blobs), dtype=[("t", "<u8"), ("c", "<i8"), ("n", "<i4"), ("p", "<i4")])
        t, c, n, q = rec["t"], rec["c"], rec["n"].astype(np.int64), rec["p"].astype(np.int64)
        at = np.lexsort((c, t))
        t, c, n, q = t[at], c[at], n[at], q[at]
        if len(t):  # a class that several tasks held is there several times
            keep = np.ones(len(t), bool)
            keep[1:] = (t[1:] != t[:-1]) | (c[1:] != c[:-1])
            t, c, n, q = t[keep], c[keep], n[keep], q[keep]
        first = np.flatnonzero(np.concatenate([[True], t[1:] != t[:-1]])) if len(t) else np.zeros(0, np.int64)
        length = np.diff(np.append(first, len(t)))
        pairs, large = _Pairs(), []
        two = first[length == 2]
        ok = _can(n[two], q[two], n[two + 1], q[two + 1], percent)
        pairs.add(np.stack([c[two], c[two + 1]], 1)[ok])
        for f, m in zip(first[length > 2], length[length > 2]):
            x, y, z = c[f : f + m], n[f : f + m], q[f : f + m]
            if not pairs.first(np.concatenate([x, z])):
                continue
            if m <= small:
                pairs.add(_pairs_of(x, y, z, percent))
                continue
            large.append((f, m))
            # those with the fewest tokens before this one, which are rare ones of their own, lie in the middle
            for lead in np.lexsort((x, z / y))[:leaders]:
                o = x[(x != x[lead]) & _can(y, z, y[lead], z[lead], percent)]
                pairs.add(np.stack([np.minimum(o, x[lead]), np.maximum(o, x[lead])], 1))
        p = pairs.distinct()
        yield _batch(0, p[:, 0], p[:, 1], np.zeros(len(p), np.int64), np.zeros(len(p), np.int64))
        for f, m in large:
            yield _batch(1, t[f : f + m].view(np.int64), c[f : f + m], n[f : f + m], q[f : f + m])

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, blobs = None, []
        for b in batches:
            for bucket, blob in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if bucket != at and blobs:
                    yield from of_bucket(blobs)
                    blobs = []
                at = bucket
                blobs.append(blob)
        if blobs:
            yield from of_bucket(blobs)

    return run


def _batch(kind: int, a, b, n, p) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(a), kind, np.int32)), pa.array(a), pa.array(b), pa.array(n), pa.array(p)], names=["kind", "a", "b", "n", "p"])


def _blocked(lists: DataFrame, percent: int, block: int) -> DataFrame:
    """Rows (a, b, n, p, label) dealt to pairs of blocks: key, side (0 or 1; 0 alone: pairs within) and the rest.

    Set sizes fall into levels that grow by 100 / percent, so that partners are of one level or of two neighbours; a
    level of a list is cut into blocks. Each two blocks of a level, and of a level and the next, make a key.
    """
    level = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(100 / percent)) + 1e-9)
    rows = lists.withColumn("g", level)
    cuts = rows.groupBy("a", "g").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("cuts"))
    near = lambda by, name: cuts.select("a", (F.col("g") + by).alias("g"), F.col("cuts").alias(name))
    rows = rows.join(cuts, ["a", "g"]).join(near(-1, "above"), ["a", "g"], "left").join(near(1, "below"), ["a", "g"], "left")
    own = F.pmod(F.xxhash64("b"), F.col("cuts")).cast("int")
    upto = lambda n: F.when(F.coalesce(n, F.lit(0)) > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    place = lambda g, kind, i, j, side: F.struct(F.xxhash64("a", g, F.lit(kind), i, j).alias("key"), side.alias("side"))
    within = F.transform(upto(F.col("cuts")), lambda j: place(F.col("g"), 0, F.least(own, j), F.greatest(own, j), F.when(j >= own, 0).otherwise(1)))
    up = F.transform(upto(F.col("above")), lambda j: place(F.col("g"), 1, own, j, F.lit(0)))
    down = F.transform(upto(F.col("below")), lambda i: place(F.col("g") - 1, 1, i, own, F.lit(1)))
    return rows.select("b", "n", "p", "label", F.explode(F.concat(within, up, down)).alias("x")).select("x.key", "x.side", "b", "n", "p", "label")


def _crossing(percent: int):
    """The pairs of different components of each key; rows (key, side, class, n, p, label) come sorted by key."""

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, part = _Pairs(), []

        def close() -> None:
            side, c, n, q, label = (np.concatenate([x[i] for x in part]) for i in range(1, 6))
            at = np.lexsort((c, side))
            side, c, n, q, label = side[at], c[at], n[at], q[at], label[at]
            if (label == label[0]).all() or not pairs.first(np.concatenate([c, q, side])):
                return
            if side[-1] == 0:
                pairs.add(_pairs_of(c, n, q, percent, label))
                return
            y = np.flatnonzero(side)
            for i in np.flatnonzero(side == 0):
                x = c[y][_can(n[i], q[i], n[y], q[y], percent) & (label[y] != label[i])]
                if len(x):
                    pairs.add(np.stack([np.minimum(x, c[i]), np.maximum(x, c[i])], 1))

        for b in batches:
            cols = [b.column(i).to_numpy() for i in range(6)]
            cuts = np.flatnonzero(np.diff(cols[0])) + 1
            for i, j in zip([0, *cuts], [*cuts, b.num_rows]):
                if part and i < j and part[0][0][0] != cols[0][i]:
                    close()
                    part = []
                if i < j:
                    part.append([x[i:j] for x in cols])
        if part:
            close()
        p = pairs.distinct()
        yield pa.RecordBatch.from_arrays([pa.array(p[:, 0]), pa.array(p[:, 1])], names=["a", "b"])

    return run


def _own_text(k: int, percent: int):
    """sig, text and prefixes (under orders 2 and 3) of the rows whose text has the set that is asked for."""

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = list(shingle_sets(b.column(1), k))
            own = b.append_column("prefixes", pa.array([_prefixes(s, percent) if len(s) else b"" for s in sets], pa.binary()))
            yield own.filter(pa.compute.equal(pa.array([set_signature(s) for s in sets], pa.int64()), b.column(0)))

    return run


def _tested(of, fits):
    """Rows (x, y, a, b, value) sorted by block pair (x, y), there the values (of class a, b null) before the pairs.

    The pairs of which fits(value, value) holds come out; of turns a batch's values into what fits takes.
    """

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, {}
        for batch in batches:
            x, y, a, b = (batch.column(i).to_pylist() for i in range(4))
            rows = []
            for u, v, c, d, value in zip(x, y, a, b, of(batch.column(4))):
                if (u, v) != at:
                    at, held = (u, v), {}
                if d is None:
                    held[c] = value
                elif c in held and d in held and fits(held[c], held[d]):
                    rows.append((u, v, c, d))
            cols = list(zip(*rows)) if rows else [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["x", "y", "a", "b"])

    return run


def ngram_jaccard_join(
    docs: DataFrame, k: int = 5, percent: int = 75, frequent: int = 200_000, small: int = 16, leaders: int = 3, block: int = 1024
) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id (smallest doc_id reachable by links).

    docs needs doc_id and text; further columns are ignored. Null and wordless texts have the empty set and link
    with nothing (their component is their own doc_id); equal sets always link; rows that repeat a doc_id are
    each answered. A row whose doc_id is null links only with rows of the same set, and its component is the
    smallest non-null doc_id of that set's component, or null. An empty table gives an empty result.

    frequent bounds the tokens whose frequency order 1 knows (16 bytes each are broadcast); all others tie, in
    hash order. Any order keeps the join exact; the bound only sets how many candidates are verified. block bounds the
    classes that a task compares with as many others at a time.
    """
    spark = docs.sparkSession
    ship(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    scanned = written(docs.mapInArrow(_scan(k), "kind int, doc_id long, n long, sig long"), "scan", few=True)
    ids = scanned.where("kind = 0").select("doc_id", "n", "sig")

    counts = scanned.where("kind = 1").groupBy("sig").agg(F.sum("n").alias("n")).where("n > 4")
    top = counts.orderBy(F.desc("n"), "sig").limit(frequent).toArrow()
    tokens = top.column("sig").to_numpy().view(U)
    by = np.argsort(tokens)
    rank = np.empty(len(tokens), np.int32)
    rank[:] = np.arange(len(tokens), 0, -1)  # the most frequent come last
    hot = spark.sparkContext.broadcast((tokens[by], rank[by]))

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    postings = docs.mapInArrow(_postings(k, percent, hot, 4 * parts), "bucket int, blob binary")
    postings = postings.repartition(parts, "bucket").sortWithinPartitions("bucket")
    found = written(postings.mapInArrow(_candidates(percent, small, leaders), "kind int, a long, b long, n long, p long"), "candidates", few=True)

    reps = ids.where("n > 0 and doc_id is not null").groupBy("sig").agg(F.min("doc_id").alias("doc_id"))
    pairs = found.where("kind = 0").select("a", "b").distinct()
    large = found.where("kind = 1")
    ends = pairs.select(F.col("a").alias("sig")).unionAll(pairs.select(F.col("b").alias("sig"))).unionAll(large.select(F.col("b").alias("sig")))
    texts = _texts(docs, reps, ends, k, percent)
    leader = pairs.select(F.col("a").alias("sig"), F.col("a").alias("token")).unionAll(pairs.select(F.col("b").alias("sig"), F.col("a").alias("token")))
    links = _verified(texts, pairs, leader.groupBy("sig").agg(F.min("token").alias("token")), k, percent)
    stars = connected_components(links)
    label = large.join(stars.select(F.col("node").alias("b"), "component"), "b", "left").select("a", "b", "n", "p", F.coalesce("component", "b").alias("label"))
    contested = label.groupBy("a").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x <> y").select("a")
    lists = written(label.join(contested, "a").select("a", "b", "n", "p", "label"), "contested", few=True)
    crossing = _blocked(lists, percent, block).repartition(parts, "key").sortWithinPartitions("key").mapInArrow(_crossing(percent), "a long, b long")
    crossing = written(crossing.distinct().join(pairs, ["a", "b"], "left_anti"), "crossing", few=True)
    more = []
    if not crossing.isEmpty():
        more = [_verified(texts, crossing, lists.groupBy(F.col("b").alias("sig")).agg(F.min("a").alias("token")), k, percent), stars]
        stars = connected_components(links.unionAll(more[0]))
    discard(found, texts, lists, crossing, links, *more)
    # from classes to documents: the smallest doc_id of the component's classes
    classes = reps.join(stars.withColumnRenamed("node", "sig"), "sig", "left").select("sig", "doc_id", F.coalesce("component", "sig").alias("star"))
    low = classes.groupBy("star").agg(F.min("doc_id").alias("component_id"))
    classes = classes.join(low, "star").select("sig", "component_id")
    out = ids.where("n > 0").join(classes, "sig", "left").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    return out.unionAll(ids.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))


def _texts(docs: DataFrame, reps: DataFrame, classes: DataFrame, k: int, percent: int) -> DataFrame:
    """(sig, text, prefixes) of the classes, from one document of each, as a written table."""
    texts = docs.join(classes.distinct().join(reps, "sig"), "doc_id").select("sig", "text")
    return written(texts.mapInArrow(_own_text(k, percent), "sig long, text string, prefixes binary"), "texts")


def _verified(texts: DataFrame, pairs: DataFrame, place: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs of classes whose sets reach the similarity, as a written table (a, b).

    place gives each class (sig) a token that many of its partners have too. Classes of one token are cut into
    blocks of about 64, and what a class is judged by travels once to each pair of blocks that has a candidate of it:
    its prefixes first, and its text only where these leave a candidate.
    """
    parts = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    many = place.groupBy("token").agg(F.ceil(F.count(F.lit(1)) / 64).alias("cuts"))
    block = place.join(many, "token").select("sig", F.xxhash64("token", F.pmod(F.xxhash64("sig"), "cuts")).alias("block"))
    keyed = pairs.join(block.select(F.col("sig").alias("a"), F.col("block").alias("x")), "a").join(block.select(F.col("sig").alias("b"), F.col("block").alias("y")), "b")
    keyed = written(keyed.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y"), "a", "b"), "blocks", few=True)

    def tested(keyed: DataFrame, column: str, kind: str, run) -> DataFrame:
        need = keyed.select("x", "y", F.col("a").alias("sig")).unionAll(keyed.select("x", "y", F.col("b").alias("sig"))).distinct()
        rows = need.join(texts.select("sig", F.col(column).alias("value")), "sig").select("x", "y", F.col("sig").alias("a"), F.lit(None).cast("long").alias("b"), "value")
        rows = rows.unionAll(keyed.select("x", "y", "a", "b", F.lit("").cast(kind).alias("value"))).repartition(parts, "x", "y").sortWithinPartitions("x", "y", F.asc_nulls_first("b"))
        return written(rows.mapInArrow(run, "x long, y long, a long, b long"), f"by-{column}", few=True)

    left = tested(keyed, "prefixes", "binary", _tested(lambda column: column.to_pylist(), _meet))
    links = tested(left, "text", "string", _tested(lambda column: shingle_sets(column, k), lambda a, b: similar(a, b, percent)))
    discard(keyed, left)
    return links
