"""Alignment of two tokenizers' tokens, and how often each pair of their ids is linked, by a cogroup of postings.

Both tokenizers keep words apart: neither has a token that crosses from a character into the plain space after it. Texts
are cut there, and every distinct stretch is encoded and aligned once by each task and kept for the next texts.

A task turns its documents into postings: for each id of the first side the ids linked with it, and the documents that
hold them, in one row for a few thousand documents. Postings are shuffled by side id and meet the corpus-wide counts of
its pairs in a stream that is sorted on disk where memory is short; a document's contributions come out as partial sums.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cloakframe.runtime import frugal, ship, written

STRETCH = re.compile(r" (\s*(?:\S+(?:[^\S ]\s*)?)*)")  # ends before a plain space that follows no white space
RUN = re.compile(r"\s ")
FEW = 32  # so many places are stored as they are
BUCKETS = 8  # of side ids; with a range of documents they make the key of the cogroup, however much data there is


class Aligner:
    """Two tokenizer files: a byte-level BPE of the tokenizers library (A), a sentencepiece model with byte fallback (B).

    Ids beyond 16 bits are refused. Stretches of text are numbered as they come and aligned many at a time; what is known
    of them stays in arrays by number, until there are more than keep.
    """

    def __init__(self, first: str, second: str, keep: int = 400_000):
        import sentencepiece
        from tokenizers import Tokenizer

        from cloakframe.llm.bpe import _byte_letters

        self.a, self.b = Tokenizer.from_file(first), sentencepiece.SentencePieceProcessor(model_file=second)
        self.a.no_truncation()
        self.a.no_padding()
        self.a.encode_special_tokens = True
        letter = _byte_letters()
        pieces = [self.b.id_to_piece(i) for i in range(self.b.vocab_size())]
        if max(self.a.get_vocab_size(), len(pieces)) > 1 << 16 or any("▁" in p.lstrip("▁") for p in pieces):
            raise ValueError("ids of more than 16 bits, or pieces that go on after a space")
        self.bytes_a = [b""] * (1 << 16)
        for t, i in self.a.get_vocab().items():
            self.bytes_a[i] = bytes(letter[c] for c in t) if set(t) <= letter.keys() else b""
        as_byte = lambda i, p: bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode()
        self.bytes_b = [b"" if self.b.is_control(i) or self.b.is_unknown(i) else as_byte(i, p) for i, p in enumerate(pieces)]
        self.size_a, self.size_b = (np.array([len(x) for x in t]) for t in (self.bytes_a, self.bytes_b))
        self.told = [f"{i}{end}" for end in ",|;" for i in range(1 << 16)]  # an id and what follows it among the groups
        self.told_size = np.array([len(x) for x in self.told])
        self.keep = keep
        self._start()

    def _start(self) -> None:
        self.known: dict[str, int] = {}
        self.groups: list[str] = []
        self.counts = np.zeros((0, 5), np.int64)  # n_a, n_b, n_groups, n_links and 1 if bytes differ
        self.ends = np.zeros(1, np.int64)  # of a stretch's pairs, with a 0 before
        self.pairs, self.times = np.zeros(0, np.uint32), np.zeros(0, np.uint32)  # A id << 16 | B id, and how often

    def learn(self, stretches: list[str]) -> None:
        """Align new stretches, each without the space that it begins with, all at once."""
        raw = [f" {s}".encode() for s in stretches]
        first = [e.ids for e in self.a.encode_batch_fast([f" {s}" for s in stretches], add_special_tokens=False)]
        second = self.b.encode(stretches, num_threads=1)  # puts a space before each text, but not before none
        if "" in stretches:
            second[stretches.index("")] = [self.b.piece_to_id("▁")]
        size = np.fromiter(map(len, raw), np.int64, len(raw))
        good, sides = np.ones(len(raw), bool), []
        for side, width in ((first, self.size_a), (second, self.size_b)):
            n = np.fromiter(map(len, side), np.int64, len(side))
            ids = np.fromiter(chain.from_iterable(side), np.int64, int(n.sum()))
            sides.append((n, ids))
            good &= np.bincount(np.repeat(np.arange(len(raw)), n), width[ids], len(raw)) == size
        whole = b"".join(raw)
        for side, spelt in ((first, self.bytes_a), (second, self.bytes_b)):
            if not good.all() or b"".join([spelt[t] for t in chain.from_iterable(side)]) != whole:
                good &= [b"".join([spelt[t] for t in ids]) == r for ids, r in zip(side, raw)]
        flat, owner, end = [], [], []
        for (n, ids), width in zip(sides, (self.size_a, self.size_b)):
            flat.append(ids[np.repeat(good, n)])
            owner.append(np.repeat(np.arange(len(raw)), np.where(good, n, 0)))
            end.append(np.cumsum(width[flat[-1]]))  # tokens of good stretches fill them, so that ends of all run on
        cut = np.intersect1d(*end, assume_unique=True)
        group = [np.searchsorted(cut, e) for e in end]
        many = [np.bincount(g, minlength=len(cut)) for g in group]
        last = [np.cumsum(m) for m in many]
        links, of = many[0] * many[1], owner[0][last[0] - 1]
        count = lambda x, w=None: np.bincount(x, w, len(raw)).astype(np.int64)
        counts = np.stack([count(owner[0]), count(owner[1]), count(of), count(of, links), ~good], 1).astype(np.int64)

        # the groups as text: a group's A tokens, then its B tokens
        told = np.zeros(len(flat[0]) + len(flat[1]), np.int64)
        i, j = np.arange(len(flat[0])), np.arange(len(flat[1]))
        told[i + (last[1] - many[1])[group[0]]] = flat[0] + ((i + 1 == last[0][group[0]]) << 16)
        told[j + last[0][group[1]]] = flat[1] + ((j + 1 == last[1][group[1]]) << 17)
        text = "".join([self.told[t] for t in told.tolist()])
        chars = np.r_[0, np.cumsum(self.told_size[told])]
        high = np.cumsum(counts[:, 0] + counts[:, 1])
        bounds = chars[np.r_[0, high]].tolist()
        self.groups += [text[x : y - 1] for x, y in zip(bounds, bounds[1:])]

        # pairs: each A token with each B token of its group; in large groups each id once, with its number
        large = links > 4096
        part = np.flatnonzero(~large[group[0]])
        n = many[1][group[0][part]]
        to = np.repeat((last[1] - many[1])[group[0][part]] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        pairs, times, who = np.repeat(flat[0][part], n) << 16 | flat[1][to], np.ones(n.sum(), np.uint32), np.repeat(owner[0][part], n)
        for g in np.flatnonzero(large):
            ids, often = zip(*(np.unique(f[z[g] - m[g] : z[g]], return_counts=True) for f, z, m in zip(flat, last, many)))
            pairs = np.r_[pairs, (ids[0][:, None] << 16 | ids[1][None]).ravel()]
            times = np.r_[times, (often[0][:, None] * often[1][None]).ravel().astype(np.uint32)]
            who = np.r_[who, np.full(len(pairs) - len(who), of[g])]
        by = np.argsort(who, kind="stable")
        self.known.update(zip(stretches, range(len(self.known), len(self.known) + len(stretches))))
        self.counts = np.concatenate([self.counts, counts])
        self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(count(who))])
        self.pairs, self.times = np.concatenate([self.pairs, pairs[by].astype(np.uint32)]), np.concatenate([self.times, times[by]])

    def of(self, texts: list[str]) -> tuple[np.ndarray, list[str], np.ndarray, np.ndarray, np.ndarray]:
        """Per text n_a, n_b, n_groups and n_links, and the sha256 of its groups; then for each linked pair text, pair and times."""
        cut = [(STRETCH.findall(f" {t}") if RUN.search(f" {t}") else t.split(" ")) if t else [] for t in texts]
        if len(self.known) > self.keep:
            self._start()
        if new := list(set().union(*cut).difference(self.known)):
            self.learn(new)
        size = np.array([len(c) for c in cut])
        at = np.fromiter(map(self.known.__getitem__, chain.from_iterable(cut)), np.int64, int(size.sum()))
        owner = np.repeat(np.arange(len(texts)), size)
        sums = np.zeros((len(texts), 5), np.int64)
        np.add.at(sums, owner, self.counts[at])
        fine = (size > 0) & (sums[:, 4] == 0)
        sums[~fine] = 0
        high = np.cumsum(size)
        sha = [hashlib.sha256(";".join([self.groups[i] for i in at[y - n : y].tolist()]).encode()).hexdigest() if ok else "" for y, n, ok in zip(high, size, fine)]
        at, owner = at[fine[owner]], owner[fine[owner]]
        n = self.ends[at + 1] - self.ends[at]
        to = np.repeat(self.ends[at] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        return sums[:, :4], sha, np.repeat(owner, n), self.pairs[to].astype(np.int64), self.times[to]


@lru_cache(maxsize=1)
def aligner(first: str, second: str) -> Aligner:
    """The tokenizers of two files, loaded once in each Python worker."""
    return Aligner(first, second)


DOC = ["n_a", "n_b", "n_groups", "n_links"]


def postings(docs: DataFrame, first: str, second: str, id_column: str, text_column: str, most: int = 4096, pairs: int = 4_000_000) -> DataFrame:
    """Two kinds of rows: documents (row, id, DOC, groups_sha256) and postings (chunk, a, b, n, docs, times).

    A chunk has at most `most` documents and about `pairs` links; a document's row is its chunk * 65536 + its place in it.
    In a posting row, b lists the ids linked with a in the chunk and n in how many documents; docs has their places
    (16 bits each, by b) and times how often (32 bits each), both compressed.
    """
    ship(docs.sparkSession)
    kind = dict(docs.dtypes)[id_column]
    schema = f"row long, id {kind}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, chunk long, a int, b array<int>, n array<int>, docs binary, times binary"
    names = [f.split()[0] for f in schema.split(", ")]

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import zstandard
        from pyspark import TaskContext

        from cloakframe.llm.bpe import by_size

        two = aligner(first, second)  # reads the setting above
        pack = zstandard.ZstdCompressor(level=1).compress
        chunk = TaskContext.get().partitionId() << 20
        keys: list[np.ndarray] = []
        times: list[np.ndarray] = []
        n = held = 0

        def flushed() -> Iterator[pa.RecordBatch]:
            if not held:
                return
            key, m = np.concatenate(keys), np.concatenate(times)
            if m.max(initial=1) == 1:
                key, m = np.unique(key, return_counts=True)
            else:
                key, back = np.unique(key, return_inverse=True)
                m = np.bincount(back, m).astype(np.int64)
            pair = key >> 16
            new = np.flatnonzero(np.r_[True, pair[1:] != pair[:-1]])
            size = np.diff(np.r_[new, len(key)])
            a, b = pair[new] >> 16, pair[new] & 0xFFFF
            begin = np.flatnonzero(np.r_[True, a[1:] != a[:-1]])  # of each A id, in pairs
            place, often = (key & 0xFFFF).astype("<u2"), m.astype("<u4")
            end = np.r_[begin[1:], len(a)]
            low, high = new[begin], np.r_[new[begin[1:]], len(key)]
            for i in range(0, len(begin), 8192):
                j = min(i + 8192, len(begin))
                offsets = pa.array(np.r_[begin[i:j], end[j - 1]] - begin[i], pa.int32())
                part = slice(begin[i], end[j - 1])
                yield batch({
                    "chunk": pa.array(np.full(j - i, chunk)), "a": pa.array(a[begin[i:j]].astype(np.int32)),
                    "b": pa.ListArray.from_arrays(offsets, pa.array(b[part].astype(np.int32))), "n": pa.ListArray.from_arrays(offsets, pa.array(size[part].astype(np.int32))),
                    "docs": pa.array([pack(place[x:y].tobytes()) if y - x > FEW else place[x:y].tobytes() for x, y in zip(low[i:j], high[i:j])], pa.binary()),
                    "times": pa.array([b"" if (often[x:y] == 1).all() else pack(often[x:y].tobytes()) for x, y in zip(low[i:j], high[i:j])], pa.binary()),
                })

        id_type: list[pa.DataType] = []

        def batch(columns: dict[str, pa.Array]) -> pa.RecordBatch:
            rows = len(next(iter(columns.values())))
            kinds = [pa.int64(), id_type[0], *[pa.int64()] * 4, pa.string(), pa.int64(), pa.int32(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays([columns[c] if c in columns else pa.nulls(rows, k) for c, k in zip(names, kinds)], names=names)

        for whole in batches:
            id_type[:] = [whole.schema.field(0).type]
            at = 0
            for texts in by_size([t or "" for t in whole.column(1).to_pylist()], 128, 1 << 19):
                if n + len(texts) > most or held > pairs:
                    yield from flushed()
                    chunk, keys, times, n, held = chunk + 1, [], [], 0, 0
                sums, sha, place, pair, often = two.of(texts)
                keys.append(pair << 16 | n + place)
                times.append(often)
                held += len(pair)
                ids, row = whole.column(0).slice(at, len(texts)), chunk << 16 | n + np.arange(len(texts))
                yield batch({"row": pa.array(row), "id": ids, "groups_sha256": pa.array(sha)} | {c: pa.array(x) for c, x in zip(DOC, sums.T)})
                at, n = at + len(texts), n + len(texts)
        yield from flushed()

    return docs.select(F.col(id_column), F.col(text_column).cast("string")).mapInArrow(run, schema)


def contributions(stream: DataFrame) -> DataFrame:
    """(row, n_best, count_sum) of postings that follow their side id's counts in a sorted stream; a document may come several times."""

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        unpack = zstandard.ZstdDecompressor().decompress
        sums: dict[int, np.ndarray] = {}  # by chunk: n_best and count_sum of each place
        a, count, best = None, np.zeros(1 << 16, np.int64), 0

        def flushed() -> Iterator[pa.RecordBatch]:
            for chunk, x in sums.items():
                at = np.flatnonzero(x[1])
                yield pa.RecordBatch.from_arrays([pa.array(chunk << 16 | at), pa.array(x[0, at]), pa.array(x[1, at])], names=["row", "n_best", "count_sum"])
            sums.clear()

        for b in batches:
            sides, chunks, ids, places, ns, times = b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), b.column(3).to_pylist(), b.column(4), b.column(5).to_pylist()
            for i, (side, chunk) in enumerate(zip(sides, chunks)):
                of, n = ids[i].values.to_numpy(), ns[i].values.to_numpy()
                if chunk is None:
                    a, best = side, n.max()
                    count[of] = n  # all pairs of this side id; no posting has any other
                    continue
                if side != a:
                    raise RuntimeError(f"postings of {side} without counts")
                many = np.frombuffer(places[i] if n.sum() <= FEW else unpack(places[i]), "<u2").astype(np.int64)
                n = np.repeat(count[of], n)
                m = np.frombuffer(unpack(times[i]), "<u4").astype(np.int64) if times[i] else np.ones(len(many), np.int64)
                if chunk not in sums:
                    if len(sums) >= 64:
                        yield from flushed()
                    sums[chunk] = np.zeros((2, 1 << 12), np.int64)
                x = sums[chunk]
                if (top := int(many.max())) >= x.shape[1]:
                    x = sums[chunk] = np.pad(x, ((0, 0), (0, top + 1 - x.shape[1])))
                np.add.at(x[0], many, np.where(n == best, m, 0))
                np.add.at(x[1], many, m * n)
        yield from flushed()

    return stream.mapInArrow(run, "row long, n_best long, count_sum long")


def align_tokenizers(docs: DataFrame, first: str, second: str, id_column: str = "doc_id", text_column: str = "text", reach: int = 4) -> DataFrame:
    """Per document: id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256.

    first and second name tokenizer files that every executor can read. Texts that are null or empty, or that one of the
    tokenizers doesn't give back byte for byte, have no tokens: zeros and an empty groups_sha256. Ties of the best count
    all count. Repeated rows are documents of their own; other columns are not carried; an empty table gives no rows.

    The counts of a side id (at most one for each id of the other side) go to each range of `reach` input partitions
    where it occurs; so a frequent id's postings are spread over as many tasks as there are ranges.
    """
    table = written(postings(docs, first, second, id_column, text_column), "postings")
    posts = table.where("a is not null").withColumn("range", F.floor(F.shiftright("chunk", 20) / reach))
    pairs = posts.select("a", F.explode(F.arrays_zip("b", "n")).alias("p")).groupBy("a", F.col("p.b").alias("b")).agg(F.sum("p.n").alias("n"))
    counts = pairs.groupBy("a").agg(F.collect_list(F.struct("b", "n")).alias("p"))
    counts = posts.select("a", "range").distinct().join(counts, "a").select("range", "a", F.lit(None).cast("long").alias("chunk"), F.col("p.b").alias("b"), F.lit(None).cast("binary").alias("docs"), F.col("p.n").alias("n"), F.lit(None).cast("binary").alias("times"))
    both = posts.select("range", "a", "chunk", "b", "docs", F.col("n").cast("array<long>").alias("n"), "times").unionAll(counts)
    both = both.withColumn("bucket", F.pmod(F.xxhash64("a"), F.lit(BUCKETS)))
    stream = both.repartition("range", "bucket").sortWithinPartitions("range", "a", F.asc_nulls_first("chunk")).select("a", "chunk", "b", "docs", "n", "times")
    sums = contributions(stream).groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    rows = table.where("row is not null").join(sums, "row", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return rows.select(F.col("id").alias(id_column), *DOC, zero("n_best"), zero("count_sum"), "groups_sha256")
