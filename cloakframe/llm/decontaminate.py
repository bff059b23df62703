"""Benchmark passages in documents: CGK embedding, bit-sampling LSH over item-sized windows, exact verification.

Texts are word sequences. The CGK random walk copies a word of the window at each step and moves on by a random
bit of that word, which maps edit distance to Hamming distance between the copies. One repetition samples a few
steps of one walk; windows and items whose samples agree are candidates, and the repetitions are as many as the
target recall needs at the largest allowed distance, by trial on edited items in other text. Candidates are verified by the
exact edit distance between the item and its best stretch of the document.

Windows start where an item could: an item of n words within k edits keeps one of any k + 1 disjoint runs of its
words, so every window that can match has an intact run of n // (k + 1) words (three at most here) of some item.
Only windows placed by such runs are embedded; that loses nothing and spares almost all positions.

Items of a size for which no bounded number of repetitions reaches the target recall (from some 300 words on) are not
embedded: k edits spoil at most k * q of an item's runs of q words, so stretches of a document with fewer of its runs
than the rest hold no match, and all others are verified exactly.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cloakframe.llm.shingles import U, combine, hash_words, mix, split_words, text_chunks
from cloakframe.runtime import frugal, ship

_KEEP = np.full(256, 32, np.uint8)  # letters, digits and all of UTF-8 beyond ASCII stay, A-Z in lower case
for _b in [*range(48, 58), *range(97, 123), *range(128, 256)]:
    _KEEP[_b] = _b
_KEEP[65:91] = np.arange(97, 123)
_PAD = U(0x5851F42D4C957F2D)


def _words(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes and the first word of each document (one more entry: the number of words)."""
    data = _KEEP[data]
    starts, ends, doc = split_words(data, bounds)
    return hash_words(data, starts, ends), np.searchsorted(doc, np.arange(len(bounds)))


def word_sequences(texts: list[str]) -> list[np.ndarray]:
    out = []
    for _, data, bounds in text_chunks(pa.array(texts, pa.string())):
        w, first = _words(data, bounds)
        out += [w[a:b] for a, b in zip(first, first[1:])]
    return out


def _last_row(item: np.ndarray, text: np.ndarray) -> np.ndarray:
    """The least edit distance between the item and any stretch of text that ends at each place."""
    row = np.zeros(len(text) + 1, np.int64)
    step = np.arange(len(text) + 1)
    for i, x in enumerate(item):
        t = np.empty_like(row)
        t[0] = i + 1
        t[1:] = np.minimum(row[1:] + 1, row[:-1] + (text != x))
        row = np.minimum.accumulate(t - step) + step
    return row


def edit_distance(item: np.ndarray, text: np.ndarray) -> int:
    """The least edit distance between the item and any stretch of text."""
    return int(_last_row(item, text).min())


def walk(words: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int, steps: np.ndarray) -> np.ndarray:
    """One sampled CGK embedding per window: a hash of the words copied at the given steps (in order)."""
    key, i = np.zeros(len(start), U), start.copy()
    last = len(words) - 1
    wanted = set(steps.tolist())
    for j in range(int(steps.max()) + 1):
        here = np.where(i < end, words[np.minimum(i, last)], _PAD)
        if j in wanted:
            key = mix(key * U(0x9E3779B97F4A7C15) ^ here)
        i = i + ((mix(here ^ U(seed * 977 + j // 8 * 131 + 1)) >> U(j % 8)) & U(1)).astype(np.int64)
    return key


@dataclass
class Runs:
    """Runs of one length: their distinct hashes in order, and for each the rows (from cut to cut) that say where items have it.

    Of embedded items a row is (size level, place), once however many items share the run there; of exactly verified
    ones (item, place).
    """

    grams: np.ndarray
    cut: np.ndarray
    where: np.ndarray
    bitmap: np.ndarray

    @staticmethod
    def of(gram: np.ndarray, where: np.ndarray) -> Runs:
        order = np.lexsort((where[:, 1], where[:, 0], gram))
        gram, where = gram[order], where[order]
        new = np.ones(len(gram), bool)
        new[1:] = (gram[1:] != gram[:-1]) | (where[1:] != where[:-1]).any(1)
        gram, where = gram[new], where[new]
        first = np.flatnonzero(np.concatenate([[True], gram[1:] != gram[:-1]])) if len(gram) else np.zeros(0, np.int64)
        bitmap = np.zeros(1 << 20, bool)
        bitmap[(gram & U((1 << 20) - 1)).astype(np.int64)] = True
        return Runs(gram[first], np.append(first, len(gram)), where, bitmap)

    def hits(self, g: np.ndarray, allowed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in g (of those allowed) and rows of where that stand for each occurrence of a run."""
        at = np.flatnonzero(self.bitmap[(g & U((1 << 20) - 1)).astype(np.int64)])
        at = at[allowed[at]]
        if not len(at) or not len(self.grams):
            return np.zeros(0, np.int64), np.zeros((0, 2), np.int64)
        place = np.minimum(np.searchsorted(self.grams, g[at]), len(self.grams) - 1)
        hit = self.grams[place] == g[at]
        at, place = at[hit], place[hit]
        n = self.cut[place + 1] - self.cut[place]
        row = np.repeat(self.cut[place] - np.cumsum(n) + n, n) + np.arange(n.sum())
        return np.repeat(at, n), self.where[row]


@dataclass
class Items:
    """A block of benchmark items with its run index and LSH tables."""

    ids: list[int]
    words: list[np.ndarray]
    allowed: np.ndarray
    runs: dict[int, Runs] = field(default_factory=dict)
    tables: list[tuple[int, int, list[tuple[int, np.ndarray, np.ndarray, np.ndarray]]]] = field(default_factory=list)
    exact: set[int] = field(default_factory=set)  # size levels without tables: each placed window is verified
    exact_runs: dict[int, Runs] = field(default_factory=dict)


def _edited(w: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    w = list(w)
    for _ in range(k):
        at, kind = int(rng.integers(0, len(w) + 1)), int(rng.integers(0, 3))
        if kind == 0 or not w:
            w.insert(at, U(rng.integers(1, 1 << 62)))
        elif kind == 1:
            del w[min(at, len(w) - 1)]
        else:
            w[min(at, len(w) - 1)] = U(rng.integers(1, 1 << 62))
    return np.array(w, U)


def _place_runs(items: Items, level: np.ndarray) -> None:
    by: dict[int, list[int]] = {}
    for n, w in enumerate(items.words):
        by.setdefault(max(1, min(3, len(w) // (int(items.allowed[n]) + 1))), []).append(n)
    for q, members in by.items():
        gram = np.concatenate([combine(items.words[n], q) for n in members])
        item = np.repeat(members, [len(items.words[n]) - q + 1 for n in members])
        at = np.concatenate([np.arange(len(items.words[n]) - q + 1) for n in members])
        apart = np.isin(level[item], sorted(items.exact))
        items.runs[q] = Runs.of(gram[~apart], np.stack([level[item], at], 1)[~apart])
        items.exact_runs[q] = Runs.of(gram[apart], np.stack([item, at], 1)[apart])


def index_items(ids: list[int], texts: list[str], share: float = 0.2, recall: float = 0.98, samples: int = 3, seed: int = 23) -> Items:
    """Items without a word match nothing and are left out. share bounds the edits of an item by its words."""
    seqs = word_sequences([t or "" for t in texts])
    kept = [i for i, s in enumerate(seqs) if len(s)]
    items = Items([ids[i] for i in kept], [seqs[i] for i in kept], np.array([int(share * len(seqs[i])) for i in kept], np.int64))
    rng = np.random.default_rng(seed)
    size = np.array([len(w) for w in items.words])
    level = np.floor(np.log2(np.maximum(size, 1))).astype(int) if len(size) else size
    _place_runs(items, level)
    for lv in np.unique(level):
        members = np.flatnonzero(level == lv)
        least = 1 << int(lv)
        flat = np.concatenate([items.words[m] for m in members])
        end = np.cumsum(size[members])
        start = end - size[members]
        back = {int(m): i for i, m in enumerate(members)}
        source = np.array([back[int(m)] for m in rng.choice(members, 200)])
        trial = [_edited(items.words[members[m]], int(items.allowed[members[m]]), rng) for m in source]
        # edited items between other words: they are found by the windows that their runs place, like any text
        text = [x for t in trial for x in (rng.integers(1, 1 << 62, 12).astype(U), t, rng.integers(1, 1 << 62, 12).astype(U))]
        tfirst = np.concatenate([[0], np.cumsum([len(x) for x in text])[2::3]])
        tflat = np.concatenate(text)
        tstart = _windows(items, tflat, tfirst)[0].get(int(lv), np.zeros(0, np.int64))
        tdoc = np.searchsorted(tfirst, tstart, side="right") - 1
        tables, missed = [], np.ones(len(trial), bool)
        allowed = (1 - recall) / 2  # a trial of 200 may err by as much again
        while missed.mean() > allowed and len(tables) < 96:
            steps = np.sort(rng.choice(max(samples, int(1.6 * least)), min(samples, max(1, least)), replace=False))
            s = int(rng.integers(1, 1 << 30))
            keys = walk(flat, start, end, s, steps)
            missed[tdoc[walk(tflat, tstart, tfirst[tdoc + 1], s, steps) == keys[source[tdoc]]]] = False
            order = np.argsort(keys, kind="stable")
            tables.append((s, steps, keys[order], members[order]))
        if missed.mean() > allowed:
            items.exact.add(int(lv))
        else:
            items.tables.append((int(lv), least, tables))
    _place_runs(items, level)
    return items


def _windows(items: Items, w: np.ndarray, first: np.ndarray) -> tuple[dict[int, np.ndarray], np.ndarray]:
    """Starts of the windows to embed, by the size level of the items they could hold; runs of exactly verified items.

    A row per run: document, item, q, and where the item would start if nothing before the run were edited.
    """
    found: dict[int, list[np.ndarray]] = {}
    runs = [np.zeros((0, 4), np.int64)]
    if not len(w):
        return {}, runs[0]
    doc = np.searchsorted(first, np.arange(len(w)), side="right") - 1
    for q in items.runs:
        g = combine(w, q)
        whole = doc[: len(g)] == doc[q - 1 :]
        at, where = items.runs[q].hits(g, whole)
        start = np.maximum(at - where[:, 1], first[doc[at]])
        for lv in np.unique(where[:, 0]):
            found.setdefault(int(lv), []).append(np.unique(start[where[:, 0] == lv]))
        at, where = items.exact_runs[q].hits(g, whole)
        runs.append(np.stack([doc[at], where[:, 0], np.full(len(at), q), at - where[:, 1]], 1))
    return {lv: np.unique(np.concatenate(s)) for lv, s in found.items()}, np.concatenate(runs)


def _exact_matches(items: Items, w: np.ndarray, first: np.ndarray, runs: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
    """As match_documents, of the items whose runs are given: every stretch with enough of an item's runs is verified."""
    runs = runs[np.lexsort((runs[:, 3], runs[:, 1], runs[:, 0]))]
    cut = np.flatnonzero(np.concatenate([[True], (runs[1:, :2] != runs[:-1, :2]).any(1), [True]])) if len(runs) else []
    for lo, hi in zip(cut, cut[1:]):
        d, m, q, _ = runs[lo].tolist()
        item, k = items.words[m], int(items.allowed[m])
        need = len(item) - q + 1 - k * q
        if hi - lo < need:
            continue
        at = runs[lo:hi, 3]
        end = np.searchsorted(at, at + 2 * k, side="right")  # the runs of one match shift by at most k either way
        stretches: list[list[int]] = []
        for i in np.flatnonzero(end - np.arange(len(at)) >= need).tolist():
            a, b = max(int(first[d]), int(at[i]) - k), min(int(first[d + 1]), int(at[end[i] - 1]) + len(item) + 2 * k)
            if stretches and a <= stretches[-1][1]:
                stretches[-1][1] = max(b, stretches[-1][1])
            else:
                stretches.append([a, b])
        best = (k + 1, 0)
        for a, b in stretches:
            x = edit_distance(item, w[a:b])
            if x < best[0]:
                # the closest stretch ends at the first least entry; read backwards, so does its start
                stop = a + int(np.argmin(_last_row(item, w[a:b])))
                back = _last_row(item[::-1], w[a:stop][::-1])
                best = (x, stop - int(np.argmin(back)) - int(first[d]))
        if best[0] <= k:
            yield d, m, *best


def match_documents(items: Items, w: np.ndarray, first: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
    """(document, item, distance, first word of the window) of the items that documents hold, closest window each."""
    windows, runs = _windows(items, w, first)
    exact = list(_exact_matches(items, w, first, runs))
    pairs = []
    for lv, _, tables in items.tables:
        start = windows.get(lv)
        if start is None:
            continue
        end = first[np.searchsorted(first, start, side="right")]
        for seed, steps, keys, members in tables:
            k = walk(w, start, end, seed, steps)
            lo, hi = np.searchsorted(keys, k, side="left"), np.searchsorted(keys, k, side="right")
            hit = np.flatnonzero(hi > lo)
            n = (hi - lo)[hit]
            row = np.repeat(lo[hit] - np.cumsum(n) + n, n) + np.arange(n.sum())
            pairs.append(np.stack([np.repeat(start[hit], n), members[row]], 1))
    p = np.unique(np.concatenate(pairs), axis=0) if pairs else np.zeros((0, 2), np.int64)
    best: dict[tuple[int, int], tuple[int, int]] = {}
    for s, m in p.tolist():
        d = int(np.searchsorted(first, s, side="right")) - 1
        item, k = items.words[m], int(items.allowed[m])
        if best.get((d, m), (k + 1, 0))[0] == 0:
            continue
        a, b = max(int(first[d]), s - k), min(int(first[d + 1]), s + len(item) + 2 * k)
        part = w[a:b]
        if np.isin(item, part).sum() < len(item) - k:  # too few words in common for k edits
            continue
        x = edit_distance(item, part)
        if x <= k and x < best.get((d, m), (k + 1, 0))[0]:
            best[d, m] = (x, s - int(first[d]))
    yield from sorted([*exact, *((d, m, x, s) for (d, m), (x, s) in best.items())])


def contaminated(docs: DataFrame, benchmark: DataFrame, share: float = 0.2, recall: float = 0.98, block: int = 20_000) -> DataFrame:
    """One row per document and benchmark item it holds: doc_id, item_id, distance, start (word of the window).

    distance is in words and at most share of the item's words; case and punctuation do not count. Null and
    wordless texts and items match nothing; repeated documents are each answered; further columns play no part. Texts are
    taken whole, whatever their length. An empty table of either kind gives an empty result.
    The items are taken in blocks of about `block`, and a task holds one block at a time, whatever the benchmark's size;
    the documents are read and hashed once for all blocks.
    """
    spark = docs.sparkSession
    ship(spark)
    kind = "string" if dict(docs.dtypes)["doc_id"] == "string" else "long"
    id_type = pa.string() if kind == "string" else pa.int64()
    docs = docs.select(F.col("doc_id").cast(kind).alias("doc_id"), F.col("text").cast("string").alias("text"))
    benchmark = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("item_id is not null and text is not null")
    blocks = max(1, -(-benchmark.count() // block))
    shared = []
    for n in range(blocks):
        rows = benchmark.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == n).distinct().orderBy("item_id", "text").collect()
        shared.append(spark.sparkContext.broadcast(index_items([r.item_id for r in rows], [r.text for r in rows], share, recall)))

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def close() -> Iterator[pa.RecordBatch]:
            for one in shared:
                items = one.value
                for ids, w, first in held:
                    found = list(match_documents(items, w, first)) if items.words else []
                    d, m, x, s = zip(*found) if found else ((), (), (), ())
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([ids[i] for i in d], id_type), pa.array([items.ids[i] for i in m], pa.int64()), pa.array(x, pa.int32()), pa.array(s, pa.int32())],
                        names=["doc_id", "item_id", "distance", "start"],
                    )
                if len(shared) > 1:
                    del items, one._value  # read again for the next documents

        for b in batches:
            ids = b.column(0).to_pylist()
            for at, data, bounds in text_chunks(b.column(1)):
                held.append((ids[at : at + len(bounds) - 1], *_words(data, bounds)))
                size += len(data)
                if len(shared) == 1 or size > 32 << 20:
                    yield from close()
                    held, size = [], 0
        yield from close()

    return docs.mapInArrow(run, f"doc_id {kind}, item_id long, distance int, start int")
