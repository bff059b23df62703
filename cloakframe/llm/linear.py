"""Shared parts of the linear text models: labelled samples, word features, per-word caching.

The models below are linear in summed word features, so a fitted model gives every distinct word one small row
of contributions. Executors compute that row once per word and add the rows up over whole texts.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cloakframe.llm.shingles import U, mix

LETTER = regex.compile(r"\p{L}")
_POLY = U(0x9E3779B97F4A7C15)


def fold(column: str, mod: int):
    """crc32 of the id as text, modulo mod."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % mod


def sample(labels: DataFrame, texts: DataFrame, limit: int, label: str) -> list[tuple[str, object]]:
    """(text, label) of at most limit labelled documents, chosen by a hash of doc_id, in that order.

    labels has doc_id and the label, texts has doc_id and text; rows with a null in any of them are left out. The
    ids are chosen from the labels alone, so that no text moves before the choice, and no more than about twice
    limit ids reach one place.
    """
    rows = labels.where(f"doc_id is not null and `{label}` is not null").select("doc_id", F.col(label).alias("label"))
    share = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit(17)), F.lit(1 << 30)) / float(1 << 30)
    cut = min(1.0, 2 * limit / max(1, rows.count()))
    chosen = rows.withColumn("place", share).where(F.col("place") < cut).orderBy("place", "doc_id", "label").limit(limit)
    found = texts.where("text is not null").select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    got = sorted(found.select("place", "doc_id", "label", "text").collect())
    return [(r.text, r.label) for r in got[:limit]]


def word_features(words: list[str], low: int, high: int, size: int, whole: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features of words: (slots below size, number of the word each belongs to).

    Features are the character n-grams of low to high code points of "<word>" and, if whole, the word itself.
    """
    if not words:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    text = np.frombuffer("".join([f"<{w}>" for w in words]).encode("utf-32-le", "surrogatepass"), "<u4").astype(U)
    length = np.fromiter(map(len, words), np.int64, len(words)) + 2
    start = np.cumsum(length) - length
    word = np.repeat(np.arange(len(words)), length)
    left = np.repeat(start + length, length) - np.arange(len(text))  # code points from here to the word's end
    slots, owner = [], []
    for n in range(low, high + 1):
        h = np.full(max(0, len(text) - n + 1), U(n))
        for i in range(n):
            h = mix(h ^ text[i : i + len(h)])
        at = np.flatnonzero(left[: len(h)] >= n)
        slots.append((h[at] % U(size)).astype(np.int64))
        owner.append(word[at])
    if whole:
        h = np.add.reduceat(mix(text * _POLY + left.astype(U)), start)
        slots.append((mix(h) % U(size)).astype(np.int64))
        owner.append(np.arange(len(words)))
    return np.concatenate(slots), np.concatenate(owner)


def mark(name: str, size: int) -> int:
    """The slot of a named feature."""
    return zlib.crc32(name.encode()) % size


class WordRows:
    """word -> its contributions (a row of floats), computed once and kept up to a bound."""

    def __init__(self, width: int, compute: Callable[[list[str]], np.ndarray], limit: int = 300_000):
        self.compute, self.limit, self.width = compute, limit, width
        self._start()

    def _start(self) -> None:
        self.place: dict[str, int] = {}
        self.rows = np.zeros((4096, self.width))

    def prepare(self, texts: list[list[str]]) -> None:
        """Compute the unknown words of many texts at once."""
        self.of([w for t in texts for w in t])

    def of(self, words: list[str]) -> np.ndarray:
        """One row per word, in order."""
        if len(self.place) > self.limit:
            self._start()
        place = self.place
        new = list(set(words).difference(place))
        if new:
            n = len(place)
            while n + len(new) > len(self.rows):
                self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
            self.rows[n : n + len(new)] = self.compute(new)
            place.update(zip(new, range(n, n + len(new))))
        return self.rows[np.fromiter(map(place.__getitem__, words), np.int64, len(words))]
