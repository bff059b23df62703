"""Document quality from supervised subword embeddings.

A document is the mean of the learned vectors of its words, of pairs of neighbouring words, of the words' character
n-grams and of marks for words and lines that repeat at once; a softmax layer turns the mean into label probabilities. Vectors and layer are fitted
together by stochastic gradient descent in numpy. With two labels the log-odds of a document are a mean of scalar
contributions, so executors score whole texts with one scalar per distinct word and one per pair.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cloakframe.llm.linear import WordRows, mark, sample, word_features
from cloakframe.llm.shingles import U, mix
from cloakframe.runtime import frugal, ship

SLOTS, WIDTH = 1 << 17, 16
_PAIR = U(0x9FB21C651E98DF25)
_SAME_WORD, _SAME_LINE = mark("same word", SLOTS), mark("same line", SLOTS)


def _repeats(text: str, words: list[str]) -> tuple[int, int]:
    """Words, and words in lines, that equal the one just before."""
    same = sum(a == b for a, b in zip(words, words[1:]))
    lines = text.split("\n")
    return same, sum(len(a.split()) for a, b in zip(lines, lines[1:]) if a == b)


def _pairs(words: np.ndarray) -> np.ndarray:
    """Slots of the pairs of neighbours among the words' own slots."""
    return (mix((words[:-1] * SLOTS + words[1:]).astype(U) ^ _PAIR) % U(SLOTS)).astype(np.int64)


@dataclass
class QualityModel:
    vectors: np.ndarray
    layer: np.ndarray
    bias: np.ndarray

    def __post_init__(self):
        self.side = self.vectors @ (self.layer[:, 1] - self.layer[:, 0])

    def word_rows(self, words: list[str]) -> np.ndarray:
        slots, owner = word_features(words, 3, 5, SLOTS, whole=True)
        return np.stack([np.bincount(owner, self.side[slots], len(words)), np.bincount(owner, minlength=len(words)), slots[len(slots) - len(words) :]], 1)

    def score(self, text: str, words: list[str], rows: WordRows) -> float:
        total, n = 0.0, 0.0
        if words:
            own = rows.of(words)
            pairs = _pairs(own[:, 2].astype(np.int64))
            total, n = own[:, 0].sum() + self.side[pairs].sum(), own[:, 1].sum() + len(pairs)
            same, lines = _repeats(text, words)
            total += 8 * (same * self.side[_SAME_WORD] + lines * self.side[_SAME_LINE])
            n += 8 * (same + lines)
        return float(1 / (1 + np.exp(-np.clip(total / max(n, 1) + self.bias[1] - self.bias[0], -50, 50))))


def _features(text: str) -> tuple[np.ndarray, np.ndarray]:
    words = text.split()
    same, lines = _repeats(text, words)
    marks = np.repeat([_SAME_WORD, _SAME_LINE], [8 * same, 8 * lines])
    slots = word_features(words, 3, 5, SLOTS, whole=True)[0]
    at, n = np.unique(np.concatenate([slots, _pairs(slots[len(slots) - len(words) :]), marks]), return_counts=True)
    return at, n / max(1, n.sum())


def fit_quality(docs: DataFrame, labels: DataFrame, limit: int = 3000, epochs: int = 8, rate: float = 0.7, seed: int = 5) -> QualityModel:
    """A model from texts (doc_id, text) and labels (doc_id, quality 0/1): at most limit of them, chosen by a hash of doc_id.

    Rows with a null label or text teach nothing; without rows every text scores 0.5.
    """
    rows = sample(labels, docs, limit, "quality")
    rng = np.random.default_rng(seed)
    e, layer, bias = rng.uniform(-1 / WIDTH, 1 / WIDTH, (SLOTS, WIDTH)), np.zeros((WIDTH, 2)), np.zeros(2)
    data = [(*_features(t), int(q)) for t, q in rows]
    steps, done = max(1, epochs * len(data)), 0
    for _ in range(epochs):
        for i in rng.permutation(len(data)):
            at, x, q = data[i]
            lr = rate * (1 - done / steps)
            done += 1
            h = x @ e[at]
            z = h @ layer + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[q] -= 1
            back = layer @ p
            layer -= lr * np.outer(h, p)
            bias -= 0.1 * lr * p
            e[at] -= lr * np.outer(x, back)
    return QualityModel(e, layer, bias)


def score_quality(docs: DataFrame, model: QualityModel, threshold: float = 0.3, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The carried columns, score (probability of label 1) and predicted (score >= threshold) of every whole text.

    A null, empty or blank text gets the score of the bias alone. Texts are read whole, and rows are answered one by one:
    repeated rows get equal answers, an empty table none. Columns that are not carried play no part; carried ones must
    not be called like the two new ones.
    """
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(model)
    kinds = dict(docs.dtypes)

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        rows = WordRows(3, m.word_rows)
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                b = whole.slice(at, 256)
                texts = [t or "" for t in b.column(0).to_pylist()]
                words = [t.split() for t in texts]
                rows.prepare(words)
                s = [m.score(t, w, rows) for t, w in zip(texts, words)]
                out = [pa.array(s, pa.float64()), pa.array([int(x >= threshold) for x in s], pa.int32())]
                yield pa.RecordBatch.from_arrays([b.column(j + 1) for j in range(len(carry))] + out, names=[*carry, "score", "predicted"])

    schema = ", ".join(f"`{c}` {kinds[c]}" for c in carry) + ", score double, predicted int"
    return docs.select(F.col("text").cast("string").alias("__text"), *carry).mapInArrow(run, schema)
