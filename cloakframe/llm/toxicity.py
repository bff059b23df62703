"""Toxicity severity by cumulative-link ordinal regression on sparse word features.

P(grade > j) = sigmoid(w . x - t_j): all thresholds t_1 < t_2 < ... share the weights w. Features are the words
that the labelled sample ties to toxic texts; their value is 1 + log(count). Expected severity is the sum of
P(grade > j) over the thresholds.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cloakframe.llm.linear import sample
from cloakframe.runtime import frugal, ship

WORD = re.compile(r"\w+")


@dataclass
class OrdinalModel:
    place: dict[str, int]
    weights: np.ndarray
    thresholds: np.ndarray

    def features(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        found = Counter(w for w in WORD.findall(text.lower()) if w in self.place)
        return np.array([self.place[w] for w in found], np.int64), 1 + np.log(np.array(list(found.values()), float))

    def above(self, text: str) -> np.ndarray:
        """P(grade > j) for each threshold."""
        at, x = self.features(text)
        return 1 / (1 + np.exp(-np.clip(x @ self.weights[at] - self.thresholds, -50, 50)))


def fit_ordinal(texts: list[str], grades: list[int], words: list[str], epochs: int = 30, rate: float = 0.1, l2: float = 1e-4, seed: int = 11) -> OrdinalModel:
    """Maximum likelihood by AdaGrad; thresholds are kept in order as a first value and positive steps."""
    top = max(grades, default=0)
    m = OrdinalModel({w: i for i, w in enumerate(words)}, np.zeros(len(words)), np.zeros(max(top, 1)))
    data = [(*m.features(t), g) for t, g in zip(texts, grades)]
    raw = np.concatenate([[2.0], np.zeros(len(m.thresholds) - 1)])  # steps as their logarithms
    gw, gr, rng = np.full(len(words), 1e-4), np.full(len(raw), 1e-4), np.random.default_rng(seed)
    for _ in range(epochs):
        for i in rng.permutation(len(data)):
            at, x, g = data[i]
            t = raw[0] + np.concatenate([[0], np.cumsum(np.exp(raw[1:]))])
            p = 1 / (1 + np.exp(-np.clip(x @ m.weights[at] - t, -50, 50)))  # above each threshold
            # P(grade) = upper - lower, where upper and lower are neighbours in 1, p_1, ..., p_k, 0
            edge = np.concatenate([[1], p, [0]])
            chance = max(edge[g] - edge[g + 1], 1e-9)
            slope = edge * (1 - edge)
            dt = np.zeros(len(t))  # of -log likelihood by threshold
            if g > 0:
                dt[g - 1] += slope[g] / chance
            if g < len(t):
                dt[g] -= slope[g + 1] / chance
            dz = -dt.sum()
            dr = np.concatenate([[dt.sum()], np.cumsum(dt[::-1])[::-1][1:] * np.exp(raw[1:])])
            gr += dr * dr
            raw -= rate * dr / np.sqrt(gr)
            if len(at):
                d = dz * x + l2 * m.weights[at]
                gw[at] += d * d
                m.weights[at] -= rate * d / np.sqrt(gw[at])
    m.thresholds = raw[0] + np.concatenate([[0], np.cumsum(np.exp(raw[1:]))])
    return m


def cross_fitted(texts: list[str], toxic: list[int], least: int = 2) -> np.ndarray:
    """Log-odds of toxicity of each text by the words that set toxic texts apart in the other half of the texts.

    A word's weight is the logarithm of how much more often toxic texts have it; those with less than four times as often
    do not count.
    """
    half = [zlib.crc32(t.encode("utf-8", "surrogatepass")) >> 7 & 1 for t in texts]  # copies stay together
    counts = [Counter(WORD.findall(t.lower())) for t in texts]
    out = np.zeros(len(texts))
    for side in (0, 1):
        seen, size = (Counter(), Counter()), [1, 1]
        for c, h, y in zip(counts, half, toxic):
            if h != side:
                seen[y].update(c.keys())
                size[y] += 1
        odds = {w: math.log((n + 0.5) / size[1]) - math.log((seen[0][w] + 0.5) / size[0]) for w, n in seen[1].items() if n >= least}
        odds = {w: x for w, x in odds.items() if x >= math.log(4)}
        for i, (c, h) in enumerate(zip(counts, half)):
            if h == side:
                out[i] = sum(odds[w] * (1 + math.log(n)) for w, n in c.items() if w in odds)
    return out


def severity_grades(texts: list[str], toxic: list[int], levels: int = 3) -> list[int]:
    """Grade 0 for texts that are not toxic, and 1 to levels, in equal shares, for toxic ones by their cross-fitted log-odds."""
    bad = np.flatnonzero(np.array(toxic, int) == 1)
    grades = np.zeros(len(texts), int)
    if len(bad):
        odds = cross_fitted(texts, toxic)[bad]
        grades[bad] = 1 + np.searchsorted(np.quantile(odds, np.arange(1, levels) / levels), odds, side="left")
    return grades.tolist()


def fit_toxicity(docs: DataFrame, labels: DataFrame, limit: int = 8000, least: int = 4) -> OrdinalModel:
    """A model from texts (doc_id, text) and labels (doc_id, toxic 0/1): at most limit of them, chosen by a hash of doc_id.

    Feature words are in at least `least` toxic texts of the sample and mostly in toxic ones. The labels only say
    whether a text is toxic; grades 1 to 3 of toxic texts are thirds by the log-odds of another model,
    each text's from a fit to the other half of the texts. Rows with a null label or text teach
    nothing; without rows the model grades every text 0 or nearly so.
    """
    rows = sample(labels, docs, limit, "toxic")
    bad, good = Counter(), Counter()
    for text, toxic in rows:
        (bad if toxic else good).update(set(WORD.findall(text.lower())))
    size = max(1, sum(1 for _, t in rows if t)), max(1, sum(1 for _, t in rows if not t))
    words = sorted(w for w, n in bad.items() if n >= least and n / size[0] > 4 * good[w] / size[1] and n >= 2 * good[w])
    texts = [t for t, _ in rows]
    return fit_ordinal(texts, severity_grades(texts, [int(bool(t)) for _, t in rows]), words)


def grade_toxicity(docs: DataFrame, model: OrdinalModel, threshold: float = 0.35, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The carried columns, score = P(grade > 0), severity (expected grade), predicted (score >= threshold) and grade
    (0 if not predicted, else the likeliest above 0).

    A null, empty or blank text has no features: it gets the thresholds' base rate. Texts are read whole, and rows are
    answered one by one: repeated rows get equal answers, an empty table none. Columns that are not carried play no
    part; carried ones must not be called like the four new ones.
    """
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(model)
    kinds = dict(docs.dtypes)

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                b = whole.slice(at, 1024)
                p = np.array([m.above(t or "") for t in b.column(0).to_pylist()]).reshape(b.num_rows, len(m.thresholds))
                edge = np.concatenate([np.ones((len(p), 1)), p, np.zeros((len(p), 1))], 1)
                grade = np.where(p[:, 0] >= threshold, 1 + (edge[:, 1:-1] - edge[:, 2:]).argmax(1), 0)
                out = [pa.array(p[:, 0]), pa.array(p.sum(1)), pa.array(grade.astype(np.int32)), pa.array((p[:, 0] >= threshold).astype(np.int32))]
                yield pa.RecordBatch.from_arrays([b.column(j + 1) for j in range(len(carry))] + out, names=[*carry, "score", "severity", "grade", "predicted"])

    schema = ", ".join(f"`{c}` {kinds[c]}" for c in carry) + ", score double, severity double, grade int, predicted int"
    return docs.select(F.col("text").cast("string").alias("__text"), *carry).mapInArrow(run, schema)
