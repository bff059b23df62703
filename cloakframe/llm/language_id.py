"""Language identification with error-correcting output codes over hashed character n-grams."""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cloakframe.llm.linear import LETTER, WordRows, sample, word_features
from cloakframe.runtime import frugal, ship

SLOTS = 1 << 16


def code_book(classes: int, seed: int = 7) -> np.ndarray:
    """Codewords of -1 and 1, a row per class: every split of the classes up to 6, else random distinct splits."""
    if classes <= 6:
        bits = [b for b in itertools.product((-1, 1), repeat=classes) if b[0] == 1 and -1 in b]
    else:
        rng, seen = np.random.default_rng(seed), set()
        while len(seen) < 10 * int(np.ceil(np.log2(classes))):
            b = tuple(rng.choice((-1, 1), classes) * 1)
            if abs(sum(b)) < classes - 1:
                seen.add(b if b[0] == 1 else tuple(-x for x in b))
        bits = sorted(seen)
    return np.array(bits or [(1,)], float).T


@dataclass
class LanguageModel:
    languages: list[str]
    book: np.ndarray
    weights: np.ndarray  # a row per slot, a column per bit
    bias: np.ndarray
    trust: np.ndarray  # weight of each bit's loss

    def word_rows(self, words: list[str]) -> np.ndarray:
        """Each word's summed n-gram weights for each bit, and its number of n-grams (0 without a letter)."""
        slots, owner = word_features([w if LETTER.search(w) else "" for w in words], 1, 3, SLOTS)
        out = np.stack([np.bincount(owner, c, len(words)) for c in (*self.weights[slots].T, np.ones(len(slots)))], 1)
        out[[not LETTER.search(w) for w in words]] = 0
        return out

    def decode(self, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Best class, its score (0 to 1) and the ambiguity flag of each row of bit margins.

        The loss of a class is the trust-weighted logistic loss of the margins against its codeword.
        """
        loss = np.logaddexp(0, -margins[:, None, :] * self.book[None]) @ self.trust
        p = np.exp(loss.min(1, keepdims=True) - loss)
        p /= p.sum(1, keepdims=True)
        best = p.argmax(1)
        top = p[np.arange(len(p)), best]
        second = np.partition(p, -2, 1)[:, -2] if p.shape[1] > 1 else np.zeros(len(p))
        return best, top, top - second < 0.2


def _words(text: str) -> list[str]:
    return text.lower().split()


def _features(text: str) -> tuple[np.ndarray, np.ndarray]:
    at, n = np.unique(word_features([w for w in _words(text) if LETTER.search(w)], 1, 3, SLOTS)[0], return_counts=True)
    return at, n / max(1, n.sum())


def fit_languages(docs: DataFrame, limit: int = 2000, epochs: int = 12, seed: int = 3) -> LanguageModel:
    """A model from rows (doc_id, text, lang): at most limit of them, chosen by a hash of doc_id.

    Rows with a null lang or without a letter teach nothing. Each bit is a logistic regression on n-gram shares,
    fitted by AdaGrad; its trust is its accuracy on the sample above chance.
    """
    rows = [(t, lang) for t, lang in sample(docs.select("doc_id", "lang"), docs, limit, "lang") if LETTER.search(t)]
    languages = sorted({lang for _, lang in rows}) or ["und"]
    book = code_book(len(languages))
    data = [_features(t) for t, _ in rows]
    y = np.array([languages.index(lang) for _, lang in rows], int)
    w, b = np.zeros((SLOTS, book.shape[1])), np.zeros(book.shape[1])
    grad2, rng = np.full(SLOTS, 1e-6), np.random.default_rng(seed)
    for _ in range(epochs):
        for i in rng.permutation(len(data)):
            at, x = data[i]
            m = x @ w[at] + b
            g = -book[y[i]] / (1 + np.exp(book[y[i]] * m))
            grad2[at] += x * x
            w[at] -= 0.5 * (x / np.sqrt(grad2[at]))[:, None] * g
            b -= 0.02 * g
    right = np.array([np.sign(x @ w[at] + b) == book[c] for (at, x), c in zip(data, y)]).reshape(-1, book.shape[1]).mean(0) if data else np.ones(book.shape[1])
    trust = np.maximum(right - 0.5, 0.05)
    return LanguageModel(languages, book, w, b, trust / trust.mean())


def identify_languages(docs: DataFrame, model: LanguageModel, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The carried columns, lang_pred, score and ambiguous (two languages nearly tie) of every whole text.

    A null text and one without a letter are `und` with score 0. Rows are answered one by one, so repeated rows
    get equal answers and an empty table gives none; columns that are not carried play no part, and
    carried ones must not be called like the three new ones.
    """
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(model)
    kinds = dict(docs.dtypes)
    at_text = carry.index("text") if "text" in carry else len(carry)

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        rows = WordRows(len(m.bias) + 1, m.word_rows)
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                b = whole.slice(at, 256)
                total = np.zeros((b.num_rows, len(m.bias) + 1))
                texts = [_words(t or "") for t in b.column(at_text).to_pylist()]
                rows.prepare(texts)
                for i, words in enumerate(texts):
                    total[i] = rows.of(words).sum(0)
                n = total[:, -1]
                best, score, vague = m.decode(total[:, :-1] / np.maximum(n, 1)[:, None] + m.bias)
                none = n == 0
                lang = [("und" if z else m.languages[k]) for k, z in zip(best, none)]
                out = [pa.array(lang), pa.array(np.where(none, 0.0, score)), pa.array(vague & ~none)]
                yield pa.RecordBatch.from_arrays([b.column(j) for j in range(len(carry))] + out, names=[*carry, "lang_pred", "score", "ambiguous"])

    schema = ", ".join(f"`{c}` {kinds[c]}" for c in carry) + ", lang_pred string, score double, ambiguous boolean"
    return docs.select(*carry, *([] if "text" in carry else ["text"])).mapInArrow(run, schema)
