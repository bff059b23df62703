"""Scores of whole texts against the same models applied plainly, text by text; edge cases; held-out accuracy."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cloakframe.llm import language_id, quality
from cloakframe.llm.queries import QUERIES
from tests.llm.test_llm import words

EDGE = [(900, None), (901, ""), (902, " \n"), (903, "12 %% 34"), (904, "x" * 30_000), (5, "again and again"), (5, "again and again"), (None, "no id at all")]


@pytest.fixture(scope="module")
def table(spark):
    rng = random.Random(4)
    speech = {"en": ["the", "thing", "and", "with", "ought"], "de": ["der", "schön", "nicht", "zwei", "über"], "fr": ["été", "que", "leur", "mais", "où"]}
    rows = []
    for i in range(300):
        lang = ["en", "de", "fr"][i % 3]
        w = [rng.choice(speech[lang]) + rng.choice(["", "a", "en"]) for _ in range(rng.randint(3, 60))]
        rows.append((i, " ".join(w) + (" %%% ***" * 6 + " zz zz zz" if i % 4 == 0 else ""), lang, int(i % 4 > 0)))
    rows.append((998, " ".join(["thing and"] * 30_000), "en", 1))
    rows += [(*r, None, None) for r in EDGE]
    return spark.createDataFrame([(*r, 0.5, "x") for r in rows], "doc_id long, text string, lang string, quality int, score double, ambiguous string").cache()


def test_quality_equals_plain_scores(spark, table):
    model = quality.fit_quality(table, table)
    got = {}
    for r in quality.score_quality(table, model, 0.3, ("doc_id", "lang")).collect():
        got.setdefault(r.doc_id, []).append((r.score, r.predicted))
    rows = table.collect()
    assert sum(map(len, got.values())) == len(rows) and len(got[5]) == 3 and got[900] == got[901] == got[902]
    for r in rows:
        at, x = quality._features(r.text or "")
        z = (x @ model.vectors[at] if len(at) else np.zeros(quality.WIDTH)) @ model.layer + model.bias
        plain = 1 / (1 + np.exp(z[0] - z[1]))
        assert any(abs(s - plain) < 1e-6 and p == int(s >= 0.3) for s, p in got[r.doc_id])
    assert quality.score_quality(table.limit(0), model).count() == 0
    none = quality.fit_quality(table.limit(0), table.limit(0))
    assert {r.score for r in quality.score_quality(table, none).collect()} == {0.5}


def test_languages_equal_plain_decoding(spark, table):
    model = language_id.fit_languages(table)
    got = {}
    for r in language_id.identify_languages(table.drop("score", "ambiguous"), model, ("doc_id",)).collect():
        got.setdefault(r.doc_id, []).append((r.lang_pred, r.score))
    for r in table.collect():
        at, x = language_id._features(r.text or "")
        want = ("und", 0.0)
        if len(at):
            best, score, _ = model.decode((x @ model.weights[at] + model.bias)[None])
            want = (model.languages[best[0]], float(score[0]))
        assert any(a == want[0] and abs(s - want[1]) < 1e-6 for a, s in got[r.doc_id])
    assert got[900] == got[901] == got[903] == [("und", 0.0)] and len(got[5]) == 3


def test_ties_and_codes():
    book = language_id.code_book(4)
    assert len({tuple(c) for c in book}) == 4 and (book[0] == 1).all()
    assert len({tuple(c) for c in language_id.code_book(9)}) == 9
    model = language_id.LanguageModel(list("abcd"), book, np.zeros((1, book.shape[1])), np.zeros(book.shape[1]), np.ones(book.shape[1]))
    best, score, vague = model.decode(np.zeros((1, book.shape[1])))
    assert best[0] == 0 and score[0] == pytest.approx(0.25) and vague[0]  # of languages that tie, the first by name


def test_queries_on_held_out_rows(spark, table, tmp_path):
    table.select("doc_id", "text", "lang").write.parquet(str(tmp_path / "documents.parquet"))
    table.select("doc_id", "quality", F.lit(0).alias("toxic")).write.parquet(str(tmp_path / "labels.parquet"))
    truth = {r.doc_id: r for r in table.collect()}
    held = [r for r in QUERIES["op4_quality_classifier"](spark, str(tmp_path)).collect() if r.held_out and truth[r.doc_id].quality is not None]
    assert len(held) > 30 and np.mean([r.predicted == truth[r.doc_id].quality for r in held]) > 0.95
    held = [r for r in QUERIES["op6_language_id"](spark, str(tmp_path)).collect() if r.held_out and truth[r.doc_id].lang]
    assert len(held) > 30 and np.mean([r.lang_pred == truth[r.doc_id].lang for r in held]) > 0.95


def test_bpe_on_a_table(spark):
    import hashlib

    from tokenizers import Tokenizer

    from cloakframe.llm.bpe import bpe_round_trip
    from cloakframe.llm.queries import vocabulary

    path = vocabulary("byte_bpe_50k.json")
    lib, r = Tokenizer.from_file(path), random.Random(2)
    rows = [*EDGE, *((i, words(r, i % 30) + "\n日本 <|endoftext|>é" * (i % 3)) for i in range(60)), (950, words(r, 20_000))]
    t = spark.createDataFrame([(*x, 3, "x") for x in rows], "doc_id long, text string, n_tokens int, ids string")
    got = bpe_round_trip(t, path, ("n_tokens", "ids_sha256", "decoded_sha256")).collect()
    want = []
    for i, text in rows:
        ids = lib.encode(text or "", add_special_tokens=False).ids
        back = lib.decode(ids, skip_special_tokens=False)
        want.append((str(i), len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(back.encode()).hexdigest()))
    assert sorted((str(x.doc_id), *x[1:]) for x in got) == sorted(want)
    assert bpe_round_trip(t.limit(0), path).count() == 0
