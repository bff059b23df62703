"""Ordinal grades on planted texts, held out; nulls, empty and long texts, repeated rows, clashing columns, empty tables."""

import random

import numpy as np

from cloakframe.llm.toxicity import fit_ordinal, fit_toxicity, grade_toxicity, severity_grades
from tests.llm.test_llm import words

BAD = ["idiot", "scum", "vermin", "moron", "filth"]


def planted(n, seed):
    r = random.Random(seed)
    out = []
    for i in range(n):
        k = r.choice([0, 0, 1, 2, 4])
        w = words(r, r.randint(5, 60)).split() + [r.choice(BAD) for _ in range(k)]
        r.shuffle(w)
        out.append((i, " ".join(w), int(k > 0), k))
    return out


def test_grades_follow_the_planted_severity(spark):
    train = spark.createDataFrame([(*r[:3], 0) for r in planted(600, 1)], "doc_id long, text string, toxic int, grade int")
    model = fit_toxicity(train, train)
    assert all(np.diff(model.thresholds) > 0)
    held = planted(300, 2)
    rows = [r[:3] for r in held] + [(900, None, None), (901, "", None), (902, " \n", None), (903, words(random.Random(1), 30_000) + " scum", None), (5, held[5][1], 0)]
    got = grade_toxicity(spark.createDataFrame(rows, "doc_id long, text string, toxic int"), model).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == len(rows) and {r.severity for r in got if r.doc_id == 5} == {by[5].severity}
    assert all(by[i].predicted == y == int(by[i].grade > 0) for i, _, y, _ in held) and by[903].predicted == 1
    assert by[900].severity == by[901].severity == by[902].severity < 0.5
    mean = [np.mean([by[i].severity for i, _, _, k in held if k == n]) for n in (0, 1, 2, 4)]
    assert mean == sorted(mean) and mean[3] - mean[1] > 0.5


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string, toxic int")
    model = fit_toxicity(none, none)
    assert grade_toxicity(none, model).count() == 0
    assert [r.grade for r in grade_toxicity(spark.createDataFrame([(1, "any")], "doc_id long, text string"), model).collect()] == [0]
    assert severity_grades([], []) == [] and len(fit_ordinal([], [], []).thresholds) == 1
