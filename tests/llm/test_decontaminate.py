"""contaminated() against the least edit distance of every item to every stretch of every document, by plain Python."""

import random

from cloakframe.llm.decontaminate import contaminated
from tests.llm.test_llm import words


def plain_words(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c if c.isascii() and c.isalnum() or ord(c) > 127 else " " for c in text or "").split()


def least(item, doc):
    row = [0] * (len(doc) + 1)
    for i, x in enumerate(item):
        new = [i + 1]
        for j, y in enumerate(doc):
            new.append(min(row[j + 1] + 1, new[j] + 1, row[j] + (x != y)))
        row = new
    return min(row)


def edited(w, k, r):
    w = list(w)
    for _ in range(k):
        kind, at = r.randrange(3), r.randrange(len(w))
        if kind == 0:
            w.insert(at, words(r, 1))
        elif kind == 1:
            del w[at]
        else:
            w[at] = words(r, 1)
    return w


def test_equals_all_windows_at_every_distance(spark):
    r = random.Random(9)
    shared = words(r, 4)
    items = [f"{shared} {words(r, n)}" for n in (3, 6, 11, 16, 26)] + ["", None, "...", f"{shared} {words(r, 6)}"]
    docs = []
    for i in range(120):
        item = plain_words(items[(0, 1, 2, 3, 4, 8)[i % 6]])
        k = r.randint(0, len(item) // 5 + 2)
        docs.append(f"{words(r, r.randint(0, 20))} {' '.join(edited(item, k, r)).upper()}! {words(r, r.randint(0, 20))}")
    rows = [(i, t) for i, t in enumerate(docs)] + [(200, None), (201, ""), (202, "?!"), (203, shared), (5, docs[5]), (None, items[2])]
    rows.append((204, f"{words(r, 30_000)} {items[3]} {words(r, 10)}"))
    t = spark.createDataFrame([(*x, 1, "c") for x in rows], "doc_id long, text string, item_id int, start string")
    bench = spark.createDataFrame([(i, x, "c") for i, x in enumerate(items)] + [(3, items[3], "again")], "item_id long, text string, distance string")
    want = set()
    for d, text in rows:
        for i, x in enumerate(items):
            w = plain_words(x)
            if w and text and d != 204 and (n := least(w, plain_words(text))) <= len(w) // 5:
                want.add((d, i, n))
    want.add((204, 3, 0))
    got = [(x.doc_id, x.item_id, x.distance) for x in contaminated(t, bench).collect()]
    found = set(got)
    assert found <= want and len(found) >= 0.97 * len(want)  # every answer is exact; recall is that of the repetitions
    assert got.count((5, *next(x for x in want if x[0] == 5)[1:])) == 2 and (None, 2, 0) in found
    assert {x for x in want if x[2] == 0} <= found and {x[2] for x in want} >= {0, 1, 2, 3}
    split = {(x.doc_id, x.item_id, x.distance) for x in contaminated(t, bench, block=2).collect()}
    assert split <= want and len(split) >= 0.97 * len(want)


def test_empty_tables(spark):
    t = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    b = spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    assert contaminated(t.limit(0), b).count() == contaminated(t, b.limit(0)).count() == 0
    assert [tuple(x) for x in contaminated(t, b).collect()] == [(1, 1, 0, 0)]
