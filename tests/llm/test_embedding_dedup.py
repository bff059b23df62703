"""Vector links against all pairs; blocks, copies, odd vectors, repeated rows, clashing columns, empty tables."""

import numpy as np

from cloakframe.llm.embedding_dedup import _placed, _units, embedding_near_dedup, train

SCHEMA = "vec_id long, embedding array<float>, label int, component_id string, uid int"


def plain(rows, least=0.98):
    """Links and components of (id, vector, label) rows by comparing all pairs."""
    ok = [v is not None and len(v) > 0 and None not in v and np.isfinite(v).all() and np.any(v) and lab is not None for _, v, lab in rows]
    links = [set() for _ in rows]
    for i, (_, v, lab) in enumerate(rows):
        for j in range(i):
            w = rows[j][1]
            if ok[i] and ok[j] and lab == rows[j][2] and len(v) == len(w):
                a, b = np.array(v, np.float64), np.array(w, np.float64)
                if a @ b / (np.sqrt(a @ a) * np.sqrt(b @ b)) >= least:
                    links[i].add(j), links[j].add(i)
    out = []
    for i, (key, _, _) in enumerate(rows):
        seen, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()] - seen:
                seen.add(j), todo.append(j)
        ids = [rows[j][0] for j in seen if rows[j][0] is not None]
        low = min(ids) if ids else None
        out.append((key, len(links[i]), low, key is not None and key == low))
    return sorted(out, key=str)


def vectors(seed, n=300, dims=24):
    """Scattered vectors, two thirds of them near copies of some at distances on both sides of the threshold."""
    r = np.random.default_rng(seed)
    base = r.normal(size=(n // 3, dims))
    rows = [(i, v) for i, v in enumerate(base)]
    for i in range(n // 3, n):
        v = base[0 if i % 2 else r.integers(len(base))]
        rows.append((i, v * r.uniform(0.5, 2) + r.normal(size=dims) * np.linalg.norm(v) / np.sqrt(dims) * r.choice([0.02, 0.1, 0.14, 0.2])))
    return [(int(i), [float(np.float32(x)) for x in v], int(r.integers(2)) if i % 2 == 0 else 0) for i, v in rows]


def got(spark, rows, **more):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)
    return sorted([tuple(r) for r in embedding_near_dedup(df, **more).collect()], key=str)


def test_links_are_those_of_all_pairs(spark):
    rows = vectors(1)
    assert got(spark, rows) == plain(rows)


def test_small_blocks_and_a_small_sample_lose_nothing(spark):
    rows = vectors(2, 240)
    assert got(spark, rows, block=16, limit=40) == plain(rows)


def test_odd_vectors_copies_and_missing_values(spark):
    one = [1.0, 2.0, 3.0, 0.0]
    rows = [
        (5, one, 1), (3, one, 1), (3, one, 1), (9, [2.0, 4.0, 6.0, 0.0], 1), (1, one, 2), (2, one, None), (None, one, 1),
        (10, None, 1), (11, [], 1), (12, [0.0] * 4, 1), (13, [1.0, None, 3.0, 0.0], 1), (14, [1.0, float("nan"), 3.0, 0.0], 1), (15, [float("inf")] * 4, 1),
        (16, [1.0, 2.0, 3.0], 1), (17, [1.0, 2.0, 3.0, 0.0, 0.0], 1), (18, [3e38, 3e38, 0.0, 0.0], 4), (19, [1e-38, 1e-38, 0.0, 0.0], 4), (None, [0.0, 0.0, 1.0, 0.0], 7),
    ]
    assert got(spark, rows) == plain(rows)


def test_empty_table(spark):
    assert got(spark, []) == []
    assert got(spark, [(1, None, 1)]) == [(1, 0, 1, True)]


def test_probes_reach_every_pair_within_the_radius():
    x = np.array([v for _, v, _ in vectors(3, 600)])
    unit = _units(list(x), 24)[0]
    index = train(unit, 20)
    own, probes, _, _ = _placed(index, unit, 0.2)
    far = np.sqrt(((unit[:, None] - unit[None]) ** 2).sum(-1))
    for i, j in zip(*np.nonzero(far <= 0.2)):
        a, b = (i, j) if own[i] <= own[j] else (j, i)
        assert own[a] == own[b] or own[b] in probes[a]
    assert np.mean([len(p) for p in probes]) < 19  # and not simply all lists
