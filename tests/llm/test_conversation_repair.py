"""Repairs against a search through all edit strings, and the damage against Python's crc32."""

import hashlib
import random
import re
import zlib

import numpy as np

from cloakframe.llm.conversation_repair import damaged, repair_batch, repair_conversations

SCHEMA = "conv_id long, turn long, role string, text string, cost string, part int"
SPACE = "\x20\x09\x0a\x0b\x0c\x0d"


def cheapest(rows):
    """(cost, audit, repaired lines) of rows (role, text, fault) by trying all edits, shortest strings first within a cost."""
    best = None
    todo = [(0, "", 0, ())]
    limit = 4 * len(rows)
    while todo:
        cost, audit, at, lines = todo.pop()
        if cost > limit or audit.endswith("III") or (best and cost > best[0]):
            continue
        if not re.match(r"^(s?(ua)*u?)?$", "".join(x[0] for x in lines)):
            continue
        if at == len(rows):
            if re.fullmatch(r"(s?(ua)+)?", "".join(x[0] for x in lines)) and (best is None or (cost, audit) < best[:2]):
                best = (cost, audit, lines)
        else:
            role, text, fault = rows[at]
            extra = 3 * (fault == "truncated")
            todo.append((cost + 4, audit + "D", at + 1, lines))
            if fault in ("", "truncated"):
                if role:
                    todo.append((cost + extra, audit + "K", at + 1, (*lines, (role[0], f"{role}:{text}"))))
                todo += [(cost + 3 + extra, audit + "R", at + 1, (*lines, (r[0], f"{r}:{text}"))) for r in ("user", "assistant")]
        todo += [(cost + 3, audit + "I", at, (*lines, (r[0], f"{r}:"))) for r in ("user", "assistant")]
    return best


def plain(rows):
    """Expected result of rows (conv_id, turn, role, text) in the operator's order."""
    talks = {}
    for row in rows:
        talks.setdefault(row[0], []).append(tuple(" " if x is None and i > 1 else x for i, x in enumerate(row)))
    out = []
    for key, talk in talks.items():
        talk.sort(key=lambda r: (r[1] is not None, r[1] or 0, r[2], hashlib.sha256(r[3].encode()).digest()))
        seen, faulty = set(), []
        for _, _, role, text in talk:
            bare = text.rstrip(SPACE)
            fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else ""
            seen.add((role, text))
            faulty.append((role, text, fault))
        turns = [r[1] for r in talk if r[1] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        count = [sum(f[2] == x for f in faulty) for x in ("blank", "duplicate", "truncated")]
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(faulty, faulty[1:]))
        cost, audit, lines = cheapest(faulty)
        out.append((key, gaps, *count, illegal, cost, audit, hashlib.sha256("\n".join(x[1] for x in lines).encode()).hexdigest()))
    return sorted(out, key=str)


def talks(seed, n=60, most=5):
    r = random.Random(seed)
    out = []
    for c in range(n):
        for t in range(r.randint(1, most)):
            turn = r.choice([t, t, t, t + 1, None])
            role = r.choice(["user", "assistant"] * 4 + ["system", "tool", "", None, "agent"])
            text = r.choice(["Yes.", "No!", "Why?", "cut off", "", " \n", None, "Well. \t", "ü… ok.", "x" * r.randint(1, 30) + "."])
            out.append((c if c else None, turn, role, text))
    return out


def got(spark, rows, **more):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)
    return sorted([tuple(r) for r in repair_conversations(df, **more).collect()], key=str)


def test_repairs_are_the_cheapest_and_first(spark):
    rows = talks(1)
    assert got(spark, rows) == plain(rows)


def test_little_room_for_texts_gives_the_same(spark):
    rows = talks(2)
    assert got(spark, rows, hold=0) == got(spark, rows, hold=60) == plain(rows)


def test_conversations_of_all_lengths_in_one_batch():
    r = random.Random(4)
    codes = [np.array([r.choice([0, 0, 1, 1, 2, 3, 8, 9, 4, 5]) for _ in range(r.choice([0, 1, 2, 3, 4, 5, 7, 9, 300]))], np.uint8) for _ in range(200)]
    together = repair_batch(codes)
    assert together == [repair_batch([c])[0] for c in codes]
    name = ["user", "assistant", "system", "tool"]
    for c, (cost, audit) in zip(codes, together):
        if len(c) < 5:
            want = cheapest([(name[x & 3], "t", "blank" if x & 4 else "truncated" if x & 8 else "") for x in c])
            assert (cost, audit.decode()) == want[:2]


def test_long_conversations_and_ties(spark):
    long = [(1, t, ["user", "assistant"][t % 2], f"turn {t}.") for t in range(3000)] + [(2, 0, "user", "Same.")] * 3 + [(3, None, "user", "a."), (3, None, "assistant", "b.")]
    a, b, c = got(spark, long, hold=500)
    assert a[:8] == (1, 0, 0, 0, 0, 0, 0, "K" * 3000)
    assert a[8] == hashlib.sha256("\n".join(f"{r}:{t}" for _, _, r, t in long[:3000]).encode()).hexdigest()
    assert b[1:8] == (0, 0, 2, 0, 2, 11, "KDDI")
    assert c[1:8] == (0, 0, 0, 0, 0, 6, "IKKI")  # ties of a turn go by role


def test_damage(spark):
    rows = [(c, t, r, x) for c in (None, *range(40)) for t in (None, 0, 1, 2, 3) for r, x in (("assistant", "One. Two? Three!"), (None, None))]
    want = []
    for c, t, r, x in rows:
        r, x = " " if r is None else r, " " if x is None else x
        k = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        x = "" if k == 1 else re.sub("[.!?]", "", x) if k == 2 else x
        want += [(c, t, "user" if k == 4 else r, x)] * (0 if k == 0 else 2 if k == 3 else 1)
    hurt = damaged(spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)).select("conv_id", "turn", "role", "text").collect()
    assert sorted(map(tuple, hurt), key=str) == sorted(want, key=str)


def test_conversations_without_rows_and_empty_tables(spark):
    empty = hashlib.sha256(b"").hexdigest()
    ids = spark.createDataFrame([(4,), (None,), (4,)], "conv_id long")
    assert got(spark, [], originals=ids) == sorted([(4, 0, 0, 0, 0, 0, 0, "", empty), (None, 0, 0, 0, 0, 0, 0, "", empty)], key=str)
    assert got(spark, []) == []
