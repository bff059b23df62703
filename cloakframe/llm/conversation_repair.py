"""Cheapest repair of conversations by dynamic programming over many of them at once.

The roles of a sound conversation read (s?(ua)+)?. Four states say what has come so far: nothing, a system turn, a
user turn, an assistant turn. In each state just one of user and assistant may follow, so that a string of edits (Keep,
Rerole, Delete, Insert) fixes the repaired roles. Costs run backward over the turns of all conversations of similar
length, one array operation for each turn; the edits are then traced forward, in each step the first letter that keeps
the cost least, which gives the least string among the cheapest.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cloakframe.runtime import frugal, ship

BLANK = r"^[\x20\x09-\x0D]*\z"
CUT = r"[^.!?\x20\x09-\x0D][\x20\x09-\x0D]*\z"  # the last character that is no white space ends no sentence
NEXT = np.array([2, 2, 3, 2])  # the state after the role that each state needs
NEEDS = "uuau"
FAR = 1 << 29
# a row's code: its role initial (0 user, 1 assistant, 2 system, 3 other), 4 if it must go, 8 if it is truncated
GOES, TRUNCATED = 4, 8


def _choices(code: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For rows of one turn and each state: the cost of keeping, the state after it, the cost of a new role."""
    initial = (code & 3)[:, None]
    state = np.arange(4)[None]
    fits = np.where(NEXT[None] == 3, initial == 1, initial == 0)
    opens = (initial == 2) & (state == 0)
    extra = np.where(code & TRUNCATED, 3, 0)[:, None]
    stays = ((code & GOES) == 0)[:, None]
    keep = np.where(stays & (fits | opens), extra, FAR)
    return keep, np.where(opens, 1, NEXT[None]), np.where(stays, 3 + extra, FAR) + 0 * state


def _inserted(cost: np.ndarray) -> np.ndarray:
    """Least costs if turns may be put in first; more than two in a row never pay."""
    for _ in range(2):
        cost = np.minimum(cost, 3 + cost[:, NEXT])
    return cost


def repair_batch(codes: list[np.ndarray]) -> list[tuple[int, bytes]]:
    """The least cost and the first of the cheapest edit strings of each conversation, given its rows' codes.

    Conversations are dealt to buckets by length; a bucket's steps run from its longest conversation's last turn on, and
    shorter ones join in when their own last turn comes.
    """
    out: list[tuple[int, bytes]] = [(0, b"")] * len(codes)
    size = np.array([len(c) for c in codes], np.int64)
    bucket = np.ceil(np.log2(np.maximum(size, 1))).astype(int)
    for k in np.unique(bucket[size > 0]):
        at = np.flatnonzero((bucket == k) & (size > 0))
        step = max(1, (1 << 20) >> int(k))
        for i in range(0, len(at), step):
            some = at[i : i + step]
            for j, found in zip(some, _repair(codes, some, size[some])):
                out[j] = found
    return out


def _repair(codes: list[np.ndarray], some: np.ndarray, size: np.ndarray) -> list[tuple[int, bytes]]:
    turns, n = int(size.max()), len(some)
    code = np.zeros((turns, n), np.uint8)  # time first
    for j, c in enumerate(some):
        code[: size[j], j] = codes[c]
    costs = np.empty((turns + 1, n, 4), np.int32)  # of the rest, from each turn and state on
    costs[turns] = _inserted(np.array([[0, FAR, FAR, 0]], np.int32))
    for t in range(turns - 1, -1, -1):
        rest = costs[t + 1]
        keep, after, put = _choices(code[t])
        cost = np.minimum(np.minimum(4 + rest, keep + np.take_along_axis(rest, after, 1)), put + rest[:, NEXT])
        costs[t] = np.where((t < size)[:, None], _inserted(cost), rest)

    state, turn, used = (np.zeros(n, np.int64) for _ in range(3))
    letters = np.zeros((n, 3 * turns + 2), np.uint8)
    who = np.arange(n)
    while len(who):
        t, s = turn[who], state[who]
        more, one = t < size[who], np.arange(len(who))
        now, rest = costs[t, who, s], costs[np.minimum(t + 1, turns), who]
        keep, after, _ = (x[one, s] for x in _choices(code[np.minimum(t, turns - 1), who]))
        drops = more & (4 + rest[one, s] == now)
        puts_in = ~drops & (3 + costs[t, who, NEXT[s]] == now)
        keeps = ~drops & ~puts_in & more & (keep + rest[one, after] == now)
        turns_to = ~drops & ~puts_in & ~keeps & more
        on = more | puts_in
        letters[who[on], used[who[on]]] = np.select([drops, puts_in, keeps, turns_to], [ord(x) for x in "DIKR"], 0)[on]
        used[who] += on
        state[who] = np.select([puts_in | turns_to, keeps], [NEXT[s], after], s)
        turn[who] = t + (more & ~puts_in)
        who = who[on]
    return [(int(costs[0, j, 0]), letters[j, : used[j]].tobytes()) for j in range(n)]


def damaged(rows: DataFrame, id_column: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """The rows with faults put in by crc32 of `id:turn` modulo 20 (a null counts as a space there, and as role and text).

    0 drops a row, 1 empties its text, 2 takes the sentence ends out of it, 3 repeats the row, 4 makes it a user's.
    The id, turn, role and text of those that stay, and copy (1 for a repeated row).
    """
    some = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(some(id_column), F.lit(":"), some(turn)).cast("binary")) % 20
    new = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(some(text), "[.!?]", "")).otherwise(some(text))
    copies = F.when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    hurt = rows.select(F.col(id_column), F.col(turn), kind.alias("__kind"), F.when(kind == 4, "user").otherwise(some(role)).alias(role), new.alias(text), copies.alias("__copies"))
    return hurt.where("__kind <> 0").select(id_column, turn, role, text, F.explode("__copies").alias("copy"))


def repair_conversations(rows: DataFrame, originals: DataFrame | None = None, id_column: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", hold: int = 8 << 20) -> DataFrame:
    """Per conversation its faults and its cheapest repair: id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    Rows are taken by turn (nulls first), then role, text and copy (a column of rows, or 0). A row's first fault counts:
    blank, duplicate of an earlier row's role and text, truncated. Blank and duplicate rows must go. Nulls in role and
    text count as one space; a role that begins with none of u, a and s (an empty one too) can't be kept. A null id is a
    conversation of its own. Conversations of originals (any table with the id column) without a row here give zeros, an
    empty audit and the hash of nothing. An empty table gives no rows; other columns are not carried.

    Each conversation is one sorted stream: first its rows' codes (a byte each, no text), which the dynamic
    programme needs together, then its rows with their texts, which go through the hash one by one. A task holds at most
    hold characters of the texts of short conversations, and some forty bytes for each row of the longest conversation; a
    hash over a whole conversation cannot be shared between tasks. Duplicates are found before that, by role and digest.
    """
    ship(rows.sparkSession)
    kind = dict(rows.dtypes)[id_column]
    some = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    copy = F.col("copy") if "copy" in rows.columns else F.lit(0)
    base = rows.select(F.col(id_column).alias("id"), F.col(turn).alias("turn"), some(role).alias("role"), some(text).alias("text"), copy.cast("int").alias("copy"))
    base = base.withColumn("digest", F.unhex(F.sha2("text", 256)))
    order = [F.asc_nulls_first("turn"), F.asc("role"), F.asc("digest"), F.asc("copy")]
    light = base.select("id", "turn", "role", "digest", "copy", F.col("text").rlike(BLANK).alias("blank"), F.col("text").rlike(CUT).alias("cut"))
    again = F.row_number().over(Window.partitionBy("id", "role", "digest").orderBy(F.asc_nulls_first("turn"), F.asc("copy"))) > 1
    light = light.withColumn("again", again)
    initial = F.substring("role", 1, 1)
    code = F.when(initial == "u", 0).when(initial == "a", 1).when(initial == "s", 2).otherwise(3)
    fault = F.when(F.col("blank"), GOES + 16).when(F.col("again"), GOES + 32).when(F.col("cut"), TRUNCATED).otherwise(0)
    none = F.lit(None).cast("string")
    stream = light.select("id", F.lit(0).alias("part"), "turn", "role", "digest", "copy", (code + fault).cast("int").alias("code"), none.alias("text"))
    stream = stream.unionByName(base.select("id", F.lit(1).alias("part"), "turn", "role", "digest", "copy", F.lit(None).cast("int").alias("code"), "text"))
    if originals is not None:
        ids = originals.select(F.col(id_column).cast(kind).alias("id")).distinct()
        stream = stream.unionByName(ids.select("id", F.lit(-1).alias("part")), allowMissingColumns=True)
    stream = stream.repartition("id").sortWithinPartitions(F.asc_nulls_first("id"), "part", *order)
    stream = stream.select("id", "part", F.col("turn").cast("long").alias("turn"), "code", "role", "text")
    schema = f"`{id_column}` {kind}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        id_type = None
        talks: list[_Talk] = []  # those that wait for their repair, in order; the last may still be read
        held = 0
        done: list[tuple] = []

        def settle(talks: list[_Talk]) -> None:
            talks = [t for t in talks if t.audit is None]
            for t, (cost, audit) in zip(talks, repair_batch([t.kinds() for t in talks])):
                t.begin(cost, audit)

        for b in batches:
            id_type = b.schema.field(0).type
            for id_, part, turn_, code_, role_, text_ in zip(*(c.to_pylist() for c in b.columns)):
                if not talks or talks[-1].id != id_:
                    if held > hold or len(talks) >= 4096:
                        settle(talks)
                        done += [t.result() for t in talks]
                        talks, held = [], 0
                    talks.append(_Talk(id_))
                last = talks[-1]
                if part == 0:
                    last.code(code_, turn_)
                elif part == 1:
                    last.text(role_, text_)
                    if last.audit is None:
                        held += len(role_) + len(text_)
                        if held > hold:  # of the last one all codes are known, and its other texts go straight into its hash
                            settle(talks)
                            done += [t.result() for t in talks[:-1]]
                            talks = talks[-1:]
                            held = 0
            if len(done) >= 4096:
                yield _batch(done, id_type, id_column)
                done = []
        settle(talks)
        done += [t.result() for t in talks]
        if done:
            yield _batch(done, id_type, id_column)

    return stream.mapInArrow(run, schema)


def _batch(rows: list[tuple], id_type: pa.DataType, id_column: str) -> pa.RecordBatch:
    names = [id_column, "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    kinds = [id_type, *[pa.int64()] * 6, pa.string(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)


class _Talk:
    """One conversation on its way through a task."""

    def __init__(self, id_):
        self.id, self.audit = id_, None
        self.codes = bytearray()
        self.low = self.high = self.before = None
        self.distinct = 0
        self.waiting: list[tuple[str, str]] = []

    def code(self, code: int, turn: int | None) -> None:
        self.codes.append(code)
        if turn is not None:  # turns come in order
            self.low = turn if self.low is None else self.low
            self.high = turn
            self.distinct += turn != self.before
            self.before = turn

    def kinds(self) -> np.ndarray:
        return np.frombuffer(bytes(self.codes), np.uint8) & 15

    def text(self, role: str, text: str) -> None:
        if self.audit is None:
            self.waiting.append((role, text))
        else:
            self._row(role, text)

    def begin(self, cost: int, audit: bytes) -> None:
        self.cost, self.audit = cost, audit
        self.at = self.state = 0
        self.empty = True
        self.sha = hashlib.sha256()
        for role, text in self.waiting:
            self._row(role, text)
        self.waiting = []

    def _out(self, line: str) -> None:
        self.sha.update((line if self.empty else "\n" + line).encode())
        self.empty = False

    def _insert(self) -> None:
        while self.at < len(self.audit) and self.audit[self.at] == 73:  # I
            self._out(("assistant" if NEEDS[self.state] == "a" else "user") + ":")
            self.state = int(NEXT[self.state])
            self.at += 1

    def _row(self, role: str, text: str) -> None:
        self._insert()
        edit = chr(self.audit[self.at])
        self.at += 1
        if edit == "K":
            opens = role[0] == "s"
            self._out(f"{role}:{text}")
            self.state = 1 if opens else int(NEXT[self.state])
        elif edit == "R":
            self._out(f"{'assistant' if NEEDS[self.state] == 'a' else 'user'}:{text}")
            self.state = int(NEXT[self.state])

    def result(self) -> tuple:
        self._insert()
        code = np.frombuffer(bytes(self.codes), np.uint8)
        initial = code & 3
        pair = initial[:-1] * 4 + initial[1:]
        illegal = int(np.isin(pair, [2 * 4 + 0, 0 * 4 + 1, 1 * 4 + 0], invert=True).sum())
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.distinct
        counts = [int(((code & bit) > 0).sum()) for bit in (16, 32, TRUNCATED)]
        return (self.id, gaps, *counts, illegal, self.cost, self.audit.decode(), self.sha.hexdigest())
