"""Token counts that follow edits: a tree over a document's pre-tokens, re-encoded only where an edit reaches.

Leaves hold stretches of whole pre-tokens with their number of tokens; inner nodes hold sums. An edit re-encodes
from the start of a leaf far enough before it to the first old leaf border after it that is a pre-token border of
the new text too: pre-tokens are matched forwards, so from there on nothing changes.

token_trees() makes the leaves of every document, to be kept as a table. apply_edits() reads the documents that edits
touch from it, never their texts, and gives their new leaves, which are the next version's table.
"""

from __future__ import annotations

import bisect
import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cloakframe.llm.bpe import Bpe, tokenizer
from cloakframe.runtime import frugal, ship, written

LEAF = 48  # pre-tokens of a leaf
KNOWN = 1_500_000  # pre-tokens whose numbers of tokens a worker keeps
LEAVES = "array<struct<chars:int,tokens:int,text:string>>"


@dataclass(slots=True)
class Node:
    chars: int
    tokens: int
    text: str = ""
    left: Node | None = None
    right: Node | None = None
    depth: int = 0


def _learn(bpe: Bpe, words: set[str]) -> None:
    """Have the numbers of tokens of these pre-tokens in bpe.sizes (ids are not kept)."""
    known = bpe.sizes
    if len(known) > KNOWN:
        known.clear()
    if not known:
        known.update(dict.fromkeys(bpe.special, 1))  # no ordinary pre-token is spelt like a special token
    new = words.difference(known)
    if new:
        bpe.learn(new)
        known.update((w, len(bpe.cache[w]) // 4) for w in new)
        bpe.cache.clear()


def _groups(bpe: Bpe, pieces: list[str]) -> list[tuple[int, int, str]]:
    """(characters, tokens, text) of each LEAF pre-tokens, whose numbers of tokens are known."""
    n = len(pieces)
    if not n:
        return []
    starts = np.arange(0, n, LEAF)
    tokens = np.add.reduceat(np.fromiter(map(bpe.sizes.__getitem__, pieces), np.int64, n), starts).tolist()
    chars = np.add.reduceat(np.fromiter(map(len, pieces), np.int64, n), starts).tolist()
    text, ends = "".join(pieces), list(itertools.accumulate(chars))
    return [(c, t, text[e - c : e]) for c, t, e in zip(chars, tokens, ends)]


def _commit(bpe: Bpe, trees: list[TokenTree], plans: list[Plan | None]) -> None:
    """Encode the unknown pre-tokens of many plans at once, then carry the plans out."""
    _learn(bpe, set().union(*(p[1] for p in plans if p)))
    for tree, plan in zip(trees, plans):
        if plan:
            tree.commit(plan)


def _join(a: Node | None, b: Node | None) -> Node | None:
    if a is None or b is None:
        return a or b
    return Node(a.chars + b.chars, a.tokens + b.tokens, "", a, b, 1 + max(a.depth, b.depth))


def _built(leaves: list[Node]) -> Node | None:
    while len(leaves) > 1:
        leaves = [_join(leaves[i], leaves[i + 1] if i + 1 < len(leaves) else None) for i in range(0, len(leaves), 2)]
    return leaves[0] if leaves else None


def _leaves(node: Node | None) -> Iterator[Node]:
    stack = [node] if node else []
    while stack:
        n = stack.pop()
        if n.left is None:
            yield n
        else:
            stack += [n.right, n.left]


def _split(node: Node | None, at: int, after: bool) -> tuple[Node | None, Node | None]:
    """The leaves before and from the leaf border at or before (after: at or behind) a character place."""
    if node is None or at <= 0:
        return None, node
    if at >= node.chars:
        return node, None
    if node.left is None:
        return (node, None) if after else (None, node)
    if at <= node.left.chars:
        a, b = _split(node.left, at, after)
        return a, _join(b, node.right)
    a, b = _split(node.right, at - node.left.chars, after)
    return _join(node.left, a), b


Plan = tuple[Node | None, list[str], Node | None]


def pieces_of(bpe: Bpe, text: str) -> list[str]:
    """The pre-tokens and special tokens of a text, which they make up."""
    out: list[str] = []
    for part, special in bpe.parts(text):
        out += [part] if special else bpe.words.findall(part)
    return out


class TokenTree:
    """A document's tree, of a text or of kept leaves; plan() and commit() let many trees learn words together."""

    def __init__(self, bpe: Bpe, text: str = "", leaves: list[Node] | None = None):
        self.bpe, self.reencoded = bpe, 0
        # no pre-token border depends on more characters after it than a special token or a contraction has
        self.ahead = max(16, max(map(len, bpe.special), default=0))
        self.root: Node | None = _built(leaves) if leaves else None
        if text:
            _commit(bpe, [self], [(None, pieces_of(bpe, text), None)])

    @property
    def tokens(self) -> int:
        return self.root.tokens if self.root else 0

    @property
    def text(self) -> str:
        return "".join(n.text for n in _leaves(self.root))

    def edit(self, start: int, end: int, text: str) -> None:
        """Replace the characters from start to end (both cut to the document)."""
        _commit(self.bpe, [self], [self.plan(start, end, text)])

    def plan(self, start: int, end: int, text: str) -> Plan:
        """The subtree before an edit, the pre-tokens it makes anew, and the subtree after."""
        size = self.root.chars if self.root else 0
        start = min(max(start, 0), size)
        end = min(max(end, start), size)
        before, rest = _split(self.root, start - self.ahead, False)
        base = before.chars if before else 0
        middle, rest = _split(rest, end - base + 1, True)
        old = "".join(n.text for n in _leaves(middle))
        new = old[: start - base] + text + old[end - base :]
        while True:
            ahead, reach = [], 0
            for n in _leaves(rest):
                ahead.append(n.text)
                reach += n.chars
                if reach >= self.ahead:
                    break
            look = "".join(ahead)[: self.ahead]
            pieces = pieces_of(self.bpe, new + look)
            self.reencoded += len(new)
            ends = [0, *itertools.accumulate(map(len, pieces))]
            kept = bisect.bisect_left(ends, len(new))
            if ends[kept] == len(new):
                break
            taken, rest = _split(rest, 1, True)  # the border after the edit is gone: go on to the next one
            new += "".join(n.text for n in _leaves(taken))
        return before, pieces[:kept], rest

    def commit(self, plan: Plan) -> None:
        before, pieces, rest = plan
        self.root = _join(_join(before, _built([Node(*g) for g in _groups(self.bpe, pieces)])), rest)
        if self.root and self.root.depth > 64:
            self.root = _built(list(_leaves(self.root)))


def _leaf_column(rows: list[list[tuple[int, int, str]]]) -> pa.Array:
    flat = list(itertools.chain.from_iterable(rows))
    chars, tokens, text = zip(*flat) if flat else ((), (), ())
    offsets = pa.array([0, *itertools.accumulate(map(len, rows))], pa.int32())
    return pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays([pa.array(chars, pa.int32()), pa.array(tokens, pa.int32()), pa.array(text, pa.string())], ["chars", "tokens", "text"]))


def _kept_leaves(column: pa.ListArray) -> list[list[Node]]:
    flat = column.flatten()
    nodes = list(map(Node, *(flat.field(i).to_pylist() for i in range(3))))
    ends = list(itertools.accumulate(n or 0 for n in pa.compute.list_value_length(column).to_pylist()))
    return [nodes[a:b] for a, b in zip([0, *ends], ends)]


def token_trees(docs: DataFrame, path: str, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The carried columns, n_tokens and leaves of every document: its pre-tokens in groups, with their numbers of tokens.

    Null texts count as empty and have no leaves; texts are encoded whole; repeated rows are each answered. Carried
    columns must not be called like the new ones.
    """
    ship(docs.sparkSession)
    kinds = dict(docs.dtypes)

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(path)
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                b = whole.slice(at, 256)
                cut = [pieces_of(bpe, text) if text else [] for text in b.column(0).to_pylist()]
                _learn(bpe, set().union(*cut))
                rows = [_groups(bpe, pieces) for pieces in cut]
                out = [pa.array([sum(g[1] for g in r) for r in rows], pa.int64()), _leaf_column(rows)]
                yield pa.RecordBatch.from_arrays([b.column(j + 1) for j in range(len(carry))] + out, names=[*carry, "n_tokens", "leaves"])

    schema = ", ".join(f"`{c}` {kinds[c]}" for c in carry) + f", n_tokens long, leaves {LEAVES}"
    return docs.select(F.col("text").cast("string").alias("__text"), *carry).mapInArrow(run, schema)


COUNTS = ["n_tokens_edited", "n_chars_edited", "n_chars_reencoded"]


def apply_edits(trees: DataFrame, path: str, leaves: bool = True) -> DataFrame:
    """trees (doc_id, n_tokens, leaves and edits) after their edits: doc_id, n_tokens, COUNTS and (if asked for) the new leaves.

    edits is array<struct<start, end, text>>: each replaces the characters from start to end of the text as the edits
    before it left it; null edits count as none, a null replacement as empty, and places beyond the text are cut to
    it. Rows without edits are answered from the sums they have.
    """
    ship(trees.sparkSession)
    fields = ["n_tokens", *COUNTS]

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(path)
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                b = whole.slice(at, 256)
                made = [TokenTree(bpe, "", x) for x in _kept_leaves(b.column(2))]
                edits = [[e for e in row or () if e is not None] for row in b.column(3).to_pylist()]
                for i in range(max(map(len, edits), default=0)):
                    plans = [t.plan(e[i]["start"] or 0, e[i]["end"] or 0, e[i]["text"] or "") if i < len(e) else None for t, e in zip(made, edits)]
                    _commit(bpe, made, plans)
                out = [b.column(0), b.column(1), *(pa.array(x, pa.int64()) for x in zip(*((t.tokens, t.root.chars if t.root else 0, t.reencoded) for t in made)))]
                if leaves:
                    out.append(_leaf_column([[(n.chars, n.tokens, n.text) for n in _leaves(t.root)] for t in made]))
                yield pa.RecordBatch.from_arrays(out, names=["doc_id", *fields, *["leaves"] * leaves])

    rows = trees.select(F.col("doc_id").cast("long").alias("doc_id"), "n_tokens", "leaves", F.col("edits").cast("array<struct<start:int,end:int,text:string>>").alias("edits"))
    touched = F.coalesce(F.exists("edits", lambda e: e.isNotNull()), F.lit(False))
    schema = "doc_id long, " + ", ".join(f"{c} long" for c in fields) + f", leaves {LEAVES}" * leaves
    chars = F.aggregate(F.coalesce("leaves", F.array().cast(LEAVES)), F.lit(0).cast("long"), lambda z, x: z + x["chars"])
    same = rows.where(~touched).select("doc_id", "n_tokens", F.col("n_tokens").alias(COUNTS[0]), chars.alias(COUNTS[1]), F.lit(0).cast("long").alias(COUNTS[2]), *["leaves"] * leaves)
    return rows.where(touched).mapInArrow(run, schema).unionByName(same)


def count_edited(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, n_tokens_edited, n_chars_edited and n_chars_reencoded of documents (doc_id, text) with edits.

    The trees are written once; the edits are applied to what was written. Null texts count as empty; see
    apply_edits() for the edits. Repeated rows are each answered, an empty table gives none; further columns are not
    carried.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col("edits").cast("array<struct<start:int,end:int,text:string>>").alias("edits"))
    return apply_edits(written(token_trees(rows, path, ("doc_id", "edits")), "trees"), path, leaves=False)
