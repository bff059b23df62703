"""Byte-level BPE by speculation and verification.

A pre-token is first cut greedily into the longest vocabulary entries. Such a cut is the BPE result exactly if
every piece encodes to itself and every two adjacent pieces are compatible: undoing their merges, newest first,
never uncovers a merge across their border that BPE would have made earlier. The check runs over all distinct
adjacent pairs of a batch at once; only pre-tokens with a failing pair are merged exactly, all of a batch together.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cloakframe.runtime import frugal, ship

# Fixed value: the public byte-level pre-token pattern, with white space spelt out as Unicode's White_Space;
# words come first, which no other alternative can begin like.
WHITE = r"\t-\r \x85\xa0  -     　"
PATTERN = rf" ?\p{{L}}+|'s|'t|'re|'ve|'m|'ll|'d| ?\p{{N}}+| ?[^{WHITE}\p{{L}}\p{{N}}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+"

NEVER = 1 << 41  # no merge
SHORT = 64  # bytes of a word that is merged together with others

COLUMNS = {"n_tokens": "long", "ids": "array<int>", "decoded": "string", "ids_sha256": "string", "decoded_sha256": "string"}


def _byte_letters() -> dict[str, int]:
    """The printable stand-in of each byte in a byte-level vocabulary file."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def by_size(texts: list[str], most: int = 64, chars: int = 1 << 18) -> Iterator[list[str]]:
    """The texts in order, in groups of at most `most` texts; a group ends once it has `chars` code points."""
    some, n = [], 0
    for t in texts:
        some.append(t)
        n += len(t)
        if len(some) == most or n >= chars:
            yield some
            some, n = [], 0
    if some:
        yield some


class Bpe:
    """A tokenizer file of the tokenizers library: model BPE, byte-level, special tokens matched in the text.

    Within the class a token's number is its place in merge order (bytes first); ``out`` maps to the file's ids.
    """

    def __init__(self, path: str, cache: int = 600_000):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, letter = spec["model"], _byte_letters()
        pre = spec["pre_tokenizer"] or {}
        if model["type"] != "BPE" or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or spec["normalizer"]:
            raise ValueError("only byte-level BPE without normalizer or prefix space")
        raw = lambda s: bytes(letter[c] for c in s)
        self.number: dict[bytes, int] = {bytes([i]): i for i in range(256)}
        self.bytes: list[bytes] = [bytes([i]) for i in range(256)]
        left, right = list(range(256)), list(range(256))
        name = {v: k for k, v in letter.items()}
        out = [model["vocab"][name[i]] for i in range(256)]
        for m in model["merges"]:
            a, b = m.split(" ") if isinstance(m, str) else m
            x, y = raw(a), raw(b)
            if x + y in self.number:
                raise ValueError(f"two merges make {x + y!r}")
            self.number[x + y] = len(out)
            self.bytes.append(x + y)
            left.append(self.number[x])
            right.append(self.number[y])
            out.append(model["vocab"][a + b])
        self.out = np.array(out, "<u4")
        self.left, self.right = np.array(left, np.int64), np.array(right, np.int64)
        key = (self.left << 32 | self.right)[256:]
        by = np.argsort(key)
        self.key, self.made = key[by], by + 256
        pair = np.arange(1 << 16)
        self.byte_pairs = self.merged(pair >> 8, pair & 255).reshape(256, 256)
        self.merge = {(a, b): i for i, (a, b) in enumerate(zip(left, right)) if i >= 256}
        self.sizes_of: dict[bytes, list[int]] = {}  # sizes of the entries that begin with four bytes, longest first
        for n, head in sorted({(len(t), t[:4]) for t in self.bytes if len(t) > 3}, reverse=True):
            self.sizes_of.setdefault(head, []).append(n)
        self.text_of = {int(i): b for i, b in zip(out, self.bytes)}
        self.special: dict[str, bytes] = {}
        for t in spec["added_tokens"]:
            if t["lstrip"] or t["rstrip"] or t["single_word"]:
                raise ValueError("added tokens that strip or need word borders")
            self.special[t["content"]] = int(t["id"]).to_bytes(4, "little")
            self.text_of[t["id"]] = t["content"].encode()
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.table = np.array([self.text_of.get(i, b"") for i in range(max(self.text_of) + 1)], object)
        self.words = regex.compile(PATTERN)
        # a token stands for itself if its halves do and nothing across them is made before it
        self.own = np.zeros(len(out), bool)
        self.own[:256] = True
        ids = np.arange(256, len(out))
        fine = self.compatible(self.left[ids], self.right[ids], ids)
        for i in ids:
            self.own[i] = fine[i - 256] and self.own[left[i]] and self.own[right[i]]
        self.limit, self.cache = cache, {}
        self.earlier: dict[str, bytes] = {}  # what was the cache before it grew beyond the limit
        self.sizes: dict[str, int] = {}  # numbers of tokens, for callers that need no ids
        self.speculated = self.failed = 0

    def compatible(self, x: np.ndarray, y: np.ndarray, limit: np.ndarray | None = None) -> np.ndarray:
        """For each pair of tokens side by side: does BPE leave both as they are?"""
        ok = np.ones(len(x), bool)
        at = np.arange(len(x))
        x, y = x.astype(np.int64), y.astype(np.int64)
        limit = np.full(len(x), 1 << 40) if limit is None else limit.astype(np.int64)
        while len(at):
            made = self.merged(x, y)
            ok[at[made < limit]] = False
            go = (made >= limit) & ((x >= 256) | (y >= 256))
            at, x, y, limit = at[go], x[go], y[go], limit[go]
            undo_x = x > y  # of equal tokens the left one was made first
            limit = np.where(undo_x, x, y + 1)
            x, y = np.where(undo_x, self.right[x], x), np.where(undo_x, y, self.left[y])
        return ok

    def greedy(self, word: bytes) -> list[int]:
        number = self.number
        if (t := number.get(word)) is not None:
            return [t]
        out, i, n, get = [], 0, len(word), number.get
        while i < n:
            for k in self.sizes_of.get(word[i : i + 4], ()):
                if i + k <= n and (t := get(word[i : i + k])) is not None:
                    break
            else:
                k = min(3, n - i)
                while (t := get(word[i : i + k])) is None:
                    k -= 1
            out.append(t)
            i += k
        return out

    def exact(self, word: bytes) -> list[int]:
        """Merges by rank, leftmost first, with a heap over a linked list."""
        tok = list(word)
        nxt, prv = list(range(1, len(tok) + 1)), list(range(-1, len(tok) - 1))
        merge = self.merge
        heap = [(m, i, tok[i], tok[i + 1]) for i in range(len(tok) - 1) if (m := merge.get((tok[i], tok[i + 1]))) is not None]
        heapq.heapify(heap)
        n = len(tok)
        while heap:
            m, i, a, b = heapq.heappop(heap)
            j = nxt[i]
            if tok[i] != a or j >= n or tok[j] != b:
                continue
            tok[i], tok[j] = m, -1
            nxt[i] = nxt[j]
            if nxt[j] < n:
                prv[nxt[j]] = i
                if (k := merge.get((m, tok[nxt[j]]))) is not None:
                    heapq.heappush(heap, (k, i, m, tok[nxt[j]]))
            if prv[i] >= 0 and (k := merge.get((tok[prv[i]], m))) is not None:
                heapq.heappush(heap, (k, prv[i], tok[prv[i]], m))
        return [t for t in tok if t >= 0]

    def merged(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """The token that each pair makes, or NEVER."""
        key = x << 32 | y
        place = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        return np.where(self.key[place] == key, self.made[place], NEVER)

    def exact_many(self, words: list[bytes]) -> list[bytes]:
        """The ids of many words, merged exactly: each round does the earliest merge of every word, wherever it stands in it.

        A merge makes no pair that comes before it in merge order, so all its places in a word go at once, from left to
        right. Long words would take many rounds and are merged one by one.
        """
        out = [b""] * len(words)
        for i, w in enumerate(words):
            if not 0 < len(w) <= SHORT:
                out[i] = self.out[self.exact(w)].tobytes()
        at = np.array([i for i, w in enumerate(words) if 0 < len(w) <= SHORT], np.int64)
        if not len(at):
            return out
        size = np.array([len(words[i]) for i in at])
        tok = np.frombuffer(b"".join([words[i] for i in at]), np.uint8).astype(np.int64)
        made = self.byte_pairs[tok, np.append(tok[1:], 0)]
        made[np.cumsum(size) - 1] = NEVER
        while len(at):
            start = np.cumsum(size) - size
            least = np.minimum.reduceat(made, start)
            done = least == NEVER
            if done.any():
                ids, ended = self.out[tok[np.repeat(done, size)]].tobytes(), 0
                for i, n in zip(at[done].tolist(), (4 * size[done]).tolist()):
                    out[i] = ids[ended : ended + n]
                    ended += n
                live = np.repeat(~done, size)
                tok, made, at, size, least = tok[live], made[live], at[~done], size[~done], least[~done]
            hit = np.flatnonzero(made == np.repeat(least, size))
            first = np.ones(len(hit), bool)
            first[1:] = hit[1:] != hit[:-1] + 1
            if not first.all():  # of equal tokens in a row every second pair goes
                run = np.flatnonzero(first)
                hit = hit[(np.arange(len(hit)) - run[np.cumsum(first) - 1]) % 2 == 0]
            tok[hit] = made[hit]
            stays = np.ones(len(tok), bool)
            stays[hit + 1] = False
            owner = np.repeat(np.arange(len(size)), size)
            size = size - np.bincount(owner[hit], minlength=len(size))
            tok, made, owner = tok[stays], made[stays], owner[stays]
            hit = hit - np.arange(len(hit))
            near = np.unique(np.concatenate([hit, hit[hit > 0] - 1]))
            near = near[near < len(tok) - 1]
            made[hit[hit == len(tok) - 1]] = NEVER
            made[near] = np.where(owner[near] == owner[near + 1], self.merged(tok[near], tok[near + 1]), NEVER)
        return out

    def learn(self, words: Iterable[str]) -> None:
        """Put the encoded words (distinct, not yet known) into the cache."""
        words = list(words)
        if not words:
            return
        raw = [w.encode() for w in words]
        cuts = [self.greedy(w) for w in raw]
        flat = np.array([t for c in cuts for t in c], np.int64)
        size = np.array([len(c) for c in cuts])
        end = np.cumsum(size)
        owner = np.repeat(np.arange(len(cuts)), size)
        bad = np.zeros(len(cuts), bool)
        bad[owner[~self.own[flat]]] = True
        inner = np.flatnonzero(owner[1:] == owner[:-1])
        if len(inner):
            key, back = np.unique(flat[inner] << 32 | flat[inner + 1], return_inverse=True)
            bad[owner[inner[~self.compatible(key >> 32, key & 0xFFFFFFFF)[back]]]] = True
        ids = self.out[flat].tobytes()
        self.cache.update((w, ids[a:b]) for w, a, b in zip(words, (4 * (end - size)).tolist(), (4 * end).tolist()))
        failed = np.flatnonzero(bad).tolist()
        self.cache.update(zip([words[i] for i in failed], self.exact_many([raw[i] for i in failed])))
        self.speculated += len(words)
        self.failed += int(bad.sum())

    def parts(self, text: str) -> Iterator[tuple[str, bool]]:
        """Stretches of ordinary text, and special tokens."""
        if self.cut is None:
            yield text, False
            return
        for i, p in enumerate(self.cut.split(text)):
            if p:
                yield p, bool(i % 2)

    def encode_many(self, texts: list[str]) -> Iterator[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        for some in by_size(texts, 256, 1 << 20):
            cut = [[(p, None) if sp else (None, self.words.findall(p)) for p, sp in self.parts(t)] for t in some]
            if len(self.cache) > self.limit:
                self.earlier, self.cache = self.cache, {}
            known, earlier = self.cache, self.earlier
            new = set().union(*(ws for c in cut for _, ws in c if ws)).difference(known)
            if earlier:  # pre-tokens that are met again stay
                again = new.intersection(earlier)
                known.update((w, earlier[w]) for w in again)
                new -= again
            self.learn(new)
            for c in cut:
                yield b"".join([b"".join(map(known.__getitem__, ws)) if ws is not None else self.special[p] for p, ws in c])

    def decode(self, ids: bytes) -> str:
        return b"".join(self.table[np.frombuffer(ids, "<u4")].tolist()).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def tokenizer(path: str, cache: int = 600_000) -> Bpe:
    """The tokenizer of a file, built once in each Python worker; it keeps some cache to 2 * cache pre-tokens."""
    return Bpe(path, cache)


def bpe_round_trip(docs: DataFrame, path: str, columns: tuple[str, ...] = ("n_tokens", "ids", "decoded"), id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Encode every whole text and decode its ids again: the id column and those of COLUMNS that are asked for.

    path names a tokenizer file that every executor can read. Null counts as empty, and an empty text has no ids.
    Repeated rows are each answered; other columns of docs, whatever their names, are not carried. Special tokens
    of the file are matched in the text, as the tokenizers library does by default.
    """
    ship(docs.sparkSession)
    kind = dict(docs.dtypes)[id_column]

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(path, 400_000)
        for whole in (b.slice(i, 1024) for b in batches for i in range(0, b.num_rows, 1024)):
            at = 0
            for texts in by_size([t or "" for t in whole.column(1).to_pylist()], 256, 1 << 20):
                b = whole.slice(at, len(texts))
                at += len(texts)
                got: dict[str, list] = {c: [] for c in columns}
                for ids in bpe.encode_many(texts):
                    text = bpe.decode(ids) if {"decoded", "decoded_sha256"} & set(columns) else ""
                    row = {
                        "n_tokens": lambda: len(ids) // 4,
                        "ids": lambda: np.frombuffer(ids, "<u4").astype(np.int32),
                        "decoded": lambda: text,
                        "ids_sha256": lambda: hashlib.sha256(ids).hexdigest(),
                        "decoded_sha256": lambda: hashlib.sha256(text.encode()).hexdigest(),
                    }
                    for c in columns:
                        got[c].append(row[c]())
                types = {"long": pa.int64(), "string": pa.string(), "array<int>": pa.list_(pa.int32())}
                yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(got[c], types[COLUMNS[c]]) for c in columns)], names=[id_column, *columns])

    return docs.select(F.col(id_column), F.col(text_column).cast("string")).mapInArrow(run, f"`{id_column}` {kind}, " + ", ".join(f"{c} {COLUMNS[c]}" for c in columns))
