"""Word and shingle hashing, vectorised over whole Arrow batches (numpy only)."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_MASK = np.array([(1 << (8 * k)) - 1 for k in range(9)], dtype=U)
_K = [U(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD)]
_CHUNK = 4 << 20


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (bijective)."""
    h = h ^ (h >> U(31))
    h = h * U(0x7FB5D329728EA185)
    h = h ^ (h >> U(27))
    h = h * U(0x81DADEF4BC2DD44D)
    return h ^ (h >> U(33))


def split_words(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts, byte ends and document numbers of the words of documents laid end to end.

    bounds: len(documents) + 1 offsets into data. A word never crosses a bound.
    """
    n = len(data)
    if n == 0:
        z = np.zeros(0, np.int64)
        return z, z, z
    word = ~_SPACE[data]
    edge = np.zeros(n + 1, bool)
    edge[bounds] = True
    prev = np.zeros(n, bool)
    prev[1:] = word[:-1]
    starts = np.flatnonzero(word & (~prev | edge[:n]))
    nxt = np.zeros(n, bool)
    nxt[:-1] = word[1:]
    ends = np.flatnonzero(word & (~nxt | edge[1:])) + 1
    doc = np.searchsorted(bounds, starts, side="right") - 1
    return starts, ends, doc


def hash_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes, eight bytes a step."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    at8 = np.ndarray((len(data) + 1,), dtype="<u8", buffer=padded.data, strides=(1,))
    length = ends - starts
    h = mix((at8[starts] & _MASK[np.minimum(length, 8)]) ^ (length.astype(U) * _K[0]))
    rest = np.flatnonzero(length > 8)
    step = 8
    while len(rest):
        left = length[rest] - step
        h[rest] = mix(h[rest] * _K[1] ^ (at8[starts[rest] + step] & _MASK[np.minimum(left, 8)]))
        rest = rest[left > 8]
        step += 8
    return h


def combine(w: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the k-word runs of the word hashes w (len(w) - k + 1 of them)."""
    n = len(w) - k + 1
    if n <= 0:
        return w[:0]
    h = np.full(n, U(k * 0x2545F4914F6CDD1D % 2**64))
    for i in range(k):
        h += (w[i : i + n] ^ (w[i : i + n] >> U(29))) * (_K[i % 5] + U(2 * (i // 5)))
    return mix(h)


def text_chunks(texts: pa.Array, limit: int = _CHUNK) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first document, bytes, bounds) of runs of whole documents of about limit bytes; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = texts.fill_null("")
    if len(texts) == 0:
        return
    _, off, buf = texts.buffers()
    offsets = np.frombuffer(off, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(buf, np.uint8) if buf is not None else np.zeros(0, np.uint8)
    i = 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1)
        yield i, data[offsets[i] : offsets[j]], (offsets[i : j + 1] - offsets[i])
        i = j


def shingle_sets(texts: pa.Array, k: int = 5) -> Iterator[np.ndarray]:
    """The sorted distinct hashes of each text's k-word shingles: A-Z lower-cased, words between ASCII white space.

    A text with 1 to k-1 words has its whole sequence as its one shingle; one without words has none.
    """
    for _, data, bounds in text_chunks(texts):
        data = _LOWER[data]
        starts, ends, doc = split_words(data, bounds)
        w = hash_words(data, starts, ends)
        first = np.searchsorted(doc, np.arange(len(bounds)))
        full = combine(w, k)
        for d in range(len(bounds) - 1):
            a, b = first[d], first[d + 1]
            if b - a >= k:
                s = np.sort(full[a : b - k + 1])
                if len(s) > 1:
                    keep = np.ones(len(s), bool)
                    np.not_equal(s[1:], s[:-1], out=keep[1:])
                    s = s[keep]
                yield s
            elif b > a:
                yield combine(w[a:b], int(b - a))
            else:
                yield w[:0]


def set_signature(s: np.ndarray) -> int:
    """A signed 64-bit digest of a set of hashes; 0 for the empty set."""
    if not len(s):
        return 0
    return int.from_bytes(hashlib.blake2b(s.tobytes(), digest_size=8).digest(), "little", signed=True) or 1
