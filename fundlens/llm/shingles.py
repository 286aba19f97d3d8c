"""Word shingle sets of whole texts as sorted 64-bit hashes, vectorised over a batch of texts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 2 << 20            # text hashed at once; a longer single text is a chunk of its own
_RNG = np.random.default_rng(20240501)
BYTE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BYTE[65:91] = BYTE[97:123]       # A-Z as a-z
IS_WORD = np.ones(256, bool)
IS_WORD[[0x20, 9, 10, 11, 12, 13]] = False
BASE = np.uint64(0x9E3779B97F4A7C15)
PLACE = _RNG.integers(1, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, a bijection of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def text_chunks(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(index of the first text, its bytes and those that follow, offsets) in bounded chunks."""
    if len(texts) == 0:
        return
    texts = pc.fill_null(texts.cast(pa.large_utf8()), "")
    off = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8)
    data = texts.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(off, off[at] + CHUNK_BYTES, side="right")) - 1)
        yield at, data[off[at]:off[to]], off[at:to + 1] - off[at]
        at = to


def shingle_sets(data: np.ndarray, off: np.ndarray, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the distinct ``k``-word shingles of each text, ascending within a text, and the
    texts' offsets. A text of fewer words is one shingle, one without words none."""
    docs = len(off) - 1
    is_word = IS_WORD[data]
    begins = is_word.copy()
    begins[1:] &= ~is_word[:-1]
    first = off[:-1][off[:-1] < len(data)]
    begins[first] |= is_word[first]
    begin = np.flatnonzero(begins)
    if not len(begin):
        return np.zeros(0, np.uint64), np.zeros(docs + 1, np.int64)
    kept = np.flatnonzero(is_word)
    at = np.searchsorted(kept, begin)
    lens = np.diff(np.append(at, len(kept)))
    power = np.cumprod(np.concatenate([[np.uint64(1)], np.full(int(lens.max()) - 1, BASE, np.uint64)]))
    within = np.arange(len(kept)) - np.repeat(at, lens)
    word = mix(np.add.reduceat(BYTE[data[kept]] * power[within], at) + lens.astype(np.uint64) * PLACE[63])
    doc = np.searchsorted(off, begin, side="right") - 1
    n = np.bincount(doc, minlength=docs)
    start = np.concatenate([[0], np.cumsum(n)])
    parts, owner = [], []
    if len(word) >= k:
        full = np.flatnonzero(doc[:len(doc) - k + 1] == doc[k - 1:])
        s = np.zeros(len(full), np.uint64)
        for j in range(k):
            s += word[full + j] * PLACE[j]
        parts.append(mix(s))
        owner.append(doc[full])
    for d in np.flatnonzero((n > 0) & (n < k)):
        w = word[start[d]:start[d + 1]]
        parts.append(mix((w * PLACE[:len(w)]).sum(keepdims=True) + PLACE[62:63] * w.dtype.type(len(w))))
        owner.append(np.array([d]))
    h, who = np.concatenate(parts), np.concatenate(owner)
    if len(parts) > 1:
        order = np.argsort(who, kind="stable")
        h, who = h[order], who[order]
    edge = np.searchsorted(who, np.arange(docs + 1))
    for a, b in zip(edge[:-1], edge[1:]):
        h[a:b].sort()
    fresh = np.ones(len(h), bool)
    fresh[1:] = (h[1:] != h[:-1]) | (who[1:] != who[:-1])
    return h[fresh], np.concatenate([[0], np.cumsum(np.bincount(who[fresh], minlength=docs))])


def set_digests(h: np.ndarray, off: np.ndarray) -> np.ndarray:
    """A 64-bit digest of each set (0 for the empty one)."""
    total = np.concatenate([[np.uint64(0)], np.cumsum(mix(h ^ PLACE[40]))])
    return np.where(np.diff(off) > 0, mix(total[off[1:]] - total[off[:-1]] + np.diff(off).astype(np.uint64) * PLACE[41]), np.uint64(0))


def parity_sketch(h: np.ndarray) -> bytes:
    """A bit per bucket of the hashes' lower bits, set if the bucket holds an odd number of them; four
    buckets a shingle, rounded up to a power of two, 64 at least. The sketches of two sets differ in
    no more places than the sets do, and in nearly as many."""
    bits = max(64, 1 << int(4 * max(1, len(h)) - 1).bit_length())
    odd = np.bincount((h & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def sketch_distance(a: bytes, b: bytes) -> int:
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    while len(x) > len(y):
        x = x[:len(x) // 2] ^ x[len(x) // 2:]
    while len(y) > len(x):
        y = y[:len(y) // 2] ^ y[len(y) // 2:]
    return int(np.bitwise_count(x ^ y).sum())
