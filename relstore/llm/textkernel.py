"""Words and word shingles of many texts at once, as numpy arrays over Arrow buffers.

A word is a run of bytes outside 0x20 and 0x09-0x0D; both are ASCII, so UTF-8 needs no decoding.
Words and shingles are represented by 64-bit hashes: a polynomial over random byte values,
mixed so that no structure of the text is left in it.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa

_RNG = np.random.default_rng(20240229)
_BYTE = _RNG.integers(1, 2**64, 256, dtype=np.uint64) | np.uint64(1)
_ODD = _RNG.integers(1, 2**64, 64, dtype=np.uint64) | np.uint64(1)
_STEP = 0x9E3779B97F4A7C15 | 1
_STEP_INVERSE = pow(_STEP, -1, 2**64)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_powers: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers without visible structure (the finaliser of splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if "up" not in _powers or len(_powers["up"]) < n:
        size = max(n, 1 << 16)
        for name, base in (("up", _STEP), ("down", _STEP_INVERSE)):
            a = np.full(size, base, np.uint64)
            a[0] = 1
            _powers[name] = np.multiply.accumulate(a)
    return _powers["up"], _powers["down"]


def text_buffer(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string column; null counts as empty."""
    if pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type):
        dtype = np.int64
    else:
        dtype = np.int32
    if texts.null_count:
        texts = texts.fill_null("" if "string" in str(texts.type) else b"")
    _, offsets, data = texts.buffers()
    n = len(texts)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offsets, dtype)[texts.offset : texts.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


class Words(NamedTuple):
    data: np.ndarray  # the bytes, lower-cased if asked for
    start: np.ndarray  # of each word
    end: np.ndarray
    first: np.ndarray  # index of each row's first word; one more entry than rows


def words(texts: pa.Array, lower: bool) -> Words:
    data, at = text_buffer(texts)
    if lower:
        data = _LOWER[data]
    n = len(data)
    if n == 0:
        none = np.zeros(0, np.int64)
        return Words(data, none, none, np.zeros(len(at), np.int64))
    solid = ~_SPACE[data]
    edge = np.zeros(n + 1, bool)
    edge[at] = True  # a row's end or the next row's begin
    begins, ends = solid.copy(), solid.copy()
    begins[1:] &= ~solid[:-1] | edge[1:n]
    ends[:-1] &= ~solid[1:] | edge[1:n]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return Words(data, start, end, np.searchsorted(start, at))


def word_hashes(w: Words) -> np.ndarray:
    n = len(w.data)
    if not len(w.start):
        return np.zeros(0, np.uint64)
    up, down = _power(n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[w.data] * up[:n], out=total[1:])
    return mix((total[w.end] - total[w.start]) * down[w.start])


def shingle_sets(texts: pa.Array, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, first): row i's distinct shingles, ascending, are hashes[first[i]:first[i + 1]].

    A row with fewer than `size` words has its whole word sequence as its one shingle;
    a row without words has none.
    """
    w = words(texts, lower=True)
    h, first = word_hashes(w), w.first
    count = np.diff(first)
    short = np.flatnonzero((count > 0) & (count < size))
    out_n = np.where(count >= size, count - size + 1, (count > 0).astype(np.int64))
    out_first = np.concatenate([[0], np.cumsum(out_n)])
    if len(h) < size:
        sums = np.zeros(0, np.uint64)
    else:
        m = len(h) - size + 1
        sums = np.zeros(m, np.uint64)
        for j in range(size):
            sums += h[j : j + m] * _ODD[j]
    out = np.zeros(int(out_first[-1]), np.uint64)
    rows = np.repeat(np.arange(len(count)), out_n)
    pos = np.arange(len(out)) - out_first[rows] + first[rows]
    full = count[rows] >= size
    out[full] = sums[pos[full]]
    for i in short:
        part = h[first[i] : first[i + 1]]
        out[out_first[i]] = (part * _ODD[8 : 8 + len(part)]).sum(dtype=np.uint64) + np.uint64(len(part))
    out = mix(out)
    for a, b in zip(out_first[:-1], out_first[1:], strict=True):
        if b - a > 1:
            out[a:b].sort()
    if not len(out):
        return out, out_first
    keep = np.ones(len(out), bool)
    keep[1:] = (out[1:] != out[:-1]) | (rows[1:] != rows[:-1])
    kept = np.concatenate([[0], np.cumsum(keep)])
    return out[keep], kept[out_first]
