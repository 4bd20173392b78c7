"""Vectorised word and shingle hashing over whole Arrow text columns (runs inside Spark tasks).

A word is a run of bytes outside ``[\\x20\\x09-\\x0D]``. Hashing works on the column's byte buffer in
chunks cut at white space, so memory is bounded by the chunk, not by a document.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

CHUNK = 1 << 20
_U = np.uint64
_P = _U(0x9E3779B97F4A7C15)
_P_INV = _U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_Q = _U(0xD6E8FEB86659FD93)
_Q_INV = _U(pow(0xD6E8FEB86659FD93, -1, 1 << 64))
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_powers: dict[int, np.ndarray] = {}
KEY = np.dtype([("hi", np.uint64), ("lo", np.uint64)])  # a 128-bit hash


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64 finaliser."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _P) | _U(1)
_BYTE_LOWER = _BYTE.copy()
_BYTE_LOWER[65:91] = _BYTE[97:123]


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, kept and grown by doubling."""
    have = _powers.get(int(base))
    if have is None or len(have) < n:
        size = 1 << max(10, (n - 1).bit_length())
        have = np.full(size, base, dtype=np.uint64)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        _powers[int(base)] = have
    return have[:n]


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and the n+1 offsets of its rows (null: empty)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", dtype=np.uint8)
    return data[offsets[0] : offsets[-1]] if len(offsets) else data[:0], offsets - (offsets[0] if len(offsets) else 0)


def word_bounds(data: np.ndarray, offsets: np.ndarray, base: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words in data; a row boundary also ends a word."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    word = ~_SPACE[data]
    first = word.copy()
    first[1:] &= ~word[:-1]
    inner = offsets[(offsets > base) & (offsets < base + len(data))] - base
    first[inner] |= word[inner]
    last = word.copy()
    last[:-1] &= ~word[1:]
    last[inner - 1] |= word[inner - 1]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def word_hashes(column: pa.Array, lower: bool) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hash of every word of the column, and n+1 word offsets of its rows."""
    data, offsets = text_buffer(column)
    table = _BYTE_LOWER if lower else _BYTE
    out, ends, at = [], [], 0
    while at < len(data):
        to = min(at + CHUNK, len(data))
        while to < len(data):
            cut = np.flatnonzero(_SPACE[data[at:to]])
            if len(cut):
                to = at + int(cut[-1]) + 1
                break
            to = min(to + CHUNK, len(data))
        part = data[at:to]
        s, e = word_bounds(part, offsets, at)
        total = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(table[part] * powers(_P, len(part)), out=total[1:])
        out.append(mix((total[e] - total[s]) * powers(_P_INV, len(part))[s] + (e - s).astype(np.uint64)))
        ends.append(s + at)
        at = to
    hashes = np.concatenate(out) if out else np.zeros(0, np.uint64)
    starts = np.concatenate(ends) if ends else np.zeros(0, np.int64)
    return hashes, np.searchsorted(starts, offsets, side="left")


def window_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hash of every run of ``size`` words, by its first word (empty when there are fewer)."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(words * powers(_Q, len(words)), out=total[1:])
    return mix((total[size:] - total[:n]) * powers(_Q_INV, n))


def shingle_set(words: np.ndarray, size: int) -> np.ndarray:
    """Sorted distinct hashes of a document's word shingles; a shorter text is one shingle."""
    if not len(words):
        return np.zeros(0, np.uint64)
    return np.unique(window_hashes(words, min(size, len(words))) + _U(min(size, len(words))))


def sliding_min(values: np.ndarray, span: int) -> np.ndarray:
    """The smallest of every run of ``span`` values, by its first (empty when there are fewer)."""
    out, have = values, 1
    if len(values) < span:
        return values[:0]
    while have < span:
        step = min(have, span - have)
        out = np.minimum(out[:-step], out[step:])
        have += step
    return out
