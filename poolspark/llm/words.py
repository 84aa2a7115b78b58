"""Words of many texts at once, as flat numpy arrays over their UTF-8 bytes. Used inside tasks."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

#: Texts are worked on in pieces of about so many bytes; a longer text is a piece of its own.
PIECE = 1 << 20

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes of words between white space, and of words made of ASCII letters, digits and all that is not ASCII.
SPACED = np.ones(256, bool)
SPACED[[9, 10, 11, 12, 13, 32]] = False
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[97:123] = ALNUM[65:91] = ALNUM[128:] = True

_BASE = 0x9E3779B97F4A7C15 | 1
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


class Words(NamedTuple):
    """Words of a piece: ``rows`` texts, the bytes, lower-cased bytes, each word's start, end and row, each row's first word."""

    rows: int
    data: np.ndarray
    lower: np.ndarray
    start: np.ndarray
    end: np.ndarray
    row: np.ndarray
    first: np.ndarray  # rows + 1 entries
    offset: np.ndarray  # rows + 1 entries, bytes


def pieces(column: pa.Array | pa.ChunkedArray, size: int = PIECE) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) of consecutive runs of texts; a null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    column = column.fill_null("").cast(pa.large_string())
    n = len(column)
    if not n:
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + n + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    begin = 0
    while begin < n:
        stop = max(begin + 1, int(np.searchsorted(offsets, offsets[begin] + size, "right")) - 1)
        yield begin, data[offsets[begin]:offsets[stop]], offsets[begin:stop + 1] - offsets[begin]
        begin = stop


def words(data: np.ndarray, offset: np.ndarray, letters: np.ndarray = SPACED) -> Words:
    lower = LOWER[data]
    rows = len(offset) - 1
    inside = letters[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offset] = True
    before = np.empty_like(inside)
    before[:1], before[1:] = False, inside[:-1]
    start = np.flatnonzero(inside & (~before | edge[:-1]))
    after = np.empty_like(inside)
    after[-1:], after[:-1] = False, inside[1:]
    end = np.flatnonzero(inside & (~after | edge[1:])) + 1
    first = np.searchsorted(start, offset)
    return Words(rows, data, lower, start, end, np.repeat(np.arange(rows), np.diff(first)), first, offset)


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads the bits of 64-bit numbers; one to one."""
    h = h ^ (h >> np.uint64(30))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        inverse = pow(_BASE, -1, 1 << 64)
        for k, b in enumerate((_BASE, inverse)):
            steps = np.full(max(n, PIECE + 1), b, np.uint64)
            steps[0] = 1
            _powers[k] = np.multiply.accumulate(steps)
    return _powers[0][:n], _powers[1][:n]


def hashes(w: Words, start: np.ndarray | None = None, end: np.ndarray | None = None) -> np.ndarray:
    """A 64-bit hash of each word's lower-cased bytes, the same in every task."""
    start, end = (w.start, w.end) if start is None else (start, end)
    up, down = _power(len(w.lower) + 1)
    total = np.empty(len(w.lower) + 1, np.uint64)
    total[0] = 0
    part = w.lower.astype(np.uint64)
    part += np.uint64(1)
    part *= up[:-1]
    np.cumsum(part, out=total[1:])
    return mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64))


def word_hash(word: str) -> int:
    data = np.frombuffer(word.encode(), np.uint8)
    w = Words(1, data, LOWER[data], np.array([0]), np.array([len(data)]), np.zeros(1, int), np.array([0, 1]), np.array([0, len(data)]))
    return int(hashes(w)[0])


def windows(w: Words, h: np.ndarray, size: int, short: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, row, first word) of every run of ``size`` words inside a row; rows with fewer words give their whole
    sequence as one if ``short``, else nothing. Hashes of runs of different lengths differ."""
    last = len(h) - size + 1
    if last > 0:
        key = np.zeros(last, np.uint64)
        for k in range(size):
            key *= np.uint64(0xD6E8FEB86659FD93)
            key += h[k:k + last]
        at = np.flatnonzero(w.row[:last] == w.row[size - 1:])
        key = key[at]
    else:
        at, key = np.zeros(0, np.int64), np.zeros(0, np.uint64)
    row = w.row[at]
    if short:
        n = np.diff(w.first)
        few = np.flatnonzero((n > 0) & (n < size))
        if len(few):
            own = np.zeros(len(few), np.uint64)
            for k in range(size - 1):
                more = n[few] > k
                own[more] = own[more] * np.uint64(0xD6E8FEB86659FD93) + h[w.first[few[more]] + k]
            key = np.concatenate([key, own + n[few].astype(np.uint64) * np.uint64(0xA24BAED4963EE407)])
            row, at = np.concatenate([row, few]), np.concatenate([at, w.first[few]])
    return mix(key), row, at
