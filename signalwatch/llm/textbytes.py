"""Words, word hashes and shingles of a whole Arrow batch at once, as numpy arrays over its UTF-8 bytes.

Every function works on all documents of a batch together; a document of any length is taken whole. Null texts count as empty.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text handled at once: bounds the memory of a task. A longer document is still handled whole.
CHUNK_BYTES = 1 << 19

_U = np.uint64
_BASE = 0x9E3779B97F4A7C55 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[str, np.ndarray] = {}

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Bytes that part words: a set for words between white space, and one for words of letters, digits and all beyond ASCII.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> _U(33))
    x = x * _U(0xFF51AFD7ED558CCD)
    x = x ^ (x >> _U(33))
    x = x * _U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> _U(33))


def power_table(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0 to n of the base and of its inverse modulo 2**64."""
    if len(_powers.get("up", ())) <= n:
        size = max(n + 1, CHUNK_BYTES + 4096)
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            table = np.full(size, base, np.uint64)
            table[0] = 1
            _powers[name] = np.multiply.accumulate(table)
    return _powers["up"], _powers["down"]


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, bytes) of a string column; nulls have no bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None and buffers[2].size else np.zeros(0, np.uint8)
    return offsets, data


def chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, offsets from 0, bytes) of runs of rows with about `limit` bytes."""
    offsets, data = utf8(column)
    first, n = 0, len(offsets) - 1
    while first < n:
        end = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1)
        end = min(end, n)
        yield first, end, offsets[first : end + 1] - offsets[first], data[offsets[first] : offsets[end]]
        first = end


def spans(offsets: np.ndarray, data: np.ndarray, apart: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row) of every word: the longest runs of bytes that `apart` doesn't part, within a row."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    inside = np.zeros(n + 2, bool)
    inside[1:-1] = ~apart[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    starts = np.flatnonzero(inside[1:-1] & (~inside[:-2] | edge[:-1]))
    ends = np.flatnonzero(inside[1:-1] & (~inside[2:] | edge[1:])) + 1
    return starts, ends, np.searchsorted(offsets[1:], starts, "right")


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of A-Z-lowered bytes, the same wherever the span stands."""
    up, down = power_table(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((LOWER[data].astype(np.uint64) + _U(1)) * down[: len(data)], out=total[1:])
    return mix((total[ends] - total[starts]) * up[starts] + (ends - starts).astype(np.uint64) * _U(0xD6E8FEB86659FD93))


def gram_hashes(words: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    """A hash of the k words from each position in `at`; the number of words is part of it."""
    out = np.full(len(at), k, np.uint64)
    for j in range(k):
        out = mix(out * _U(0x9FB21C651E98DF25) + words[at + j])
    return out


def shingle_sets(offsets: np.ndarray, data: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct hashes of all rows one after another, offsets) of the k-word shingles of every row.

    A row with fewer than k words, but not none, has one: its whole sequence. A row without words has none.
    """
    starts, ends, row = spans(offsets, data, SPACE)
    words, rows = word_hashes(data, starts, ends), len(offsets) - 1
    count = np.bincount(row, minlength=rows)
    first = np.concatenate(([0], np.cumsum(count)))
    whole = np.flatnonzero(row[: len(row) - k + 1] == row[k - 1 :]) if len(row) >= k else np.zeros(0, np.int64)
    grams, owner = gram_hashes(words, whole, k), row[whole]
    low = np.searchsorted(owner, np.arange(rows + 1))
    short = {int(r): gram_hashes(words, first[r : r + 1], int(count[r])) for r in np.flatnonzero((count > 0) & (count < k))}
    sets = [short[r] if r in short else np.unique(grams[low[r] : low[r + 1]]) for r in range(rows)]
    return (np.concatenate(sets) if sets else np.zeros(0, np.uint64)), np.concatenate(([0], np.cumsum([len(x) for x in sets], dtype=np.int64))).astype(np.int64)
