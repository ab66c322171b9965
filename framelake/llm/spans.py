"""Vectorised hashing of byte spans: all words or n-grams of a block of texts in a few NumPy passes.

A block is the concatenation of whole texts, with offsets. The hash of bytes [a, b) comes from one prefix
sum of table[byte] * B**position modulo 2**64, divided by B**a (B is odd, so it has an inverse) and mixed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BASE = 0x9E3779B97F4A7C15
UNBASE = pow(BASE, -1, 1 << 64)
BASES = (BASE, 0xD1342543DE82EF95)
UNBASES = (UNBASE, pow(BASES[1], -1, 1 << 64))
TABLE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
TABLES = (TABLE, np.random.default_rng(20240301).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1))
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
BLOCK = 1 << 20

_powers = {base: np.ones(1, np.uint64) for base in BASES + UNBASES}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 to base**(n-1) modulo 2**64; kept for the next block."""
    if len(_powers[base]) < n:
        steps = np.full(max(n, BLOCK + 4096), base, np.uint64)
        steps[0] = 1
        _powers[base] = np.multiply.accumulate(steps)
    return _powers[base][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words whose every output bit depends on every input bit."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and offsets of a string column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()).fill_null(b"") if column.null_count else column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64, len(column) + 1, 8 * column.offset) if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def blocks(raw: np.ndarray, at: np.ndarray, most: int = BLOCK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of whole texts of about `most` bytes (one longer text is a block of its own): first, last, bytes, offsets."""
    i, n = 0, len(at) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + most, "right")) - 1)
        yield i, j, raw[at[i] : at[j]], at[i : j + 1] - at[i]
        i = j


def prefix(raw: np.ndarray, kind: int = 0) -> np.ndarray:
    """Prefix sums of one of two independent hashes."""
    total = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(TABLES[kind][raw] * powers(BASES[kind], len(raw)), out=total[1:])
    return total


def span_hash(total: np.ndarray, start: np.ndarray, end: np.ndarray, kind: int = 0) -> np.ndarray:
    if not len(start):
        return np.zeros(0, np.uint64)
    return mix((total[end] - total[start]) * powers(UNBASES[kind], len(total))[start] + (end - start).astype(np.uint64))


def runs(kind: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of equal nonzero kind that don't cross a text: starts and ends."""
    if not len(kind):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    new = np.empty(len(kind), bool)
    new[0] = True
    np.not_equal(kind[1:], kind[:-1], out=new[1:])
    inner = at[(at > 0) & (at < len(kind))]
    new[inner] = True
    start = np.flatnonzero(new)
    end = np.append(start[1:], len(kind))
    keep = kind[start] != 0
    return start[keep], end[keep]


def words(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Whitespace-separated words: hash, and for each text the number of words before it (one more than texts)."""
    start, end = runs((~SPACE[raw]).view(np.uint8), at)
    return span_hash(prefix(raw), start, end), np.searchsorted(start, at), start
