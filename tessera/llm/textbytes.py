"""Array work on the UTF-8 bytes of many texts at once: words, word hashes, shingles, rolling hashes.

All hashes are polynomials modulo 2**64 over a fixed random table of the 256 bytes; a substring's
value is the difference of two prefix sums times a power of the multiplier's inverse, so it costs
the same whatever its length and does not depend on where it stands.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

np.seterr(over="ignore")  # hashes wrap
#: Bytes that are worked on at a time; a longer text makes a chunk of its own.
CHUNK = 1 << 18
_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_RANDOM = np.random.Generator(np.random.PCG64(71))
_TABLE = _RANDOM.integers(0, 2**64, 256, dtype=np.uint64)
#: Odd factors of the words of a shingle by place.
_PLACES = _RANDOM.integers(0, 2**64, 64, dtype=np.uint64) | np.uint64(1)
#: A-Z to a-z, all other bytes as they are.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: ASCII white space: 9 to 13 and 32.
SPACE = np.zeros(256, dtype=bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
_powers: tuple[np.ndarray, np.ndarray] = (np.ones(1, _U), np.ones(1, _U))


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit finaliser with a seed."""
    x = x + _U((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of the multiplier and of its inverse; kept for the next call."""
    global _powers
    if len(_powers[0]) < n:
        size = max(n, CHUNK + 1)
        up, down = np.full(size, _BASE, _U), np.full(size, pow(_BASE, -1, 1 << 64), _U)
        up[0] = down[0] = 1
        _powers = (np.cumprod(up, dtype=_U), np.cumprod(down, dtype=_U))
    return _powers


def string_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column and the n + 1 offsets of its texts; nulls are empty."""
    if pa.types.is_large_string(column.type) or column.null_count:
        column = column.fill_null("") if column.null_count else column
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    if offsets is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def chunks(column: pa.Array, size: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Consecutive texts of about ``size`` bytes in all: first, last + 1, bytes, offsets."""
    data, at = string_bytes(column)
    n, i = len(at) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + size, "right")) - 1)
        yield i, j, data[at[i] : at[j]], at[i : j + 1] - at[i]
        i = j


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """n + 1 prefix sums for :func:`substring_hash`."""
    out = np.zeros(len(data) + 1, _U)
    np.cumsum(_TABLE[data] * powers(len(data) + 1)[0][: len(data)], out=out[1:])
    return out


def substring_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return (sums[end] - sums[start]) * powers(len(sums))[1][start]


def words(data: np.ndarray, at: np.ndarray, space: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, and the n + 1 offsets of each text's words among them.

    A word is a maximal run of bytes that ``space`` leaves out; none crosses into the next text.
    """
    inside = ~space[data]
    starts, ends = inside.copy(), inside.copy()
    starts[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    first = at[:-1][at[:-1] < at[1:]]  # where texts begin
    starts[first] = inside[first]
    last = at[1:][at[:-1] < at[1:]] - 1
    ends[last] = inside[last]
    begin = np.flatnonzero(starts)
    return begin, np.flatnonzero(ends) + 1, np.searchsorted(begin, at)


def word_hashes(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    return mix(substring_hash(prefix_sums(data), begin, end), 1)


def shingles(hashes: np.ndarray, owner: np.ndarray, k: int) -> list[np.ndarray]:
    """The sorted distinct ``k``-word shingles of each text as 64-bit hashes.

    ``owner``: n + 1 offsets of the texts' words. With fewer words the whole sequence is the one
    shingle; without words there is none.
    """
    n = len(hashes)
    rolled = np.zeros(max(0, n - k + 1), _U)
    for j in range(k):
        rolled += hashes[j : j + len(rolled)] * _PLACES[j]
    rolled = mix(rolled, 2)
    out = []
    for a, b in zip(owner[:-1].tolist(), owner[1:].tolist()):
        if b - a >= k:
            out.append(np.unique(rolled[a : b - k + 1]))
        elif b > a:
            h = np.zeros(1, _U)
            for x in hashes[a:b]:
                h = mix(h ^ x, 3 + b - a)
            out.append(h)
        else:
            out.append(np.zeros(0, _U))
    return out
