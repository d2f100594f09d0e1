"""Vectorised text primitives over Arrow string columns: UTF-8 buffers, words and word hashes.

Everything works on the concatenated bytes of a run of documents, a few MB at a time, so the
memory of a Python worker does not depend on the number of rows in a batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
CHUNK = 1 << 20
_MUL = U64(0x9E3779B97F4A7C15)
_INV = U64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_rng = np.random.Generator(np.random.PCG64(20240531))
BYTE_CODE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * U64(2) + U64(1)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes of words that end at ASCII white space; bytes of words of letters and digits.
NON_SPACE = np.ones(256, np.uint8)
NON_SPACE[[9, 10, 11, 12, 13, 32]] = 0
ALNUM = np.zeros(256, np.uint8)
ALNUM[48:58] = ALNUM[97:123] = ALNUM[128:] = 1

_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n of the hash's multiplier and of its inverse mod 2**64."""
    if n >= len(_powers.get("up", ())):
        size = max(n + 1, CHUNK + 4096)
        for name, base in (("up", _MUL), ("down", _INV)):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            _powers[name] = np.cumprod(p, dtype=np.uint64)
    return _powers["up"], _powers["down"]


def mix(x: np.ndarray) -> np.ndarray:
    """Finalizer of a 64-bit hash (multiply and xor-shift rounds), a bijection."""
    x = (x ^ (x >> U64(31))) * U64(0x7FB5D329728EA185)
    x = (x ^ (x >> U64(27))) * U64(0x81DADEF4BC2DD44D)
    return x ^ (x >> U64(33))


def utf8(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string or binary column; null is the empty text."""
    col = pc.fill_null(col.cast(pa.large_binary()), b"")
    offsets = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1]
    data = np.frombuffer(col.buffers()[2] or b"", np.uint8)
    return data, offsets


def runs(offsets: np.ndarray, limit: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Ranges of documents whose bytes are at most ``limit``, or one longer document."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1
        j = min(n, max(j, i + 1))
        yield i, j
        i = j


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """Prefix sums P with hash(data[s:e]) = (P[e] - P[s]) * INV**s."""
    up, _ = powers(len(data))
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTE_CODE[data] * up[: len(data)], dtype=np.uint64, out=out[1:])
    return out


def words(data: np.ndarray, offsets: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and document of each word; a word never spans two documents."""
    n = len(data)
    inside = kind[data]
    before = np.zeros(n, np.uint8)
    before[1:] = inside[:-1]
    first = offsets[:-1]
    before[first[first < n]] = 0
    starts = np.flatnonzero(inside & ~before & 1)
    after = np.zeros(n, np.uint8)
    after[:-1] = inside[1:]
    last = offsets[1:]
    after[last[last > 0] - 1] = 0
    ends = np.flatnonzero(inside & ~after & 1) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    p = prefix_hash(data)
    _, down = powers(len(data))
    return mix((p[ends] - p[starts]) * down[starts] + (ends - starts).astype(np.uint64))
