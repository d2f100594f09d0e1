"""Hypervectors: seeded random base vectors, k-mer binding, the k-mer dimension and its Gram matrix.

A sequence's hypervector is the sum of +-1 vectors of its canonical k-mers, so that with counts c and the matrix B
of k-mer vectors the dot product of two sequences is c1 G c2 with G = B B'. G (512 x 512 integers) is all
that scoring needs.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import product

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kmerloom.functions.dna import KMER_SIZE

# Dimension in bits, and the generator seed of each base.
HV_DIM = 10_000
BASE_SEEDS = {"A": 0, "C": 1, "T": 2, "G": 3}

HV_WORDS = -(-HV_DIM // 64)
_TAIL = np.uint64((1 << (HV_DIM - 64 * (HV_WORDS - 1))) - 1)
_COMPLEMENT = str.maketrans("ACGT", "TGCA")


class Mt19937_64:
    """The 64-bit Mersenne Twister of the C++ standard library."""

    # The parameters that the standard gives for mt19937_64.
    N, M = 312, 156
    MATRIX, UPPER, LOWER = 0xB5026F5AA96619E9, 0xFFFFFFFF80000000, 0x7FFFFFFF
    INIT = 6364136223846793005
    TEMPER = ((29, 0x5555555555555555), (-17, 0x71D67FFFEDA60000), (-37, 0xFFF7EEE000000000), (43, (1 << 64) - 1))

    def __init__(self, seed: int = 5489):
        full = (1 << 64) - 1
        self.state = [seed & full]
        for i in range(1, self.N):
            before = self.state[-1]
            self.state.append((self.INIT * (before ^ (before >> 62)) + i) & full)
        self.next = self.N

    def _turn(self) -> None:
        s, n = self.state, self.N
        for i in range(n):
            x = (s[i] & self.UPPER) | (s[(i + 1) % n] & self.LOWER)
            s[i] = s[(i + self.M) % n] ^ (x >> 1) ^ (self.MATRIX if x & 1 else 0)
        self.next = 0

    def __call__(self) -> int:
        if self.next == self.N:
            self._turn()
        x = self.state[self.next]
        self.next += 1
        for shift, mask in self.TEMPER:
            x ^= (x >> shift if shift > 0 else x << -shift) & mask
        return x & ((1 << 64) - 1)


def ones_hv() -> np.ndarray:
    """All ones in the used bits."""
    hv = np.full(HV_WORDS, (1 << 64) - 1, np.uint64)
    hv[-1] = _TAIL
    return hv


def base_hv(seed: int) -> np.ndarray:
    draw = Mt19937_64(seed)
    hv = np.array([draw() for _ in range(HV_WORDS)], np.uint64)
    hv[-1] &= _TAIL
    return hv


@lru_cache
def bases() -> dict[str, np.ndarray]:
    return {b: base_hv(s) for b, s in BASE_SEEDS.items()}


def shift_right(hv: np.ndarray, k: int) -> np.ndarray:
    """Bit i of the result is bit i + k, zeros come in at the end (k < 64)."""
    if not k:
        return hv
    up = np.append(hv[1:], np.uint64(0))
    return (hv >> np.uint64(k)) | (up << np.uint64(64 - k))


def bind(left: np.ndarray, right: np.ndarray, k: int) -> np.ndarray:
    """XOR with the right vector shifted by k bits."""
    return left ^ shift_right(right, k)


def bind_columns(left: Column, right: Column, k: int) -> Column:
    """The same on array<bigint> columns of words."""
    if not k:
        return F.zip_with(left, right, lambda a, b: a.bitwiseXOR(b))
    up = F.concat(F.slice(right, 2, HV_WORDS), F.array(F.lit(0).cast("bigint")))
    moved = F.zip_with(right, up, lambda a, b: F.shiftrightunsigned(a, k).bitwiseOR(F.shiftleft(b, 64 - k)))
    return F.zip_with(left, moved, lambda a, b: a.bitwiseXOR(b))


@lru_cache
def canonical_kmers(k: int = KMER_SIZE) -> tuple[str, ...]:
    """Canonical k-mers in ASCII order; a k-mer's place is its id."""
    every = ("".join(p) for p in product("ACGT", repeat=k))
    return tuple(sorted({min(s, s.translate(_COMPLEMENT)[::-1]) for s in every}))


@lru_cache
def kmer_ids(k: int = KMER_SIZE) -> np.ndarray:
    """Id of the canonical form of each k-mer, by base-4 number."""
    place = {s: i for i, s in enumerate(canonical_kmers(k))}
    return np.array([place[min(s, s.translate(_COMPLEMENT)[::-1])] for s in map("".join, product("ACGT", repeat=k))], np.int16)


@lru_cache
def kmer_hvs(k: int = KMER_SIZE) -> np.ndarray:
    """(canonical k-mers, words): all ones bound with each base's vector shifted by its place."""
    out = []
    for s in canonical_kmers(k):
        hv = ones_hv()
        for i, base in enumerate(s):
            hv = bind(hv, bases()[base], i)
        out.append(hv)
    return np.stack(out)


def lanes(hvs: np.ndarray) -> np.ndarray:
    """Bits 0 and 1 of packed vectors, lowest first."""
    return np.unpackbits(np.ascontiguousarray(hvs).view(np.uint8), axis=-1, bitorder="little")[..., :HV_DIM]


def lanes_column(words: Column) -> Column:
    """The same of an array<bigint> column: array<int> of the used bits."""
    bits = F.transform(words, lambda w: F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.call_function("shiftrightunsigned", w, i).bitwiseAND(F.lit(1)).cast("int")))
    return F.slice(F.flatten(bits), 1, HV_DIM)


@lru_cache
def gram(k: int = KMER_SIZE) -> np.ndarray:
    """Integer dot products of all canonical k-mers' +-1 vectors, as exact float64."""
    signs = lanes(kmer_hvs(k)).astype(np.float64) * 2 - 1
    return signs @ signs.T


def kmer_dimension(spark: SparkSession, k: int = KMER_SIZE) -> DataFrame:
    """(kmer, canon, kmer_id, hv array<bigint>) of all 4**k k-mers."""
    rows = []
    hvs = kmer_hvs(k).view(np.int64)
    for s, i in zip(map("".join, product("ACGT", repeat=k)), kmer_ids(k).tolist()):
        rows.append((s, canonical_kmers(k)[i], i, hvs[i].tolist()))
    return spark.createDataFrame(rows, "kmer string, canon string, kmer_id int, hv array<bigint>")
