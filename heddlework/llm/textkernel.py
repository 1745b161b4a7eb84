"""Words, shingles and MinHash values of whole texts, computed for many texts at once with numpy.

Works on the UTF-8 bytes of an Arrow string column. A word is a maximal run of bytes that are not
ASCII white space. Hashes are 64 bits: a polynomial over the bytes of a word, taken from prefix sums
so that no loop over words is needed, followed by a mixing step.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U = np.uint64
_BASE, _STEP = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
_INVERSE = pow(_BASE, -1, 2**64)
#: Texts are handled in groups of about so many bytes, so that the arrays stay in the CPU's cache.
CHUNK = 1 << 19

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: For words of letters and digits alone: all other ASCII bytes separate.
NOT_ALNUM = np.array([b < 0x80 and not chr(b).isalnum() for b in range(256)])
LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)

_powers: list[np.ndarray] = [np.ones(1, U), np.ones(1, U)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The base and its inverse to the powers 0..n-1, modulo 2**64."""
    if len(_powers[0]) < n:
        size = max(n, 1 << 20)
        for i, base in enumerate((_BASE, _INVERSE)):
            p = np.full(size, base, U)
            p[0] = 1
            _powers[i] = np.cumprod(p, dtype=U)
    return _powers[0][:n], _powers[1][:n]


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> U(32))) * U(_STEP)
    h = (h ^ (h >> U(29))) * U(0xBF58476D1CE4E5B9)
    return h ^ (h >> U(32))


class Sums:
    """Hashes of any slices of one array, from prefix sums."""

    def __init__(self, values: np.ndarray):
        p, self.inverse = powers(len(values) + 1)
        self.sums = np.zeros(len(values) + 1, U)
        np.cumsum((values.astype(U) + U(1)) * p[: len(values)], out=self.sums[1:])

    def __call__(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self.sums[ends] - self.sums[starts]) * self.inverse[starts] + (ends - starts).astype(U))


@dataclass
class Batch:
    """Some texts: their bytes, where each text begins, and the words of all of them in order."""

    data: np.ndarray  # uint8
    offsets: np.ndarray  # of texts, len n + 1
    starts: np.ndarray  # of words, in bytes
    ends: np.ndarray
    first: np.ndarray  # index of each text's first word, len n + 1
    rows: slice  # of the Arrow batch

    @property
    def n_words(self) -> np.ndarray:
        return np.diff(self.first)

    @property
    def doc(self) -> np.ndarray:
        """For each word, which text it is in."""
        return np.repeat(np.arange(len(self.first) - 1), self.n_words)


def batches(column: pa.Array, separators: np.ndarray = SPACE, lower: bool = False) -> Iterator[Batch]:
    """The texts of a string column in groups of CHUNK bytes; a longer text is a group of its own."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    n = len(column)
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + CHUNK, "right")) - 1)
        j = min(j, n)
        own, at = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        yield words(LOWER[own] if lower else own, at, separators, slice(i, j))
        i = j


def words(data: np.ndarray, offsets: np.ndarray, separators: np.ndarray, rows: slice) -> Batch:
    size = len(data)
    apart = separators[data]
    before, after = np.ones(size, bool), np.ones(size, bool)
    before[1:], after[:-1] = apart[:-1], apart[1:]
    full = offsets[:-1] < offsets[1:]
    before[offsets[:-1][full]] = True
    after[offsets[1:][full] - 1] = True
    starts, ends = np.flatnonzero(~apart & before), np.flatnonzero(~apart & after) + 1
    return Batch(data, offsets, starts, ends, np.searchsorted(starts, offsets), rows)


def word_hashes(b: Batch) -> np.ndarray:
    return Sums(b.data)(b.starts, b.ends)


def shingles(b: Batch, n: int, hashes: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of n words of each text, in order, and where each text's begin (len texts + 1).

    A text with words, but fewer than n, has one shingle: all of its words. A text without has none.
    """
    h = word_hashes(b) if hashes is None else hashes
    count = np.where(b.n_words >= n, b.n_words - n + 1, np.minimum(b.n_words, 1))
    first = np.concatenate([[0], np.cumsum(count)])
    sums = Sums(h)
    start = np.repeat(b.first[:-1] - first[:-1], count) + np.arange(first[-1])
    end = np.minimum(start + n, np.repeat(b.first[1:], count))
    return sums(start, end), first


def seeds(k: int, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """For k MinHash functions: what is added by exclusive or, and the odd factors."""
    r = np.random.default_rng(seed)
    return r.integers(0, 2**32, k, np.uint32), r.integers(0, 2**31, k, np.uint32) * np.uint32(2) + np.uint32(1)


def permuted(low: np.ndarray, x: np.uint32, a: np.uint32, out: np.ndarray, spare: np.ndarray) -> np.ndarray:
    """One MinHash function of 32-bit values; out and spare are arrays of their shape to work in."""
    np.bitwise_xor(low, x, out=out)
    np.multiply(out, a, out=out)
    np.right_shift(out, np.uint32(15), out=spare)
    np.bitwise_xor(out, spare, out=out)
    return np.multiply(out, np.uint32(0x2C1B3C6D), out=out)


def minhash(values: np.ndarray, first: np.ndarray, k: int, seed: int = 1) -> np.ndarray:
    """MinHash signatures, uint32 of shape (texts, k); texts without shingles get the largest value."""
    full = np.flatnonzero(first[:-1] < first[1:])
    out = np.full((len(first) - 1, k), 0xFFFFFFFF, np.uint32)
    if len(full):
        low = (values >> U(16)).astype(np.uint32)
        v, spare = np.empty_like(low), np.empty_like(low)
        at = first[:-1][full]
        for i, (x, a) in enumerate(zip(*seeds(k, seed), strict=True)):
            out[full, i] = np.minimum.reduceat(permuted(low, x, a, v, spare), at)
    return out
