"""Vectorised UTF-8 text kernels shared by the operators of this subpackage.

Everything here works on the raw bytes of an Arrow string array with NumPy, so a batch of documents costs a
handful of array passes instead of a Python loop over words. Batches are cut into slices of about ``SLICE_BYTES``
bytes (or one document, when that is longer), which bounds the working memory at roughly forty times the slice.

A word is a maximal run of bytes other than space and 0x09-0x0D. These are ASCII, so splitting bytes equals
splitting code points. Hashes are 64-bit: polynomials over random byte values, read from running sums, in two lanes,
one modulo 2^64 and one modulo the prime 2^31 - 1 (without which structured words, such as Thue-Morse words, would meet), then
finished with a full-avalanche mixer. Where 64 bits are too few, the second lane is given beside them.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 18
_U = np.uint64
_RNG = np.random.default_rng(20240607)
_BASE = int(_RNG.integers(1 << 62, 1 << 63)) * 2 + 1 & ((1 << 64) - 1)
_BASE_INV = pow(_BASE, -1, 1 << 64)
_VALUES = _RNG.integers(1, 1 << 63, 256, dtype=np.int64).astype(_U) * _U(2) + _U(1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_VALUES_LOWER = _VALUES[_LOWER]
_STEP = _RNG.integers(1 << 62, 1 << 63, 64, dtype=np.int64).astype(_U) * _U(2) + _U(1)
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[32, 9, 10, 11, 12, 13]] = True
_powers: tuple[np.ndarray, np.ndarray] = (np.ones(1, _U), np.ones(1, _U))
_PRIME = (1 << 31) - 1
_PRIME_BASE = int(_RNG.integers(1 << 29, _PRIME))
_PRIME_VALUES = _RNG.integers(1, _PRIME, 256, dtype=np.int64).astype(_U)
_PRIME_LOWER = _PRIME_VALUES[_LOWER]
_prime_powers: tuple[np.ndarray, np.ndarray] = (np.ones(1, _U), np.ones(1, _U))


def mix(x: np.ndarray) -> np.ndarray:
    """Full-avalanche 64-bit mixer."""
    with np.errstate(over="ignore"):
        x = x + _U(0x9E3779B97F4A7C15)
        x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
        return x ^ (x >> _U(31))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse for positions 0..n."""
    global _powers
    if len(_powers[0]) <= n:
        with np.errstate(over="ignore"):
            size = max(n + 1, SLICE_BYTES + 1)
            tables = []
            for base in (_BASE, _BASE_INV):
                t = np.full(size, base, _U)
                t[0] = 1
                tables.append(np.multiply.accumulate(t))
        _powers = tables[0], tables[1]
    return _powers


def _prime_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the second lane's base and of its inverse, modulo the prime."""
    global _prime_powers
    if len(_prime_powers[0]) <= n:
        size = max(n + 1, SLICE_BYTES + 1)
        tables = []
        for base in (_PRIME_BASE, pow(_PRIME_BASE, -1, _PRIME)):
            t = np.ones(size, _U)
            k = 1
            while k < size:  # the first k powers give the next k
                t[k : 2 * k] = t[: min(k, size - k)] * _U(pow(base, k, _PRIME)) % _U(_PRIME)
                k *= 2
            tables.append(t)
        _prime_powers = tables[0], tables[1]
    return _prime_powers


RELEASE_BYTES = 16 << 20
_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the C library, where it has one
_handled = 0


def release(n: int) -> None:
    """Counts n handled bytes; now and then gives memory that freed arrays leave behind back to the system, as workers live on."""
    global _handled
    _handled += n
    if _handled > RELEASE_BYTES:
        _handled = 0
        pa.default_memory_pool().release_unused()
        if _trim is not None:
            _trim(0)


class Text:
    """The bytes of consecutive documents, with the byte range of each."""

    def __init__(self, data: np.ndarray, bounds: np.ndarray):
        self.data, self.bounds = data, bounds
        self._sums: dict[bool, tuple[np.ndarray, np.ndarray]] = {}

    def __len__(self) -> int:
        return len(self.bounds) - 1

    def doc(self, i: int) -> bytes:
        return self.data[self.bounds[i] : self.bounds[i + 1]].tobytes()

    def _running(self, lower: bool) -> tuple[np.ndarray, np.ndarray]:
        """Running sums of both lanes before each byte."""
        if lower not in self._sums:
            n = len(self.data)
            sums, prime = np.empty(n + 1, _U), np.empty(n + 1, _U)
            sums[0] = prime[0] = 0
            np.multiply((_VALUES_LOWER if lower else _VALUES)[self.data], _power_tables(n)[0][:n], out=sums[1:])
            np.cumsum(sums[1:], out=sums[1:])
            term = (_PRIME_LOWER if lower else _PRIME_VALUES)[self.data]
            term *= _prime_tables(n)[0][:n]
            np.bitwise_and(term, _U(_PRIME), out=prime[1:])
            term >>= _U(31)
            prime[1:] += term  # congruent and below 2^32
            np.cumsum(prime[1:], out=prime[1:])
            self._sums[lower] = sums, prime
        return self._sums[lower]

    def strong_ranges(self, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """64-bit hashes of the byte ranges, and 31 bits more; ``lower`` folds A-Z first."""
        with np.errstate(over="ignore"):
            sums, prime = self._running(lower)
            n = len(self.data)
            second = (prime[ends] - prime[starts]) % _U(_PRIME) * _prime_tables(n)[1][starts] % _U(_PRIME)
            first = (sums[ends] - sums[starts]) * _power_tables(n)[1][starts]
            return mix(first + second * _STEP[1] + (ends - starts).astype(_U) * _STEP[0]), second

    def hash_ranges(self, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> np.ndarray:
        """64-bit hashes of the byte ranges; ``lower`` folds A-Z first."""
        return self.strong_ranges(starts, ends, lower)[0]

    def code_points_before(self) -> np.ndarray:
        """Running number of code points before each byte position."""
        out = np.zeros(len(self.data) + 1, np.int64)
        np.cumsum((self.data & 0xC0) != 0x80, out=out[1:])
        return out

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, end and document of every word, in order."""
        inside = ~IS_SPACE[self.data]
        before = np.zeros(len(inside) + 1, bool)
        before[1:] = inside
        cuts = self.bounds[self.bounds < len(inside)]
        before[cuts] = False
        starts = np.flatnonzero(inside & ~before[:-1])
        after = np.zeros(len(inside) + 1, bool)
        after[:-1] = inside
        after[self.bounds] = False
        ends = np.flatnonzero(inside & ~after[1:]) + 1
        return starts, ends, self.owner(starts)

    def lines(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, end and document of every newline-separated line; an empty document has one empty line."""
        breaks = np.flatnonzero(self.data == 10)
        owner = self.owner(breaks)
        starts = np.concatenate([self.bounds[:-1], breaks + 1])
        docs = np.concatenate([np.arange(len(self)), owner])
        order = np.lexsort((starts, docs))
        starts, docs = starts[order], docs[order]
        ends = np.concatenate([breaks, self.bounds[1:]])
        edocs = np.concatenate([owner, np.arange(len(self))])
        return starts, ends[np.lexsort((ends, edocs))], docs

    def owner(self, positions: np.ndarray) -> np.ndarray:
        """Document that holds each byte position (empty documents own none)."""
        return np.searchsorted(self.bounds[1:], positions, side="right")

    def stripped(self, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ranges without white space at both ends; a blank range becomes empty."""
        n = len(self.data)
        solid = ~IS_SPACE[self.data]
        where = np.arange(n)
        first = np.full(n + 1, n)
        first[:-1] = np.minimum.accumulate(np.where(solid, where, n)[::-1])[::-1]
        last = np.zeros(n + 1, np.int64)
        np.maximum.accumulate(np.where(solid, where + 1, 0), out=last[1:])
        s = np.minimum(first[starts], ends)
        return s, np.maximum(last[ends], s)


def text_slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, Text]]:
    """(first row, end row, text) slices of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    i, n = 0, len(column)
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1)
        yield i, j, Text(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
        release(int(offsets[j] - offsets[i]))
        i = j


def shingles(words: np.ndarray, docs: np.ndarray, n_docs: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and document of every k-word shingle; a document of 1..k-1 words gives its whole sequence as one."""
    counts = np.bincount(docs, minlength=n_docs)
    first = np.concatenate([[0], np.cumsum(counts)[:-1]])
    with np.errstate(over="ignore"):
        n = max(0, len(words) - k + 1)
        at = np.flatnonzero(docs[:n] == docs[k - 1 :]) if n else np.zeros(0, np.int64)
        h = np.full(len(at), _STEP[k], _U)
        for i in range(k):
            h += words[at + i] * _STEP[i]
        short = np.flatnonzero((counts > 0) & (counts < k))
        s = np.array([_STEP[32 + counts[d]] + (words[first[d] : first[d] + counts[d]] * _STEP[: counts[d]]).sum(dtype=_U) for d in short], _U)
    owner = np.concatenate([docs[at], short])
    order = np.argsort(owner, kind="stable")
    return mix(np.concatenate([h, s]))[order], owner[order]


def unique_by_doc(values: np.ndarray, docs: np.ndarray, n_docs: int) -> list[np.ndarray]:
    """The sorted distinct values of each document; ``docs`` ascends."""
    ends = np.searchsorted(docs, np.arange(n_docs), side="right")
    starts = np.concatenate([[0], ends[:-1]])
    return [np.unique(values[a:b]) for a, b in zip(starts, ends)]


def shingle_sets(text: Text, k: int, lower: bool) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each document."""
    s, e, d = text.words()
    h, owner = shingles(text.hash_ranges(s, e, lower), d, len(text), k)
    return unique_by_doc(h, owner, len(text))


def signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)


def list_array(parts: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    """A list column from one array a row."""
    offsets = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int32)
    flat = np.concatenate(parts) if parts else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, kind))
