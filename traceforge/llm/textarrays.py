"""Whole Arrow batches of texts as flat byte arrays: words, hashes and per-document sums without a Python loop.

All offsets are byte offsets into the batch's UTF-8 buffer. A null text counts as empty.
A span of bytes is hashed eight bytes at a time, a word sequence by doubling; each step is a bijective
mix of what came before plus what comes next, so no arrangement of bytes or words cancels out, as it does in
polynomials. Two seeds give two independent 64-bit lanes. Equal sequences always get equal hashes; one lane
proposes candidates, both together (128 bits) stand for the sequence itself.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash

U = np.uint64
#: Spans beyond this many bytes are hashed by xxh3, one by one.
LONG = 256
_FIRST = np.array([(1 << 8 * i) - 1 for i in range(9)], U)
#: Seeds of the two lanes, and what tells the doubling steps apart from one another.
SEEDS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
STEP = U(0x5851F42D4C957F2D)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (multiply, shift, xor)."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def joined(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Hashes of sequences from those of their two parts, in order."""
    return mix(mix(left + STEP) + right)


def renamed(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Numbers for pairs of numbers, the same for the same pair and only for it."""
    return np.unique(left * (right.max(initial=0) + 1) + right, return_inverse=True)[1]


def sequence_hashes(values: np.ndarray, k: int, join=joined) -> np.ndarray:
    """A hash of every k consecutive values (k >= 1), by doubling: lengths 1, 2, 4, ... and their sums to k. With ``renamed``, exact numbers."""
    power, whole, done = values, None, 0
    length = 1
    while True:
        if k & length:
            whole = power if whole is None else join(whole[: len(whole) - length], power[done:])
            done += length
        if done == k:
            return whole
        if len(power) <= length:
            return values[:0]
        power = join(power[:-length], power[length:])
        length *= 2


@dataclass
class Texts:
    """Some consecutive rows of a batch: their bytes, and where each row begins."""

    first: int
    data: np.ndarray
    offsets: np.ndarray

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def sums(self, mask: np.ndarray) -> np.ndarray:
        """Per row, the sum of ``mask`` over its bytes."""
        c = np.zeros(len(mask) + 1, np.int64)
        np.cumsum(mask, out=c[1:])
        return c[self.offsets[1:]] - c[self.offsets[:-1]]

    def runs(self, outside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Maximal runs of bytes that are not ``outside``, never across rows: starts, ends, and each row's first run."""
        inside = ~outside
        begin = inside.copy()
        begin[1:] &= outside[:-1]
        final = inside.copy()
        final[:-1] &= outside[1:]
        filled = self.offsets[:-1][self.offsets[1:] > self.offsets[:-1]]
        begin[filled] = inside[filled]
        last = self.offsets[1:][self.offsets[1:] > self.offsets[:-1]] - 1
        final[last] = inside[last]
        starts = np.flatnonzero(begin)
        return starts, np.flatnonzero(final) + 1, np.searchsorted(starts, self.offsets)

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Words ``[^\\x20\\x09-\\x0D]+``: starts, ends, and each row's first word."""
        return self.runs(_SPACE[self.data])

    def lowered(self) -> Texts:
        """The same rows with A-Z in lower case."""
        return Texts(self.first, _LOWER[self.data], self.offsets)

    def hashes(self, starts: np.ndarray, ends: np.ndarray, lane: int = 0) -> np.ndarray:
        """A 64-bit hash of each byte span."""
        size = ends - starts
        out = mix(size.astype(U) + U(SEEDS[lane]))
        padded = np.concatenate([self.data, np.zeros(8, np.uint8)])
        eight = np.ndarray(len(self.data) + 1, "<u8", padded, strides=(1,))  # the eight bytes from each place on
        for i in np.flatnonzero(size > LONG):
            out[i] = xxhash.xxh3_64_intdigest(memoryview(self.data[starts[i] : ends[i]]), SEEDS[lane])
        at, now = np.flatnonzero((size > 0) & (size <= LONG)), 0
        while len(at):
            left = size[at] - now
            bytes_ = eight[starts[at] + now] & _FIRST[np.minimum(left, 8)]
            out[at] = joined(out[at], bytes_)
            at, now = at[left > 8], now + 8
        return out

    def codes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """A number for each byte span, the same for the same bytes and only for them."""
        if not len(starts):
            return np.zeros(0, np.int64)
        change = np.zeros(len(self.data) + 1, np.int8)
        change[starts] += 1
        change[ends] -= 1
        at = np.zeros(len(starts) + 1, np.int64)
        np.cumsum(ends - starts, out=at[1:])
        inside = self.data[np.cumsum(change[:-1], dtype=np.int8).view(bool)]
        spans = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(at), pa.py_buffer(inside)])
        return spans.dictionary_encode().indices.to_numpy().astype(np.int64)

    def text(self, row: int) -> bytes:
        return self.data[self.offsets[row] : self.offsets[row + 1]].tobytes()


def pieces(column: pa.Array, most: int = 2 << 20) -> Iterator[Texts]:
    """Cut a string column into runs of rows of about ``most`` bytes; a longer single text stands alone."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    at = np.frombuffer(column.buffers()[1], kind)[column.offset : column.offset + n + 1].astype(np.int64) if n else np.zeros(1, np.int64)
    body = column.buffers()[2]
    data = np.frombuffer(body, np.uint8) if body is not None and body.size else np.zeros(0, np.uint8)
    row = 0
    while row < n:
        end = int(np.searchsorted(at, at[row] + most, side="right")) - 1
        end = min(n, max(row + 1, end))
        yield Texts(row, data[at[row] : at[end]], at[row : end + 1] - at[row])
        row = end


def grams(values: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all k consecutive words of one row: (index of the first word, hash)."""
    n = len(values)
    if n < k:
        return np.zeros(0, np.int64), np.zeros(0, U)
    at = starts_of(first, n, k)
    return at, sequence_hashes(values, k)[at]


def starts_of(first: np.ndarray, n: int, k: int) -> np.ndarray:
    """Where k consecutive words of one row begin."""
    left = np.repeat(first[1:], np.diff(first)) - np.arange(n)  # words from here to the row's end
    return np.flatnonzero(left >= k)
