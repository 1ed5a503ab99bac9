"""Words, lines and word windows of many texts at once, as 64-bit codes in numpy arrays.

A task takes the texts of an Arrow batch as one byte array, in runs of rows of about RUN_BYTES
(a longer text is a run of its own), so memory follows the longest text, not the batch.
Codes of equal words, lines or windows are equal; those of unequal ones are equal with
probability about 2**-64 a pair.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

RUN_BYTES = 1 << 20
U64 = np.uint64
_STEP = 0x9E3779B97F4A7C15
_BASE = 0xD1342543DE82EF95  # odd, so it has an inverse
_INVERSE = pow(_BASE, -1, 1 << 64)

#: Byte → part of a word: all but space and \t to \r.
SPACED = np.ones(256, bool)
SPACED[[32, *range(9, 14)]] = False
#: Byte → part of a word of letters and digits: 0-9, a-z and what is not ASCII.
ALPHANUMERIC = np.zeros(256, bool)
ALPHANUMERIC[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit codes."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


_BYTE_CODE = mix(np.arange(1, 257, dtype=U64) * U64(_STEP))
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """base**0 … base**(n-1) at least, modulo 2**64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        full = np.full(max(n, RUN_BYTES + 1), base, U64)
        full[0] = 1
        have = np.multiply.accumulate(full)
        if len(have) <= 4 * RUN_BYTES:
            _powers[base] = have
    return have


def row_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all rows in one array, and the n + 1 bounds of the rows. Null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    if len(column) == 0:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    bounds = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    whole = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return whole[bounds[0] : bounds[-1]], bounds - bounds[0]


def runs(bounds: np.ndarray, most: int = RUN_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows of at most so many bytes, or of one longer row."""
    row, n = 0, len(bounds) - 1
    while row < n:
        end = max(row + 1, int(np.searchsorted(bounds, bounds[row] + most, "right")) - 1)
        yield row, min(end, n)
        row = min(end, n)


def per_row(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of the flags between consecutive bounds."""
    sums = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=sums[1:])
    return sums[bounds[1:]] - sums[bounds[:-1]]


def span_codes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Codes of byte ranges."""
    if len(starts) == 0:
        return np.empty(0, U64)
    sums = np.zeros(len(data) + 1, U64)
    np.cumsum(_BYTE_CODE[data] * _power(_BASE, len(data))[: len(data)], out=sums[1:])
    raw = (sums[ends] - sums[starts]) * _power(_INVERSE, len(data) + 1)[starts]
    return mix(raw + (ends - starts).astype(U64) * U64(_STEP))


def rolling(codes: np.ndarray, k: int) -> np.ndarray:
    """Codes of k consecutive values, from each place that has so many."""
    if len(codes) < k:
        return np.empty(0, U64)
    out, width, block, size = None, 0, codes, 1
    while size <= k:
        if k & size:
            if out is None:
                out = block
            else:
                n = len(codes) - width - size + 1
                out = out[:n] + block[width : width + n] * U64(pow(_STEP, width, 1 << 64))
            width += size
        if size * 2 <= k:
            n = len(codes) - 2 * size + 1
            block = block[:n] + block[size : size + n] * U64(pow(_STEP, size, 1 << 64))
        size *= 2
    return mix(out + U64(k))


@dataclass
class Words:
    """Words of rows `first` to `first + n_rows - 1` of a batch; `bounds[r]` to `bounds[r + 1]` are those of a row."""

    first: int
    data: np.ndarray  # bytes of these rows
    rows: np.ndarray  # bounds of the rows in data
    starts: np.ndarray
    ends: np.ndarray
    bounds: np.ndarray

    @property
    def n_rows(self) -> int:
        return len(self.rows) - 1

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.bounds)

    @property
    def row(self) -> np.ndarray:
        """Row of each word."""
        return np.repeat(np.arange(self.n_rows), self.counts)

    def codes(self) -> np.ndarray:
        return span_codes(self.data, self.starts, self.ends)

    def windows(self, k: int) -> np.ndarray:
        """Places of the words from which a row has k words."""
        places = np.arange(max(0, len(self.starts) - k + 1))
        return places[places + k <= np.repeat(self.bounds[1:], self.counts)[: len(places)]]


def words_of(column, kind: np.ndarray = SPACED, lower: bool = False, most: int = RUN_BYTES) -> Iterator[Words]:
    """Words of all rows of a string column, a run of rows at a time."""
    data, bounds = row_bytes(column)
    for a, b in runs(bounds, most):
        part, rows = data[bounds[a] : bounds[b]], bounds[a : b + 1] - bounds[a]
        if lower:
            part = LOWER[part]
        inside = kind[part]
        edge = np.zeros(len(part) + 1, bool)
        edge[rows] = True  # a row ends there and another begins
        before = np.zeros(len(part), bool)
        before[1:] = inside[:-1]
        starts = np.flatnonzero(inside & (~before | edge[:-1]))
        after = np.zeros(len(part), bool)
        after[:-1] = inside[1:]
        ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
        yield Words(a, part, rows, starts, ends, np.searchsorted(starts, rows))


def repeated(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Flags of the codes that an earlier place has, and of those that any other place has."""
    order = np.argsort(codes, kind="stable")
    same = codes[order[1:]] == codes[order[:-1]]
    again, shared = np.zeros(len(codes), bool), np.zeros(len(codes), bool)
    again[order[1:][same]] = True
    shared[order[1:][same]] = True
    shared[order[:-1][same]] = True
    return again, shared


def covered(n: int, places: np.ndarray, k: int) -> np.ndarray:
    """Flags of the n values that lie in one of the windows of k from these places."""
    change = np.bincount(places, minlength=n + 1)[: n + 1] - np.bincount(places + k, minlength=n + 1)[: n + 1]
    return np.cumsum(change)[:n] > 0
