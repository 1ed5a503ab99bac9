"""CRC-32 of many spans at once, from a table of what a byte adds at its distance from the end.

A CRC without its initial and final complement is linear: the code of a span is the XOR over its
bytes of (byte, followed by as many zero bytes as stand after it). `POSITIONS[d][b]` holds these
for the last PLACES bytes of a span, so a span's code is one `bitwise_xor.reduceat` over looked-up
values; what the complements add depends on the length alone. A longer span is reduced in blocks
of PLACES bytes counted from its end, which are then joined in pairs, each step moving the farther
one of a pair by twice as many bytes as the step before: log2 of the blocks in steps.
"""

from __future__ import annotations

import numpy as np

U32 = np.uint32
POLYNOMIAL = 0xEDB88320
PLACES = 64
_SHIFT = PLACES.bit_length() - 1
ONES = U32(0xFFFFFFFF)


def _byte_codes() -> np.ndarray:
    codes = np.arange(256, dtype=U32)
    for _ in range(8):
        codes = (codes >> U32(1)) ^ np.where(codes & U32(1), U32(POLYNOMIAL), U32(0))
    return codes


def _position_table() -> np.ndarray:
    rows = [_byte_codes()]
    for _ in range(PLACES - 1):
        rows.append((rows[-1] >> U32(8)) ^ rows[0][rows[-1] & U32(255)])
    return np.array(rows)


#: distance from the end, byte → its part of the code
POSITIONS = _position_table()
_FLAT = POSITIONS.ravel()


def _moved(codes: np.ndarray, tables: np.ndarray) -> np.ndarray:
    out = tables[0][codes & U32(255)]
    for i in range(1, 4):
        out = out ^ tables[i][(codes >> U32(8 * i)) & U32(255)]
    return out


def _movers(n: int) -> list[np.ndarray]:
    """Tables that put 1, 2, 4 … zero bytes after a code, by its four bytes."""
    one = np.array([POSITIONS[0], *(np.arange(256, dtype=U32) << U32(8 * i - 8) for i in range(1, 4))])
    out = [one]
    while len(out) < n:
        out.append(np.array([_moved(row, out[-1]) for row in out[-1]]))
    return out


_MOVERS = _movers(40)


def length_codes(lengths: np.ndarray) -> np.ndarray:
    """What the two complements add to the code of spans of these lengths."""
    known, place = np.unique(lengths, return_inverse=True)
    codes = np.full(len(known), ONES, U32)
    for bit in range(int(known.max()).bit_length() if len(known) else 0):
        has = known >> bit & 1 == 1
        codes[has] = _moved(codes[has], _MOVERS[bit])
    return (codes ^ ONES)[place]


def linear(data: np.ndarray, starts: np.ndarray, after: np.ndarray, keep: np.ndarray | None = None) -> np.ndarray:
    """XOR of what the bytes of consecutive spans add.

    The spans begin at `starts` and cover the data; `after` bytes follow the last byte of each
    before the end that distances count from. Bytes that `keep` doesn't flag add nothing.
    """
    if not len(starts):
        return np.empty(0, U32)
    lengths = np.diff(np.append(starts, len(data)))
    distance = np.repeat(starts + lengths - 1 + after, lengths) - np.arange(len(data))
    parts = _FLAT[(distance & (PLACES - 1)) << 8 | data]
    if keep is not None:
        parts = np.where(keep, parts, U32(0))
    if (lengths + after).max() <= PLACES:
        return np.bitwise_xor.reduceat(parts, starts)
    # blocks: a span's bytes of equal distance // PLACES
    block = np.maximum(distance, 0) >> _SHIFT
    edge = np.zeros(len(data), bool)
    edge[starts] = True
    edge[1:] |= block[1:] != block[:-1]
    at = np.flatnonzero(edge)
    codes, block = np.bitwise_xor.reduceat(parts, at), block[at]
    span = np.searchsorted(starts, at, "right") - 1
    bit = _SHIFT
    while block.any():
        odd = block & 1 == 1
        codes[odd] = _moved(codes[odd], _MOVERS[bit])
        block, bit = block >> 1, bit + 1
        first = np.ones(len(block), bool)
        first[1:] = (block[1:] != block[:-1]) | (span[1:] != span[:-1])
        at = np.flatnonzero(first)
        codes, block, span = np.bitwise_xor.reduceat(codes, at), block[at], span[at]
    return codes


def gram_codes(data: np.ndarray, starts: np.ndarray, longest: int) -> list[np.ndarray]:
    """CRC-32 of 1 to `longest` consecutive words joined by the byte between them.

    Words begin at `starts` and cover the data, each with one byte after it that belongs to no
    word's end. Entry n - 1 holds the grams of n words, by their first word.
    """
    n_words = len(starts)
    ends = np.append(starts[1:], len(data)) - 1
    last = np.zeros(len(data), bool)
    last[ends] = True
    rest = linear(data, starts, np.full(n_words, -1), ~last)
    out = [rest ^ length_codes(ends - starts)]
    for n in range(2, longest + 1):
        here = max(0, n_words - n + 1)
        if not here:
            out.append(np.empty(0, U32))
            continue
        stop = ends[n - 1 :]
        # the first word and its space, at their distance from the last word's end, and the words after it
        head = linear(data[: starts[here] if here < n_words else len(data)], starts[:here], stop - ends[:here] - 1)
        rest = head ^ rest[1 : here + 1]
        out.append(rest ^ length_codes(stop - starts[:here]))
    return out
