"""What blocks hold, for a batch of blocks at once: codes of bytes and pairs, and the bits of their blooms."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa

from .hashing import HASHES, MULTIPLIER

#: Cells of a table of flags that are held at once.
CELLS = 1 << 24
#: Bytes of values that are looked at at once.
STRETCH = 1 << 20


def raw_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a binary column, and where each value begins in them, with the end of the last."""
    kind = np.int64 if pa.types.is_large_binary(column.type) else np.int32
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64) if offsets is not None else np.zeros(1, np.int64)
    all_ = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return all_[ends[0] : ends[-1]], ends - ends[0]


def distinct(rows: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct pairs of row and code (below 65 536), in order; rows come in order."""
    kind = np.uint32 if not len(rows) or rows[-1] < 1 << 16 else np.uint64
    key = np.sort(rows.astype(kind) << kind(16) | codes.astype(kind))
    key = key[np.concatenate(([True], key[1:] != key[:-1]))] if len(key) else key
    return (key >> kind(16)).astype(np.int64), (key & kind(0xFFFF)).astype(np.int64)


def pairs(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Row and code (first << 8 | second) of each distinct pair of adjacent bytes, in order."""
    data, starts = raw_bytes(column)
    rows = np.repeat(np.arange(len(column)), np.diff(starts))
    inside = rows[1:] == rows[:-1]
    return distinct(rows[:-1][inside], (data[:-1].astype(np.uint32) << np.uint32(8) | data[1:])[inside])


def byte_counts(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, byte and how often it is there."""
    data, starts = raw_bytes(column)
    rows = np.repeat(np.arange(len(column)), np.diff(starts))
    table = np.bincount(rows << 8 | data, minlength=len(column) << 8)
    at = np.flatnonzero(table)
    return at >> 8, at & 255, table[at]


def distinct_bytes(column: pa.Array) -> np.ndarray:
    """How many bytes each value has: STRETCH bytes of the column are looked at at once, so that long values don't count."""
    data, starts = raw_bytes(column)
    out = np.zeros(len(column), np.int64)
    first = 0
    while first < len(out):
        last = max(first + 1, int(np.searchsorted(starts, starts[first] + STRETCH, "right")) - 1)
        last = min(last, len(out), first + (STRETCH >> 8))
        seen = np.zeros((last - first) << 8, bool)
        for lo in range(int(starts[first]), int(starts[last]), STRETCH):
            at = np.arange(lo, min(int(starts[last]), lo + STRETCH))
            seen[(np.searchsorted(starts[first : last + 1], at, "right") - 1) << 8 | data[at]] = True
        out[first:last] = seen.reshape(-1, 256).sum(axis=1)
        first = last
    return out


@cache
def positions(bits: int) -> np.ndarray:
    """Bit positions of all pairs in a bloom of `bits`."""
    product = np.arange(65_536, dtype=np.uint64) * np.uint64(MULTIPLIER)
    a, b = product ^ (product >> np.uint64(32)), np.maximum(product, np.uint64(1))
    return np.stack([(a + np.uint64(k) * b) & np.uint64(bits - 1) for k in range(HASHES)], axis=1).astype(np.int64)


@cache
def line_positions(lines: int) -> np.ndarray:
    """The same in a line-blocked bloom of `lines` lines."""
    product = np.arange(65_536, dtype=np.uint64) * np.uint64(MULTIPLIER)
    a, b = product ^ (product >> np.uint64(32)), np.maximum(product, np.uint64(1))
    line = (a & np.uint64(lines - 1)) << np.uint64(9)
    return np.stack([line | (a + np.uint64(k) * b + np.uint64(k * MULTIPLIER & (1 << 64) - 1)) & np.uint64(511) for k in range(HASHES)], axis=1).astype(np.int64)


def flags(column: pa.Array, table: np.ndarray, bits: int) -> Iterator[tuple[int, int, np.ndarray]]:
    """Bounds of consecutive rows, and their blooms' bits; table: the positions of each pair."""
    rows, codes = pairs(column)
    step = max(1, CELLS // bits)
    for lo in range(0, len(column), step):
        hi = min(len(column), lo + step)
        i, j = np.searchsorted(rows, (lo, hi))
        out = np.zeros((hi - lo, bits), bool)
        out[(rows[i:j] - lo)[:, None], table[codes[i:j]]] = True
        yield lo, hi, out


def bits_set(column: pa.Array, table: np.ndarray, bits: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """The same bounds, with row (from the first of them) and position of each bit that is set, in order, without a table of flags."""
    rows, codes = pairs(column)
    step, kind = max(1, CELLS // bits), np.uint32 if bits <= 1 << 31 else np.uint64
    for lo in range(0, len(column), step):
        hi = min(len(column), lo + step)
        i, j = np.searchsorted(rows, (lo, hi))
        key = ((rows[i:j, None] - lo) * bits + table[codes[i:j]]).astype(kind).ravel()
        key.sort()
        key = key[np.concatenate(([True], key[1:] != key[:-1]))] if len(key) else key
        yield lo, hi, *np.divmod(key.astype(np.int64), bits)


def words(bits_set: np.ndarray) -> np.ndarray:
    """Rows of flags as signed 64-bit words."""
    return np.packbits(bits_set, axis=1, bitorder="little").view("<i8")


def set_bits(table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and number of each bit that is set in rows of bytes, lowest bit first; bytes that are 0 aren't unpacked."""
    rows, at = np.nonzero(table)
    which, bit = np.nonzero(np.unpackbits(table[rows, at][:, None], axis=1, bitorder="little"))
    return rows[which], at[which] << 3 | bit


def lists(rows: np.ndarray, values: np.ndarray, n: int, kind: pa.DataType, have: np.ndarray | None = None) -> pa.Array:
    """A list for each of n rows, from values in order of their rows; have: which rows have one, others are null."""
    mask = None if have is None else pa.array(~have)
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(rows, np.arange(n + 1)), pa.int32()), pa.array(values, kind), mask=mask)


def word_lists(table: np.ndarray) -> pa.Array:
    n, k = table.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * k, pa.int32()), pa.array(table.ravel(), pa.int64()))
