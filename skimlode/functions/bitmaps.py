"""Exact tables of pairs as bitmaps: what Spark's own bitmap functions unite and count, and byte masks test.

A table is two binary columns, pairs whose first byte is below 0x80 and the others. Bit i % 8 of byte i // 8 is that of pair
i, as Spark's bitmaps have it; bytes after the last one that isn't 0 are left out, and a half without pairs is empty.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.filters import NgramFilter
from . import blooms, vectors

#: Bytes of a half: fixed by Spark's bitmaps.
HALF = 4096
HALVES = ("exact_low", "exact_high")
#: Bytes of tables that are held at once.
TABLE_BYTES = 16 << 20


def tables(codes_of_rows: tuple[np.ndarray, np.ndarray], n: int) -> Iterator[tuple[int, int, np.ndarray]]:
    """Bounds of consecutive rows and their tables, from row and code of each distinct pair in order."""
    rows, codes = codes_of_rows
    step = max(1, TABLE_BYTES // (2 * HALF))
    for lo in range(0, n, step):
        hi = min(n, lo + step)
        i, j = np.searchsorted(rows, (lo, hi))
        at = (rows[i:j] - lo) * (2 * HALF) + (codes[i:j] >> 3)
        out = np.zeros((hi - lo) * 2 * HALF, np.uint8)
        if len(at):
            first = np.concatenate(([0], 1 + np.flatnonzero(at[1:] != at[:-1])))
            out[at[first]] = np.bitwise_or.reduceat(np.uint8(1) << (codes[i:j] & 7).astype(np.uint8), first)
        yield lo, hi, out.reshape(hi - lo, 2, HALF)


def _trimmed(halves: np.ndarray) -> pa.Array:
    used = HALF - np.argmax(halves[:, ::-1] != 0, axis=1)
    used[~halves.any(axis=1)] = 0
    return pa.array([h[:k].tobytes() for h, k in zip(halves, used.tolist())], pa.binary())


def exact_tables(blocks: DataFrame) -> DataFrame:
    """file_id, block_id, offset, length, exact_low, exact_high: each block's pairs, that across its start included. No shuffle."""
    rows = blocks.select("file_id", "block_id", "offset", "length", "ext")
    schema = T.StructType([*rows.schema.fields[:4], *(T.StructField(c, T.BinaryType()) for c in HALVES)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, found in tables(vectors.pairs(b.column(4)), b.num_rows):
                yield pa.RecordBatch.from_arrays([*(c[lo:hi] for c in b.columns[:4]), _trimmed(found[:, 0]), _trimmed(found[:, 1])], schema.fieldNames())

    return rows.mapInArrow(run, schema)


def united(found: DataFrame, *keys: str) -> DataFrame:
    """keys and the union of their tables: halves or-ed by Spark, in tasks first. Exact bits stay exact."""
    return found.groupBy(*keys).agg(*[F.bitmap_or_agg(c).alias(c) for c in HALVES])


def pair_count() -> Column:
    """How many pairs a table has."""
    low, high = (F.coalesce(F.bitmap_count(c), F.lit(0)) for c in HALVES)
    return low + high


def has_pair(pair: int) -> Column:
    """Whether the table has a pair: one hexadecimal digit of one byte; constant places and masks, no function of Python."""
    half, bit = divmod(pair, 8 * HALF)
    byte, k = divmod(bit, 8)
    digit = F.substring(F.hex(F.substring(F.col(HALVES[half]), byte + 1, 1)), 1 if k >= 4 else 2, 1)
    return F.coalesce(digit.isin([f"{d:X}" for d in range(16) if d >> (k & 3) & 1]), F.lit(False))


def has_pattern(pattern: bytes) -> Column:
    """All adjacent pairs of the pattern; true for patterns of fewer than two bytes."""
    return blooms.contains_all([has_pair(p) for p in dict.fromkeys(blooms.pattern_pairs(pattern))])


def matching(found: DataFrame, ngram: NgramFilter, *keys: str) -> DataFrame:
    """keys of tables that hold all pairs of a pattern."""
    return found.where(ngram.matches(has_pair)).select(*keys)


def table_of(pairs: Sequence[int]) -> tuple[bytes, bytes]:
    """The two halves of some pairs, for comparison and for tables made on the driver."""
    codes = np.array(sorted(set(pairs)), np.int64)
    (_, _, found), = tables((np.zeros(len(codes), np.int64), codes), 1)
    return tuple(_trimmed(found[:, k])[0].as_py() for k in range(2))
