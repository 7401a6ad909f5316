"""The hash of byte pairs, as column expressions that never overflow 64 bits, and the same in Python for literals."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the multiplier, and its halves.
MULTIPLIER = 0x9E3779B97F4A7C15
LOW, HIGH = MULTIPLIER & 0xFFFFFFFF, MULTIPLIER >> 32
MASK32, MASK64 = (1 << 32) - 1, (1 << 64) - 1
HASHES = 3


def pair_hash(pair: int) -> tuple[int, int]:
    """Both 64-bit hashes of a pair's code: the product folded onto itself, and the product (1 where that is 0)."""
    product = pair * MULTIPLIER & MASK64
    return product ^ (product >> 32), max(product, 1)


def positions(pair: int, bits: int) -> list[int]:
    """Bit positions of a pair in a bloom of `bits` (a power of two)."""
    a, b = pair_hash(pair)
    return [(a + k * b) & (bits - 1) for k in range(HASHES)]


def line_positions(pair: int, lines: int) -> tuple[int, list[int]]:
    """Line, and bits in it, of a pair in a blocked bloom."""
    a, b = pair_hash(pair)
    return a & (lines - 1), [(a + k * b + k * MULTIPLIER) & 511 for k in range(HASHES)]


def low_hashes(pair: Column) -> tuple[Column, Column]:
    """The low 32 bits of both hashes: all that masks of 30 bits or fewer need."""
    code = pair.cast("long")
    low = code * F.lit(LOW)
    product = low.bitwiseAND(F.lit(MASK32))
    upper = (code * F.lit(HIGH) + F.shiftright(low, 32)).bitwiseAND(F.lit(MASK32))
    return product.bitwiseXOR(upper), F.when(code == 0, F.lit(1).cast("long")).otherwise(product)


def position_columns(pair: Column, bits: int) -> Column:
    a, b = low_hashes(pair)
    return F.array(*[(a + F.lit(k) * b).bitwiseAND(F.lit(bits - 1)) for k in range(HASHES)])


def line_columns(pair: Column, lines: int) -> tuple[Column, Column]:
    a, b = low_hashes(pair)
    step = MULTIPLIER & 511
    return a.bitwiseAND(F.lit(lines - 1)), F.array(*[(a + F.lit(k) * b + F.lit(k * step)).bitwiseAND(F.lit(511)) for k in range(HASHES)])
