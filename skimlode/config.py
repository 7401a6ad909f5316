"""Configuration and errors of block indexes."""

from __future__ import annotations

import math
from dataclasses import dataclass

#: They decide results.
MIN_BLOCK, DEFAULT_BLOCK = 256, 256 * 1024
MIN_BITS, DEFAULT_BITS, MAX_BITS = 64, 65_536, 1 << 30
#: Blooms of so many bits or more also keep the exact set of their pairs.
EXACT_FROM = 4096
LINE_BITS = 512
MAX_TRANSPORT = 16 << 30
L1_BYTES = 32_768


class SkipIndexError(ValueError):
    """Base of all errors of this library."""


class InvalidBlockSize(SkipIndexError): ...


class UnalignedData(SkipIndexError): ...


class EmptyPatterns(SkipIndexError): ...


class ZeroBloomBits(SkipIndexError): ...


class TruncatedHeader(SkipIndexError): ...


class InvalidMagic(SkipIndexError): ...


class UnsupportedVersion(SkipIndexError): ...


class BlockCountOverflow(SkipIndexError): ...


class TruncatedBlock(SkipIndexError): ...


class ChecksumMismatch(SkipIndexError): ...


class IncompatibleIndexConfiguration(SkipIndexError): ...


class InvalidBlockId(SkipIndexError): ...


class EmptyBlockIndex(SkipIndexError): ...


class EmptyBloomUnion(SkipIndexError): ...


class TransportError(SkipIndexError): ...


class NonSuffixBlockRemoval(SkipIndexError): ...


class DataTooLarge(SkipIndexError): ...


class BloomBitsTooLarge(SkipIndexError): ...


class InvalidFpr(SkipIndexError): ...


class TrailingPartialBlock(SkipIndexError): ...


def next_power(n: int) -> int:
    return 1 << max(0, int(n) - 1).bit_length()


def bloom_size(bits: int) -> int:
    """Bits of a bloom that is asked to have `bits`: a power of two, 64 at least."""
    if bits <= 0:
        raise ZeroBloomBits("a bloom needs at least one bit")
    if bits > MAX_BITS:
        raise BloomBitsTooLarge(f"{bits} bits; {MAX_BITS} are the most")
    return max(MIN_BITS, next_power(bits))


def keeps_exact(bits: int) -> bool:
    """Whether a plain bloom keeps its exact pairs: judged by the rounded size."""
    return bloom_size(bits) >= EXACT_FROM


def compact_size(block_size: int) -> int:
    return bloom_size(max(block_size // 2, MIN_BITS, EXACT_FROM))


def size_for_rate(rate: float, items: int) -> int:
    """Bits at which three hashes of so many items have the false-positive rate."""
    if not (isinstance(rate, (int, float)) and math.isfinite(rate) and 0 < rate < 1):
        raise InvalidFpr(f"{rate} is no rate between 0 and 1")
    return bloom_size(max(MIN_BITS, math.ceil(-3 * max(1, items) / math.log(1 - rate ** (1 / 3)))))


def line_count(bits: int) -> tuple[int, bool]:
    """Lines of LINE_BITS of a blocked bloom, and whether it keeps exact pairs: judged by the size as asked for."""
    if bits <= 0:
        raise ZeroBloomBits("a bloom needs at least one bit")
    if bits > MAX_BITS:
        raise BloomBitsTooLarge(f"{bits} bits; {MAX_BITS} are the most")
    return next_power(max(1, -(-bits // LINE_BITS))), bits >= EXACT_FROM


@dataclass(frozen=True)
class IndexConfig:
    """block_size: bytes of a block, a power of two; bloom_bits: as asked for; see bits."""

    block_size: int = DEFAULT_BLOCK
    bloom_bits: int = DEFAULT_BITS

    def validate(self) -> IndexConfig:
        if self.block_size < MIN_BLOCK or self.block_size & (self.block_size - 1):
            raise InvalidBlockSize(f"{self.block_size} is no power of two of {MIN_BLOCK} or more")
        bloom_size(self.bloom_bits)
        return self

    @property
    def bits(self) -> int:
        return bloom_size(self.bloom_bits)

    @property
    def exact(self) -> bool:
        return keeps_exact(self.bloom_bits)
