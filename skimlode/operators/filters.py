"""Patterns compiled to what blocks must contain, and predicates over summaries."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from enum import Enum

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import blooms

#: Bytes that quick_reject looks at.
QUICK_BYTES = 4096
Test = Callable[[int], Column]


@dataclass(frozen=True)
class ByteFilter:
    """Of each pattern the distinct bytes: one pattern's must all be there."""

    requirements: tuple[tuple[int, ...], ...] = ()

    @classmethod
    def from_patterns(cls, patterns: Sequence[bytes]) -> ByteFilter:
        """Empty patterns are left out."""
        return cls(tuple(tuple(sorted(set(p))) for p in patterns if p))

    @classmethod
    def from_single_pattern(cls, pattern: bytes) -> ByteFilter:
        """An empty pattern asks for nothing, so it matches everything."""
        return cls((tuple(sorted(set(pattern))),))

    @property
    def required_count(self) -> int:
        return len({b for r in self.requirements for b in r})

    def matches(self, has: Test) -> Column:
        """has: whether a byte is in the block, or in any of the blocks that are looked at together."""
        return blooms.contains_any([blooms.contains_all([has(b) for b in r]) for r in self.requirements])


@dataclass(frozen=True)
class NgramFilter:
    """Of each pattern the sorted distinct pairs; a pattern of one byte has none and matches any bloom."""

    requirements: tuple[tuple[int, ...], ...] = ()
    max_pattern_bytes: int = 0

    @classmethod
    def from_patterns(cls, patterns: Sequence[bytes]) -> NgramFilter:
        return cls(tuple(tuple(sorted(set(blooms.pattern_pairs(p)))) for p in patterns if p), max(map(len, patterns), default=0))

    def matches(self, has: Test) -> Column:
        return blooms.contains_any([blooms.contains_all([has(p) for p in r]) for r in self.requirements])

    def quick_reject(self, data: Column) -> Column:
        """Whether the data's first bytes may match (so true means: don't reject); false without patterns."""
        head = F.substring(data, 1, QUICK_BYTES)
        return self.matches(lambda p: pair_in(head, p))


def byte_in(data: Column, byte: int) -> Column:
    return F.contains(data, F.lit(bytes([byte])))


def pair_in(data: Column, pair: int) -> Column:
    return F.contains(data, F.lit(bytes([pair >> 8, pair & 255])))


class FilterOp(Enum):
    AND = "and"
    OR = "or"


@dataclass(frozen=True)
class CompositeFilter:
    """A tree of filters over one block."""

    part: ByteFilter | NgramFilter | None = None
    op: FilterOp | None = None
    parts: tuple[CompositeFilter, ...] = ()

    @classmethod
    def combine(cls, op: FilterOp, *parts: CompositeFilter | ByteFilter | NgramFilter) -> CompositeFilter:
        return cls(None, op, tuple(p if isinstance(p, CompositeFilter) else cls(p) for p in parts))

    def matches(self, has_byte: Test, has_pair: Test) -> Column:
        if self.part is not None:
            return self.part.matches(has_byte if isinstance(self.part, ByteFilter) else has_pair)
        joined = [p.matches(has_byte, has_pair) for p in self.parts]
        return blooms.contains_all(joined) if self.op is FilterOp.AND else blooms.contains_any(joined)
