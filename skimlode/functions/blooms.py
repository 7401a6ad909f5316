"""Summaries of one block as column expressions: its pairs, its bloom, and what they may contain."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import LINE_BITS, EmptyBloomUnion, IncompatibleIndexConfiguration
from .hashing import line_positions, positions


def union_words(blooms: Sequence[Column], bits: Sequence[int] = ()) -> Column:
    """Blooms or-ed word by word; the union has no exact pairs. bits: the blooms' sizes, which must be equal."""
    if not blooms:
        raise EmptyBloomUnion("no bloom to unite")
    if len(set(bits)) > 1:
        raise IncompatibleIndexConfiguration(f"blooms of {sorted(set(bits))} bits can't be united")
    out = blooms[0]
    for b in blooms[1:]:
        out = F.zip_with(out, b, lambda x, y: x.bitwiseOR(y))
    return out


def _has_bits(words: Column, at: Sequence[int]) -> Column:
    masks: dict[int, int] = {}
    for p in at:
        masks[p // 64] = masks.get(p // 64, 0) | 1 << p % 64
    test = F.lit(True)
    for w, m in sorted(masks.items()):
        signed = m - (1 << 64) if m >> 63 else m
        test = test & (F.element_at(words, w + 1).bitwiseAND(F.lit(signed)) == F.lit(signed))
    return test


def bloom_has(words: Column, pair: int, bits: int) -> Column:
    """Whether all of a pair's bits are set; constant words and masks, no function of Python."""
    return _has_bits(words, positions(pair, bits))


def blocked_has(words: Column, exact: Column | None, pair: int, lines: int) -> Column:
    """The same in a line-blocked bloom (summary.blocked_words), by the exact pairs if there are any."""
    line, at = line_positions(pair, lines)
    probe = _has_bits(words, [line * LINE_BITS + b for b in at])
    return probe if exact is None else F.when(exact.isNotNull(), F.array_contains(exact, pair)).otherwise(probe)


def blocked_has_all(words: Column, exact: Column | None, pairs: Sequence[int], lines: int) -> Column:
    """All of the pairs; true for none."""
    return contains_all([blocked_has(words, exact, p, lines) for p in dict.fromkeys(pairs)])


def maybe_contains(words: Column, exact: Column | None, pair: int, bits: int) -> Column:
    """By the exact pairs if there are any, else by the bloom."""
    probe = bloom_has(words, pair, bits)
    return probe if exact is None else F.when(exact.isNotNull(), F.array_contains(exact, pair)).otherwise(probe)


def contains_all(tests: Sequence[Column]) -> Column:
    out = F.lit(True)
    for t in tests:
        out = out & t
    return out


def contains_any(tests: Sequence[Column]) -> Column:
    out = F.lit(False)
    for t in tests:
        out = out | t
    return out


def pattern_pairs(pattern: bytes) -> list[int]:
    return [a << 8 | b for a, b in zip(pattern[:-1], pattern[1:])]


def maybe_contains_pattern(words: Column, exact: Column | None, pattern: bytes, bits: int) -> Column:
    """All adjacent pairs of the pattern; true for patterns of fewer than two bytes."""
    return contains_all([maybe_contains(words, exact, p, bits) for p in dict.fromkeys(pattern_pairs(pattern))])


def false_positive_rate(words: Column, bits: int) -> Column:
    fill = F.aggregate(words, F.lit(0), lambda a, w: a + F.bit_count(w)) / F.lit(float(bits))
    return fill * fill * fill
