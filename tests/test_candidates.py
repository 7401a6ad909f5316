"""Candidate plans against a loop over blocks, and against true matches."""

import random

import numpy as np
import pytest

from skimlode.operators.filters import ByteFilter, NgramFilter
from skimlode.operators.ranges import merge_adjacent
from skimlode.operators.segment import segment
from skimlode.plans import candidates as plan

BLOCK = 256


def _loop(data, byte, ngram):
    """Marks blocks one after the other, as a single thread would."""
    n = -(-len(data) // BLOCK)
    has = []
    for i in range(n):
        own, ext = data[i * BLOCK : (i + 1) * BLOCK], data[max(0, i * BLOCK - 1) : (i + 1) * BLOCK]
        has.append({("byte", b) for b in own} | {("pair", a << 8 | b) for a, b in zip(ext[:-1], ext[1:])})
    wanted = plan.clauses(byte, ngram)
    full = lambda s: all(any(set(r) <= s for r in c) for c in wanted)
    every = {e for c in wanted for r in c for e in r}
    wide = min(plan.span(ngram.max_pattern_bytes, BLOCK), n) if ngram is not None else 2
    seen = [False] * n
    for i in range(n):
        if full(has[i]):
            seen[i] = True
        elif i and full(has[i - 1] | has[i]):
            seen[i - 1] = seen[i] = True
        elif ngram is not None:
            for start in range(max(0, i - (wide - 1)), i - 1):
                if full(set().union(*has[start : i + 1])):
                    seen[start : i + 1] = [True] * (i + 1 - start)
                    break
    for i in range(1, n):
        if seen[i] and not seen[i - 1] and has[i - 1] & every:
            seen[i - 1] = True
    return {i for i in range(n) if seen[i]}


def _files(seed, count):
    rng = random.Random(seed)
    out = []
    for k in range(count):
        data = bytearray(rng.choices(rng.choice([b"ab", b"abcdef", bytes(range(97, 123))]), k=rng.choice([0, 1, 255, 256, 257, 900, 2000])))
        for _ in range(rng.randrange(4)):
            p = rng.choice([b"QZ", b"Q" + b"a" * rng.choice([10, 300, 600]) + b"Z", b"XYZ", b"Q", b"Z"])
            at = rng.randrange(max(1, len(data)))
            data[at : at + len(p)] = p
        out.append((k, bytes(data)))
    return out


SETS = [[b"QZ"], [b"Q" + b"a" * 300 + b"Z"], [b"XYZ", b"Q" + b"a" * 600 + b"Z", b""], [b"Q"], [], [b"QZ", b"Z"]]


@pytest.mark.parametrize("patterns", SETS)
def test_plans_agree_with_the_loop(spark, patterns):
    files = _files(len(patterns), 60)
    blocks = segment(spark.createDataFrame(files, "file_id long, data binary"), BLOCK)
    byte, ngram = ByteFilter.from_patterns(patterns), NgramFilter.from_patterns(patterns)
    for b, n in ((byte, ngram), (byte, None), (None, ngram), (byte, NgramFilter.from_patterns([b"XY"]))):
        got = {(r.file_id, r.block_id) for r in plan.candidate_blocks(blocks, BLOCK, b, n).collect()}
        assert got == {(k, i) for k, d in files for i in _loop(d, b, n)}
    rows = spark.createDataFrame(list(enumerate(patterns)), "pattern_id int, pattern binary")
    for pattern_bytes in (plan.PATTERN_BYTES, 3):  # at once, and one after the other
        long = {(r.file_id, r.block_id) for r in plan.candidate_blocks_long(blocks, BLOCK, rows, pattern_bytes).collect()}
        assert long == {(k, i) for k, d in files for i in _loop(d, byte, ngram)}


@pytest.mark.parametrize("stretch", [1, 5])
def test_stretches_change_nothing(spark, monkeypatch, stretch):
    data = bytearray(random.Random(8).choices(b"ab", k=40_000))
    p = [b"QZ", b"Q" + b"a" * 600 + b"Z"]
    for at in range(200, 39_000, 1790):
        data[at : at + len(p[at % 2])] = p[at % 2]
    files = [(1, bytes(data)), (2, bytes(data[3000:9000]))]
    blocks = segment(spark.createDataFrame(files, "file_id long, data binary"), BLOCK)
    rows = spark.createDataFrame(list(enumerate(p)), "pattern_id int, pattern binary")
    byte, ngram = ByteFilter.from_patterns(p), NgramFilter.from_patterns(p)
    every = lambda: [{(r.file_id, r.block_id) for r in x.collect()} for x in (plan.candidate_blocks(blocks, BLOCK, byte, ngram), plan.candidate_blocks_long(blocks, BLOCK, rows), plan.strict_blocks(blocks, BLOCK, p))]
    whole = every()
    monkeypatch.setattr(plan, "STRETCH", stretch)
    assert every() == whole and whole[0] == whole[1] == {(k, i) for k, d in files for i in _loop(d, byte, ngram)}


@pytest.mark.parametrize("patterns", [s for s in SETS if any(s)])
def test_strict_covers_every_true_match(spark, patterns):
    files = [*_files(7, 80), (900, b"." * 250 + b"Q" + b"a" * 400 + b"Z" + b"." * 40 + b"Qa" + b"." * 330)]
    blocks = segment(spark.createDataFrame(files, "file_id long, data binary"), BLOCK)
    got = {(r.file_id, r.block_id) for r in plan.strict_blocks(blocks, BLOCK, [*patterns, b"Q" + b"a" * 400 + b"Z"]).collect()}
    for k, d in files:
        for p in filter(None, [*patterns, b"Q" + b"a" * 400 + b"Z"]):
            at = d.find(p)
            while at >= 0:
                assert {(k, i) for i in range(at // BLOCK, (at + len(p) - 1) // BLOCK + 1)} <= got
                at = d.find(p, at + 1)


def test_ranges_merge(spark):
    rows = spark.createDataFrame([(1, 0, 256), (1, 256, 256), (1, 1024, 256), (2, 0, 10), (2, 0, 10), (3, 0, 100), (3, 50, 100)], "file_id int, offset long, length long")
    assert sorted(map(tuple, merge_adjacent(rows).collect())) == [(1, 0, 512), (1, 1024, 256), (2, 0, 10), (3, 0, 100), (3, 50, 100)]


def test_shuffles(spark):
    """One of narrow rows, and one of what was found."""
    blocks = segment(spark.createDataFrame([(1, b"x" * 900)], "file_id long, data binary"), BLOCK)
    p = [b"ab", b"cd"]
    text = plan.candidate_ranges(blocks, BLOCK, ByteFilter.from_patterns(p), NgramFilter.from_patterns(p))._jdf.queryExecution().executedPlan().toString()
    assert text.count("Exchange hashpartitioning") == 2 and "Python" not in text


def test_unions_over_many_blocks_by_doubling():
    rng = np.random.default_rng(5)
    present = rng.random((7, 400)) < 0.02
    heads = np.sort(rng.choice(400, 9, replace=False))
    known = np.arange(400) - np.maximum.accumulate(np.where(np.isin(np.arange(400), [0, *heads]), np.arange(400), 0))
    for wide in (1, 2, 3, 5, 8, 65, 257):
        want = np.stack([present[:, max(k - known[k], k - wide + 1) : k + 1].any(axis=1) for k in range(400)], axis=1)
        assert (plan._united(present, known, wide) == want).all()


def test_a_pattern_of_many_blocks_takes_bounded_memory():
    """10 000 elements or so and 257 blocks: three tables at once, not one for each block."""
    import tracemalloc

    rng = np.random.default_rng(6)
    patterns = plan._Patterns([rng.integers(97, 190, 64 << 10, dtype=np.uint8).tobytes()])
    n = 257 + max(64, plan.CELLS // len(patterns.elements))
    present = rng.random((len(patterns.elements), n), dtype=np.float32) < 0.5
    tracemalloc.start()
    patterns.flags(present, np.arange(n), 257)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 8 * present.nbytes < 500 << 20
