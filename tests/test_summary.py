"""Elements of blocks as rows, and bytes of long values, by bounded steps."""

import random
import tracemalloc

import numpy as np
import pyarrow as pa

from skimlode.functions import vectors
from skimlode.operators import summary
from skimlode.operators.segment import segment


def test_distinct_bytes_take_bounded_memory(monkeypatch):
    rng = random.Random(1)
    some = [b"", b"a", rng.randbytes(3000), b"ab" * 700, b"", rng.randbytes(50), b"x" * 5000, b""]
    for size in (1 << 8, 1 << 10, 1 << 20):
        monkeypatch.setattr(vectors, "STRETCH", size)
        assert vectors.distinct_bytes(pa.array(some * 3)).tolist() == [len(set(x)) for x in some] * 3
        assert vectors.distinct_bytes(pa.array([b"z", *some, b"y"])[1:-1]).tolist() == [len(set(x)) for x in some]
    large = pa.array([bytes(40 << 20), b"abc" * 1000])
    tracemalloc.start()
    assert vectors.distinct_bytes(large).tolist() == [1, 3] and tracemalloc.get_traced_memory()[1] < 64 << 20
    tracemalloc.stop()


def test_bits_are_those_of_the_flags():
    rng = random.Random(2)
    column = pa.array([b"", b"a", *(rng.randbytes(rng.randrange(300)) for _ in range(40)), b""])
    for table, bits in ((vectors.positions(1024), 1024), (vectors.line_positions(8), 4096), (vectors.positions(1 << 23), 1 << 23)):
        for (lo, hi, rows, at), (lo2, hi2, flags) in zip(vectors.bits_set(column, table, bits), vectors.flags(column, table, bits), strict=True):
            want = np.nonzero(flags)
            assert (lo, hi) == (lo2, hi2) and (rows == want[0]).all() and (at == want[1]).all()


def test_elements_leave_python_as_lists(spark):
    files = spark.createDataFrame([(1, b"abca" * 200), (2, None), (3, b"\xff")], "file_id long, data binary")
    blocks = segment(files, 256)
    for rows in (summary.histogram(blocks), summary.pairs(blocks), summary.bloom_bits(blocks, 1024), summary.blocked_bits(blocks, 4096)):
        plan = rows._jdf.queryExecution().executedPlan().toString()
        assert "Generate explode(some" in plan and "Exchange" not in plan
    assert {(r.file_id, r.block_id, r.byte): r.cnt for r in summary.histogram(blocks).collect()} == {(1, k, b): n for k, own in enumerate([b"abca" * 64] * 3 + [b"abca" * 8]) for b, n in ((x, own.count(x)) for x in b"abc")} | {(3, 0, 255): 1}
    assert summary.histogram(blocks).dtypes == [("file_id", "bigint"), ("block_id", "bigint"), ("byte", "int"), ("cnt", "bigint")]
