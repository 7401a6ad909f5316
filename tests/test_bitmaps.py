"""Exact tables as bitmaps: bits, unions, and what they take when stored."""

import random

from pyspark.sql import functions as F

from skimlode.config import IndexConfig
from skimlode.functions import bitmaps, blooms
from skimlode.operators.segment import segment
from skimlode.operators.summary import summarize


def _files(spark):
    rng = random.Random(3)
    some = [(k, rng.randbytes(rng.choice([0, 1, 2, 255, 256, 257, 3000]))) for k in range(20)]
    return spark.createDataFrame([*some, (50, b"plain text, and \xc3\xa9 once" * 40), (51, None), (52, bytes([0, 0, 255, 255, 128, 0, 127, 255]))], "file_id long, data binary")


def test_bits_are_the_pairs(spark):
    rows = segment(_files(spark), 256)
    want = {(r.file_id, r.block_id): set(blooms.pattern_pairs(bytes(r.ext))) for r in rows.collect()}
    probes = [0, 1, 255, 256, 32767, 32768, 65535, 0x7468, 0xC3A9, 0x807F]
    found = bitmaps.exact_tables(rows).select("*", bitmaps.pair_count().alias("n"), *[bitmaps.has_pair(p).alias(f"p{p}") for p in probes]).collect()
    assert len(found) == len(want)
    for r in found:
        pairs = want[r.file_id, r.block_id]
        assert (bytes(r.exact_low), bytes(r.exact_high)) == bitmaps.table_of(pairs) and r.n == len(pairs)
        assert [r[f"p{p}"] for p in probes] == [p in pairs for p in probes]


def test_unions_keep_exact_bits(spark):
    rows = segment(_files(spark), 256)
    want: dict[int, set] = {}
    for r in rows.collect():
        want.setdefault(r.file_id, set()).update(blooms.pattern_pairs(bytes(r.ext)))
    found = bitmaps.united(bitmaps.exact_tables(rows), "file_id").select("*", bitmaps.pair_count().alias("n"), bitmaps.has_pattern(b"text").alias("has")).collect()
    assert {r.file_id: r.n for r in found} == {k: len(v) for k, v in want.items()} and [r.file_id for r in found if r.has] == [50]
    for r in found:
        halves = bitmaps.table_of(want[r.file_id])
        assert (bytes(r.exact_low).rstrip(b"\0"), bytes(r.exact_high).rstrip(b"\0")) == halves
    every = bitmaps.united(bitmaps.exact_tables(rows)).select(bitmaps.pair_count().alias("n")).first()
    assert every.n == len(set().union(*want.values()))
    assert bitmaps.united(bitmaps.exact_tables(rows.where("false")), "file_id").count() == 0


def test_large_blocks_take_less_than_half(spark, tmp_path):
    """Blocks with many pairs, as those of the default size have."""
    rng = random.Random(4)
    rows = segment(spark.createDataFrame([(k, rng.randbytes(200_000)) for k in range(12)], "file_id long, data binary"), 1 << 16)
    bitmaps.exact_tables(rows).select("file_id", "block_id", *bitmaps.HALVES).write.parquet(f"{tmp_path}/bits")
    summarize(rows, IndexConfig(1 << 16, 4096)).select("file_id", "block_id", "pairs").write.parquet(f"{tmp_path}/lists")
    size = lambda name: sum(p.stat().st_size for p in (tmp_path / name).rglob("*.parquet"))
    assert size("bits") < size("lists") / 2
    back = spark.read.parquet(f"{tmp_path}/bits").select(F.sum(bitmaps.pair_count()).alias("n")).first().n
    assert back == spark.read.parquet(f"{tmp_path}/lists").select(F.sum(F.size("pairs")).alias("n")).first().n
