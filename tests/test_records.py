"""Records in files: bytes, checksums, ranges of blocks, and what is read of them."""

import random
import zlib

import pytest

from skimlode import config as c
from skimlode.config import IndexConfig
from skimlode.sources import codec, records

CONFIG = IndexConfig(256, 4096)


def _data(seed=1):
    rng = random.Random(seed)
    some = {f"f{k}": rng.randbytes(n) for k, n in enumerate([0, 1, 255, 256, 257, 5000, 30_000])}
    return some | {"ends in \xff/..": b"x" * 511 + b"\xff", "text": "é漢 plain words ".encode() * 300}


@pytest.fixture
def small_pieces(monkeypatch):
    monkeypatch.setattr(records, "PIECE_BYTES", 5 * records.stride(CONFIG))
    monkeypatch.setattr(records, "COMBINED", 3)


def _frame(spark, data):
    return spark.createDataFrame([*data.items(), ("none", None)], "file_id string, data binary").repartition(3)


def test_checksums_combine():
    rng = random.Random(2)
    for _ in range(50):
        a, b = rng.randbytes(rng.choice([0, 1, 7, 1000])), rng.randbytes(rng.choice([0, 1, 3, 4096, 70_000]))
        assert records.combined(zlib.crc32(a), zlib.crc32(b), len(b)) == zlib.crc32(a + b)


def test_pieces_are_the_bytes_of_the_record(spark, small_pieces):
    data = _data()
    found = records.pieces(_frame(spark, data), CONFIG).collect()
    for name, raw in [*data.items(), ("none", b"")]:
        own = sorted((r.piece, bytes(r.data), r.alone) for r in found if r.file_id == name)
        assert [p for p, _, _ in own] == list(range(len(own))) and b"".join(d for _, d, _ in own) == codec.encode(raw, CONFIG)
        assert len(own) == max(1, -(-len(raw) // (5 * 256))) and all(a == (len(own) == 1) for _, _, a in own)


def _written(spark, tmp_path, data):
    folder = f"file://{tmp_path}/r"
    assert records.write(_frame(spark, data), folder, CONFIG) >= len(data)
    return folder


def test_read_is_as_decoded(spark, tmp_path, small_pieces):
    data = _data()
    folder = _written(spark, tmp_path, data)
    whole = codec.decode_files(spark.createDataFrame([(k, codec.encode(v, CONFIG)) for k, v in data.items()], "file_id string, record binary"))
    got = records.read(spark, folder)
    key = lambda r: (r.file_id, r.block_id)
    want = {key(r): r.asDict() for r in whole.collect()}
    assert {key(r): r.asDict() for r in got.collect()} == want and got.count() == len(want)
    split = spark.read.format("blockrecords").schema("file_id string, block_id long").option("splitBytes", 20_000).load(folder)
    assert split.rdd.getNumPartitions() > 20 and sorted(map(key, split.collect())) == sorted(want)
    assert sorted(map(key, split.where("block_id > 3 AND block_id <= 6").collect())) == sorted(k for k in want if 3 < k[1] <= 6)
    one = records.read(spark, folder, ["file_id", "block_id", "pairs"]).where("file_id = 'f6' AND block_id IN (0, 77, 100000)")
    assert sorted((r.block_id, r.pairs) for r in one.collect()) == [(k, want["f6", k]["pairs"]) for k in (0, 77)]
    assert "Filter" not in one._jdf.queryExecution().executedPlan().toString().replace("RuntimeFilters", "")
    assert all(r.ok for r in records.verify(spark, folder, 1000).collect())


def test_a_point_reads_one_block(spark, tmp_path, monkeypatch):
    folder = _written(spark, tmp_path, {"large": random.Random(5).randbytes(400_000)})
    reader = records.RecordReader(records.read(spark, folder).schema, {"path": folder})
    from pyspark.sql.datasource import EqualTo, StringContains

    left = list(reader.pushFilters([EqualTo(("file_id",), "large"), EqualTo(("block_id",), 900), StringContains(("file_id",), "x")]))
    assert len(left) == 1
    sizes, inner = [], records._Parts.read
    monkeypatch.setattr(records._Parts, "read", lambda self, at, n: (out := inner(self, at, n), sizes.append(len(out)))[0])
    assert sum(b.num_rows for p in reader.partitions() for b in reader.read(p)) == 1 and sum(sizes) < 2 * records.stride(CONFIG)
    list(reader.pushFilters([EqualTo(("file_id",), "other")]))
    sizes.clear()
    assert not [b for p in reader.partitions() for b in reader.read(p)] and not sizes


def test_damaged_records(spark, tmp_path):
    good = codec.encode(b"some bytes" * 100, CONFIG)
    bad = {"magic": (b"XXXX" + good[4:], c.InvalidMagic), "short": (good[:20], c.TruncatedHeader), "version": (good[:4] + b"\x09" + good[5:], c.UnsupportedVersion), "size": (good[:8] + b"\x03" + good[9:], c.InvalidBlockSize), "cut": (good[:-9000], c.TruncatedBlock), "count": (good[:24] + b"\xff\xff" + good[26:], c.BlockCountOverflow)}
    for name, (raw, error) in bad.items():
        (tmp_path / f"{name}.fsbx").write_bytes(raw)
        with pytest.raises(error):
            records._Record([(str(tmp_path / f"{name}.fsbx"), len(raw))])
    folder = tmp_path / "sums"
    folder.mkdir()
    (folder / "good.fsbx").write_bytes(good)
    (folder / "changed.fsbx").write_bytes(good[:500] + bytes([good[500] ^ 1]) + good[501:])
    assert {r.file_id: r.ok for r in records.verify(spark, f"file://{folder}").collect()} == {"good": True, "changed": False}


def test_small_records_are_made_and_verified_without_a_shuffle(spark, tmp_path):
    data = {f"f{k}": random.Random(k).randbytes(200 * k) for k in range(30)}
    folder = _written(spark, tmp_path, data)
    checked = records.verify(spark, folder)
    assert "SortMergeJoin" not in checked._jdf.queryExecution().executedPlan().toString() and "hashpartitioning" not in checked._jdf.queryExecution().executedPlan().toString()
    assert {r.file_id for r in checked.collect() if r.ok} == {*data, "none"}
    for name, raw in data.items():
        assert (tmp_path / "r" / f"{name}.fsbx").read_bytes() == codec.encode(raw, CONFIG)
    old = codec.encode(b"old " * 100, CONFIG)
    (tmp_path / "r" / "old.fsbx").write_bytes(old[:4] + b"\x01" + old[5:32] + old[33:-4])
    assert {r.file_id: r.ok for r in records.verify(spark, folder).collect()}["old"] is None
