"""Records of many files at once: batches of bounded size, no shuffle of records, and the coding of runs in parts."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from skimlode import queries
from skimlode.config import IndexConfig, TransportError, TruncatedBlock
from skimlode.functions import vectors
from skimlode.sources import codec

CONFIG = IndexConfig(256, 4096)


def test_batches_of_records_are_bounded_by_bytes():
    sizes = [0, 3 << 20, 1, 20 << 20, *[1 << 20] * 40, 5]
    ids = pa.array(range(len(sizes)))
    found = list(codec._with_records([ids], (bytes(n) for n in sizes), ["file_id", "record"]))
    assert [x for b in found for x in b.column(0).to_pylist()] == list(range(len(sizes))) and [len(x.as_py()) for b in found for x in b.column(1)] == sizes
    assert len(found) > 5 and all(sum(len(x.as_py()) for x in b.column(1).slice(0, b.num_rows - 1)) < codec.BATCH_BYTES for b in found)


@pytest.mark.parametrize("transport", [False, True])
def test_decoded_blocks_are_those_of_the_data(spark, transport):
    rng = random.Random(7)
    data = [(k, rng.randbytes(n)) for k, n in enumerate([0, 1, 256, 257, 5000])] + [(9, bytes(rng.choices(b"ab\xff\xfe", k=256 * 2100 + 5))), (10, None)]
    rows = spark.createDataFrame(data, "file_id long, data binary").withColumn("more", F.length("data"))
    made = codec.encode_files(rows, CONFIG, transport, keep=["more"])
    assert all(r.more == (None if r.file_id == 10 else len(dict(data)[r.file_id])) for r in made.collect())
    got = {(r.file_id, r.block_id): r for r in codec.decode_files(made, transport).collect()}
    assert set(got) == {(k, i) for k, d in data for i in range(-(-len(d or b"") // 256))}
    for (k, i), r in got.items():
        d = dict(data)[k]
        own, ext = d[256 * i : 256 * i + 256], d[max(0, 256 * i - 1) : 256 * i + 256]
        assert (r.block_size, r.total_len, r.bytes_present, r.pairs, len(r.words)) == (256, len(d), sorted(set(own)), sorted({a << 8 | b for a, b in zip(ext, ext[1:])}), 64)


def test_records_grow_without_a_shuffle(spark):
    rng = random.Random(8)
    data = [(k, rng.randbytes(256 * k), rng.randbytes(256 * (k % 4)) or None) for k in range(1, 9)]
    rows = spark.createDataFrame(data, "file_id long, first binary, data binary")
    grown = codec.append_rows(codec.encode_files(rows, CONFIG, data_col="first", keep=["data"]))
    assert "Exchange" not in grown._jdf.queryExecution().executedPlan().toString()
    want = {k: codec.encode(a + (b or b""), CONFIG) for k, a, b in data}
    assert {r.file_id: bytes(r.record) for r in grown.collect()} == want
    joined = codec.append_files(codec.encode_files(rows, CONFIG, data_col="first"), rows)
    assert {r.file_id: bytes(r.record) for r in joined.collect()} == want


def _blocks(data, before):
    """Counts, words and pairs of each block, a byte at a time."""
    config, out = CONFIG, []
    for at in range(0, len(data), 256):
        own = data[at : at + 256]
        ahead = data[at - 1] if at else before
        pairs = {a << 8 | b for a, b in zip(([] if ahead is None else [ahead]) + list(own), own if ahead is not None else own[1:])}
        bits = {int(p) for x in pairs for p in vectors.positions(config.bits)[x]}
        counts = b"".join(own.count(bytes([k])).to_bytes(4, "little") for k in range(256))
        table = lambda found, n: sum(1 << k for k in found).to_bytes(n // 8, "little")
        out.append(counts + (config.bits | 1 << 63).to_bytes(8, "little") + (config.bits // 64).to_bytes(8, "little") + table(bits, config.bits) + codec.MARKER.to_bytes(8, "little") + table(pairs, 65_536))
    return b"".join(out)


def test_values_encoded_together_are_as_alone(monkeypatch):
    rng = random.Random(9)
    values = [rng.randbytes(n) for n in (0, 1, 300, 0, 256, 2, 2600, 512, 257, 0)] + [b"\0" * 700, b"\xff" * 256, b""]
    before = [rng.choice([None, 0, 255, 65]) for _ in values]
    want = [_blocks(v, b) for v, b in zip(values, before)]
    for cells in (1, 1 << 16, 1 << 20):
        monkeypatch.setattr(codec, "CELLS", cells)
        assert [b"".join(x) for x in codec._blocks_of(values, before, 256, CONFIG.bits, True)] == want
        assert list(codec.encode_each(values, CONFIG)) == [codec.encode(v, CONFIG) for v in values]
        whole = [v[: len(v) // 256 * 256] for v in values if len(v) > 511]
        assert list(codec.append_each([codec.encode(v[:256], CONFIG) for v in whole], [v[256:] for v in whole])) == [codec.encode(v, CONFIG) for v in whole]


def test_records_whose_blocks_differ():
    data = random.Random(10).randbytes(768)
    parts = [b"".join(codec.encoded_blocks(data[at : at + 256], 256, bits, bits >= 4096, data[at - 1] if at else None)) for at, bits in ((0, 64), (256, 4096), (512, 1024))]
    made = codec._closed(codec._head(256, 768, 3, data[-1]), parts)
    d = codec.decode(made)
    assert (d.n, d.bits, [len(w) for w in d.words], [x is not None for x in d.exact]) == (3, 64, [1, 64, 16], [False, True, False])
    assert all((d.histograms[k] == [data[256 * k : 256 * k + 256].count(bytes([b])) for b in range(256)]).all() for k in range(3))
    grown = codec.decode(codec.append_record(made, data[:256]))
    assert (grown.n, grown.total_len, [len(w) for w in grown.words]) == (4, 1024, [1, 64, 16, 1])
    bad = [codec.encode(data, CONFIG)[: codec.HEAD3]] + [bytearray(p) for p in (codec.encode(data, CONFIG)[codec.HEAD3 : -4],)]
    bad[1][2 * 9752 + 1552 : 2 * 9752 + 1553] = b"x"  # the last block's marker
    with pytest.raises(TruncatedBlock, match="block 2"):
        codec.decode(codec._closed(bad[0], bad[1:]))


def test_steps_in_one_task(spark):
    """Records that aren't alike go, and none of their bytes leave the task."""
    rng = random.Random(11)
    data = [(k, rng.randbytes(256 * k)) for k in range(1, 7)]
    rows = [(k, d, d[:256], d[256:] if k != 4 else rng.randbytes(len(d) - 256)) for k, d in data] + [(8, None, b"", None)]
    rows = spark.createDataFrame(rows, "file_id long, all binary, first binary, rest binary").withColumn("size", F.length("all").cast("decimal(12,2)"))
    steps = [codec.encoding(CONFIG, data="first", to="grown"), codec.appending("grown", "rest"), codec.encoding(CONFIG, data="all"), codec.matching("grown", "record")]
    found = codec.chained(rows, *steps, codec.decoding(keep=["file_id", "size"], lists=["pairs"]), select=["file_id", "size", "block_id", "total_len", "pairs"])
    assert str(found._jdf.queryExecution().executedPlan()).count("MapInArrow") == 1
    whole = {(r.file_id, r.block_id): r.pairs for r in codec.decode_files(codec.encode_files(rows, CONFIG, data_col="all")).collect() if r.file_id != 4}
    assert {(r.file_id, r.block_id): r.pairs for r in found.collect()} == whole and {(r.file_id, int(r.size), r.total_len) for r in found.collect()} == {(k, 256 * k, 256 * k) for k, _ in data if k != 4}


def test_append_records_reads_once_and_keeps_records_in_their_tasks(spark):
    plan = str(queries.append_records(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan())
    assert (plan.count("MapInArrow"), plan.count("FileScan"), plan.count("Join"), plan.count("REPARTITION_BY_COL")) == (1, 1, 0, 1)


def test_runs_over_parts(monkeypatch):
    rng = random.Random(9)
    raw = b"".join(bytes([rng.choice([0, 65, 0xFE, 0xFF])]) * rng.choice([1, 2, 3, 4, 5, 65_535, 65_536, 65_538, 140_000]) for _ in range(40))
    whole, some = codec.compress(raw), raw[:300] + raw[-300:]
    assert codec.decompress(whole, len(raw)) == raw
    packed = codec.compress(some)
    for size in (1, 2, 7, 100):
        monkeypatch.setattr(codec, "PART_BYTES", size)
        assert codec.compress(some) == packed and codec.decompress(packed, len(some)) == some
    with pytest.raises(TransportError, match="stated size"):
        codec.decompress(b"\xff\0\x09x" * 3, 26)
    with pytest.raises(TransportError, match="cut off"):
        codec.decompress(b"ab\xff\0", 100)
