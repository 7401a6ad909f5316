"""Sizes, filters, codec, maintenance and watching."""

import random
import struct
import zlib

import pytest
from pyspark.sql import functions as F

from skimlode import config as c
from skimlode.functions import blooms
from skimlode.functions.hashing import line_positions, pair_hash, positions
from skimlode.operators import maintain, summary
from skimlode.operators.fileindex import file_index
from skimlode.operators.filters import ByteFilter, NgramFilter
from skimlode.operators.segment import from_blocks, segment
from skimlode.sources import codec
from skimlode.streaming import watch

SMALL, EXACT = c.IndexConfig(256, 512), c.IndexConfig(256, 4096)


def test_sizes():
    assert (c.bloom_size(1), c.bloom_size(65), c.bloom_size(2049)) == (64, 128, 4096) and c.keeps_exact(2049)
    assert c.line_count(2049) == (8, False) and c.line_count(4096) == (8, True) and c.compact_size(256) == 4096
    for bad in (0, 1, float("nan"), float("inf"), -0.1):
        with pytest.raises(c.InvalidFpr):
            c.size_for_rate(bad, 10)
    with pytest.raises(c.ZeroBloomBits):
        c.bloom_size(0)
    with pytest.raises(c.BloomBitsTooLarge):
        c.bloom_size((1 << 30) + 1)
    for size in (255, 300, 0):
        with pytest.raises(c.InvalidBlockSize):
            c.IndexConfig(size).validate()
    assert pair_hash(0) == (0, 1) and len(positions(5, 64)) == 3
    with pytest.raises(c.EmptyBloomUnion):
        blooms.union_words([])
    with pytest.raises(c.IncompatibleIndexConfiguration):
        blooms.union_words([None, None], [64, 128])
    for bits, words, error in ((0, 1, c.ZeroBloomBits), (96, 2, c.InvalidBlockSize), (128, 1, c.TruncatedBlock)):
        with pytest.raises(error):
            codec.bloom_from_parts(bits, codec.np.zeros(words, "<u8"))
    assert len(codec.bloom_from_parts(128, codec.np.zeros(2, "<u8"))) == 2


def test_filters():
    assert ByteFilter.from_patterns([b"aab", b""]).requirements == ((97, 98),)
    assert ByteFilter.from_single_pattern(b"").requirements == ((),) and ByteFilter.from_patterns([b"ab", b"bc"]).required_count == 3
    n = NgramFilter.from_patterns([b"abab", b"x", b""])
    assert n.requirements == ((0x6162, 0x6261), ()) and n.max_pattern_bytes == 4


def test_every_pair_is_found_in_blooms(spark):
    data = bytes(random.Random(1).choices(range(256), k=3000))
    blocks = segment(spark.createDataFrame([(1, data)], "file_id int, data binary"), 256)
    words = summary.block_words(blocks, 1024)
    probes = [p for p in set(blooms.pattern_pairs(data[:256]))]
    assert words.where("block_id = 0").select(blooms.contains_all([blooms.bloom_has(F.col("words"), p, 1024) for p in probes[:100]])).first()[0]
    got = {r.block_id: [x & (1 << 64) - 1 for x in r.words] for r in words.collect()}
    d = codec.decode(codec.encode(data, c.IndexConfig(256, 1024)))
    assert all(got[k] == w.tolist() for k, w in enumerate(d.words)) and len(got) == 12


def test_blocks_from_rows_check_their_size(spark):
    rows = spark.createDataFrame([(1, 0, b"a" * 256), (1, 1, b"b" * 256)], "file_id int, block_id long, own binary")
    assert [bytes(r.ext[:2]) for r in from_blocks(rows, 256).orderBy("block_id").collect()] == [b"aa", b"ab"]
    with pytest.raises(Exception, match="UnalignedData"):
        from_blocks(rows.withColumn("own", F.substring("own", 1, 9)), 256).collect()


def test_codec():
    rng = random.Random(2)
    for size in (0, 1, 255, 256, 257, 1500):
        data = bytes(rng.choices(range(256), k=size))
        raw = codec.encode(data, EXACT)
        d = codec.decode(raw)
        assert (d.block_size, d.total_len, len(d.words)) == (256, size, -(-size // 256)) and all(e is not None for e in d.exact)
        for kind in (True, False):
            assert codec.from_transport(codec.to_transport(raw, kind)) == raw
    raw = codec.encode(b"secret" * 90, SMALL)
    seal = lambda body: body + struct.pack("<I", zlib.crc32(body))
    for bad, error in ((raw[:31], c.TruncatedHeader), (b"X" + raw[1:], c.InvalidMagic), (raw[:4] + b"\x09" + raw[5:], c.UnsupportedVersion), (raw[:40] + b"\x09" + raw[41:], c.ChecksumMismatch), (seal(raw[:-104]), c.TruncatedBlock), (seal(raw[:8] + b"\7" + raw[9:-4]), c.InvalidBlockSize), (seal(raw[:24] + b"\xff" + raw[25:-4]), c.BlockCountOverflow)):
        with pytest.raises(error):
            codec.decode(bad)
    for bad in (b"", b"x" * 40, codec.to_transport(raw)[:-1] + b"\0"):
        with pytest.raises(c.TransportError):
            codec.from_transport(bad)
    for data in (b"\xff" * 70000 + b"\xfe" + b"aaa" + b"b" * 9, b"", b"\xff\xfe" * 9, b"z" * 65537):
        packed = codec.compress(data)
        assert codec.decompress(packed, len(data)) == data
        with pytest.raises(c.TransportError):
            codec.decompress(codec.compress(b"a" * 99), 98)


@pytest.mark.parametrize("config", [SMALL, EXACT])
def test_records_grow(config):
    data = bytes(random.Random(5).choices(range(256), k=1536))
    assert codec.append_record(codec.encode(data[:512], config), data[512:]) == codec.encode(data, config)
    ends_high = data[:511] + b"\xff"  # such a last byte isn't in the record
    assert codec.append_record(codec.encode(ends_high, config), data[512:], 0xFF) == codec.encode(ends_high + data[512:], config)
    for raw, more, error in ((codec.encode(data[:500], config), data[:256], c.TrailingPartialBlock), (codec.encode(data[:512], config), b"short", c.UnalignedData), (codec.encode(b"", config), data[:256], c.ZeroBloomBits)):
        with pytest.raises(error):
            codec.append_record(raw, more)


def test_blooms_of_batches_against_one_pair_at_a_time(spark):
    rng = random.Random(6)
    files = [(k, bytes(rng.choices(range(256), k=n))) for k, n in enumerate((0, 1, 2, 255, 257, 1000, 70_000))]
    blocks = segment(spark.createDataFrame(files, "file_id int, data binary").repartition(3), 256)
    got = {(r.file_id, r.block_id): r for r in summary.summarize(blocks, EXACT).collect()}
    lined = {(r.file_id, r.block_id): r.words for r in summary.blocked_words(blocks, 1024).collect()}
    united: dict = {}
    for k, data in files:
        for i in range(-(-len(data) // 256)):
            own, ext = data[256 * i : 256 * i + 256], data[max(0, 256 * i - 1) : 256 * i + 256]
            pairs = sorted({a << 8 | b for a, b in zip(ext[:-1], ext[1:])})
            bits = {p for q in pairs for p in positions(q, 4096)}
            united.setdefault(k, set()).update(p for q in pairs for p in positions(q, 1024))
            r = got[k, i]
            assert (r.bytes_present, r.pairs, {64 * w + b for w, x in enumerate(r.words) for b in range(64) if x >> b & 1}) == (sorted(set(own)), pairs, bits)
            spots = {512 * line + p for line, at in (line_positions(q, 2) for q in pairs) for p in at}
            assert {64 * w + b for w, x in enumerate(lined[k, i]) for b in range(64) if x >> b & 1} == spots
    assert len(got) == sum(-(-len(d) // 256) for _, d in files)
    found = {r.file_id: {64 * w + b for w, x in enumerate(r.words) for b in range(64) if x >> b & 1} for r in file_index(blocks, 1024).collect()}
    assert found == united
    with pytest.raises(c.EmptyBlockIndex):
        file_index(blocks.limit(0), 1024)


def test_a_stored_index_is_opened_and_checked(spark, tmp_path):
    files = spark.createDataFrame([(1, b"secret" * 100), (2, b"x")], "file_id int, data binary")
    built = maintain.build(files, SMALL)
    built.save(str(tmp_path / "i"))
    assert _state(maintain.BlockIndex.load(spark, str(tmp_path / "i"), SMALL)) == _state(built)
    for config, blocks in ((EXACT, built.blocks), (SMALL, built.blocks.drop("pairs"))):
        with pytest.raises(c.IncompatibleIndexConfiguration):
            maintain.BlockIndex.assemble(config, blocks, built.files)
    with pytest.raises(c.ZeroBloomBits):
        maintain.BlockIndex.assemble(SMALL, built.blocks.withColumn("words", F.array().cast("array<long>")), built.files)


def _state(index):
    return sorted(map(str, index.blocks.select("file_id", "block_id", "offset", "length", "bytes_present", "pairs", "words").collect())), sorted(map(str, index.files.select("file_id", "total_len", "n_blocks", "first_byte", "last_byte").collect()))


@pytest.mark.parametrize("config", [SMALL, EXACT])
def test_append_and_merge_equal_rebuild(spark, config):
    rng = random.Random(3)
    first = [(1, bytes(rng.choices(b"abc\xff", k=512))), (2, b"\xff" * 256), (3, b""), (4, b"only")]
    rest = [(1, bytes(rng.choices(b"xyz", k=300))), (2, b"ab"), (3, b"new"), (5, b"file")]
    df = lambda rows: spark.createDataFrame(rows, "file_id int, data binary")
    whole = dict(first)
    for k, d in rest:
        whole[k] = whole.get(k, b"") + d
    want = _state(maintain.build(df(list(whole.items())), config))
    a, b = maintain.build(df(first), config), maintain.build(df(rest), config)
    assert _state(maintain.append(a, df(rest))) == want and _state(maintain.merge(a, b, strict=False)) == want
    with pytest.raises(c.TrailingPartialBlock):
        maintain.append(a, df([(4, b"more")]))
    with pytest.raises(c.TrailingPartialBlock):
        maintain.merge(a, b)
    with pytest.raises(c.IncompatibleIndexConfiguration):
        maintain.merge(a, maintain.build(df(rest), c.IndexConfig(512, 512)))
    for ids, error in (([0], c.NonSuffixBlockRemoval), ([7], c.InvalidBlockId)):
        with pytest.raises(error):
            maintain.remove_blocks(a, 1, ids)
    assert maintain.remove_blocks(a, 1, [1, 1]).blocks.where("file_id = 1").count() == 1 and maintain.remove_blocks(a, 1, []) is a
    with pytest.raises(c.InvalidBlockId):
        summary.point(a.blocks, 1, 9)


def test_watch(spark, tmp_path):
    (tmp_path / "in" / "sub").mkdir(parents=True)
    (tmp_path / "in" / "a").write_bytes(b"a" * 5000)
    (tmp_path / "in" / "sub" / "b").write_bytes(b"b")
    before = watch.listing(spark, str(tmp_path / "in"))
    before = spark.createDataFrame(before.collect(), before.schema)
    (tmp_path / "in" / "c").write_bytes(b"c")
    (tmp_path / "in" / "a").write_bytes(b"edited")
    (tmp_path / "in" / "sub" / "b").unlink()
    after = watch.listing(spark, str(tmp_path / "in"))
    assert sorted((r.path.rpartition("/")[2], r.change) for r in watch.changes(before, after).collect()) == [("a", "edited"), ("b", "removed"), ("c", "added")]
    changed = watch.changes(before, after)
    come = watch.read_files(spark, changed.where("change <> 'removed'"))
    old = spark.createDataFrame([(r.path, b"a" * 5000 if r.path.endswith("a") else b"b") for r in before.collect()], "file_id string, data binary")
    index = watch.apply_changes(maintain.build(old, EXACT), changed, come)
    assert sorted((r.file_id.rpartition("/")[2], r.total_len) for r in index.files.collect()) == [("a", 6), ("c", 1)]
    assert sorted(r.file_id.rpartition("/")[2] for r in index.blocks.collect()) == ["a", "c"]
    with pytest.raises(c.DataTooLarge):
        watch.read_files(spark, changed.where("change <> 'removed'"), most=6)
    assert watch.read_files(spark, changed.limit(0)).count() == 0
    q = watch.index_stream(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "check"))
    q.awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2
