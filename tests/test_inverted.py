"""The inverted index against the plans over blocks, at the seams of words and stretches; what a query reads."""

import random

import pytest

from skimlode.operators.filters import ByteFilter, NgramFilter
from skimlode.operators.segment import segment
from skimlode.plans import candidates as plan
from skimlode.plans import inverted


def _files(spark, seed):
    """Files of up to 400 blocks over few bytes, so that matches straddle blocks, words and stretches."""
    rng = random.Random(seed)
    rows = [(k, bytes(rng.choices(b"..........................................ab", k=rng.choice([0, 1, 255, 256, 257, 5000, 20_000, 60_000, 100_000])))) for k in range(14)]
    rows += [(50 + k, (b"abab" + b"." * 60) * k + b"bbaa" + b"." * 300) for k in range(12)]  # matches that end with their file
    rows += [(70 + k, b"." * (256 * k - 3) + b"aba") for k in (63, 64, 65, 127, 128)]  # words that files fill, or lack one block of
    rows.append((100, b"." * 256 * 63 + b"abc" + b"." * 256 * 5 + b"Q" + b"." * 256 * 70 + b"Z" + b"." * 999))
    return spark.createDataFrame([*rows, (101, None)], "file_id long, data binary")


def _same(spark, files, index, patterns, byte=True):
    b = ByteFilter.from_patterns(patterns) if byte else None
    n = NgramFilter.from_patterns(patterns)
    want = plan.candidate_blocks(segment(files, 256), 256, b, n)
    got = inverted.candidate_blocks(index, b, n)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.select(*got.columns).collect()))


@pytest.mark.parametrize("stretch", [4096, 64])
def test_candidates_are_those_of_the_blocks(spark, tmp_path, monkeypatch, stretch):
    monkeypatch.setattr(inverted, "BLOCKS_OF_STRETCH", stretch)
    files = _files(spark, stretch)
    inverted.InvertedIndex.build(files, 256).save(f"{tmp_path}/i")
    index = inverted.InvertedIndex.load(spark, f"{tmp_path}/i")
    wide = [b"ab" + b"." * 300 + b"ba", b"abba" * 300, b"abab....bbaa" * 50, (b"abab" + b"." * 96 + b"bbaa") * 180]  # up to 75 blocks
    for patterns in ([b"abab", b"bbb"], [b"abc"], [b"a", b""], *([w] for w in wide), [b"ab", wide[0]])[6 * (stretch == 64) :]:
        _same(spark, files, index, patterns)
    if stretch == 64:
        return
    _same(spark, files, index, [b"aab"], byte=False)
    one = ByteFilter.from_patterns([b"Q"])
    assert sorted(map(tuple, inverted.candidate_blocks(index, one).collect())) == sorted(map(tuple, plan.candidate_blocks(segment(files, 256), 256, one).collect()))
    two = [ByteFilter.from_patterns([b"Q", b"ab"]), NgramFilter.from_patterns([b"abab"])]  # not paired: two clauses
    assert sorted(map(tuple, inverted.candidate_blocks(index, *two).collect())) == sorted(map(tuple, plan.candidate_blocks(segment(files, 256), 256, *two).collect()))
    assert inverted.candidate_blocks(index, ByteFilter()).count() == 0


def test_few_of_the_stored_bytes_are_read(spark, tmp_path):
    rng = random.Random(1)
    texts = [(k, " ".join("".join(rng.choices("abcdefghijklmnopqrstuvwxyzABCDEFGH", k=6)) for _ in range(250)).encode()) for k in range(2500)]
    inverted.InvertedIndex.build(spark.createDataFrame(texts, "file_id long, data binary"), 256).save(f"{tmp_path}/i")
    index = inverted.InvertedIndex.load(spark, f"{tmp_path}/i")
    assert {"band"} <= set(index.postings.columns)
    stored = sum(p.stat().st_size for p in tmp_path.rglob("postings/**/*.parquet"))
    p = [b"Hqz"]
    found = inverted.candidate_blocks(index, ByteFilter.from_patterns(p), NgramFilter.from_patterns(p))
    plan_text = found._jdf.queryExecution().executedPlan().toString()
    assert ("PartitionFilters: [isnotnull(band" in plan_text or "PartitionFilters: [band" in plan_text) and "PushedFilters: [In(element" in plan_text and "ReadSchema: struct<file_id:bigint,chunk:bigint,element:int,mask:bigint>" in plan_text
    spark.sparkContext.setJobGroup("bytes", "bytes")
    index.rows_of([inverted.element_number(e) for e in plan.clauses(ByteFilter.from_patterns(p), NgramFilter.from_patterns(p))[0][0]]).collect()
    store = spark.sparkContext._jsc.sc().statusStore()
    jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("bytes")
    stages = {s for j in jobs for s in spark.sparkContext.statusTracker().getJobInfo(j).stageIds}
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    read = sum(store.lastStageAttempt(s).inputBytes() for s in stages)
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert 0 < read < 0.1 * stored, (read, stored)


def _masks(rows):
    """(file, chunk, element) -> signed mask, by a loop over blocks of 256 bytes."""
    want = {}
    for name, data in rows:
        for k in range(-(-len(data) // 256)):
            own, ext = data[256 * k : 256 * k + 256], data[max(0, 256 * k - 1) : 256 * k + 256]
            for e in {*own, *((a << 8 | b) + 256 for a, b in zip(ext, ext[1:]))}:
                want[name, k // 64, e] = want.get((name, k // 64, e), 0) | 1 << k % 64
    return {(f, c, e): m - (m >> 63 << 64) for (f, c, e), m in want.items()}


def _united(postings):
    got = {}
    for r in postings.collect():
        got[r.file_id, r.chunk, r.element] = got.get((r.file_id, r.chunk, r.element), 0) | r.mask
    return got


def test_few_rows_are_shuffled_and_sorted_to_store_postings(spark, tmp_path, monkeypatch):
    import pyarrow.parquet as pq

    monkeypatch.setattr(inverted, "PACKED_BYTES", 20_000)  # words that two lists share
    rng = random.Random(4)
    rows = [(f"f{k:03}", bytes(rng.choices(b"abcdefgh \xff", k=rng.choice([0, 1, 256, 300, 2000, 40_000])))) for k in range(60)]
    want = _masks(rows)
    built = inverted.InvertedIndex.build(spark.createDataFrame(rows, "file_id string, data binary"), 256)
    before = spark.conf.get(inverted._WRITERS)
    spark.sparkContext.setJobGroup("pack", "pack")
    built.save(f"{tmp_path}/i")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert spark.conf.get(inverted._WRITERS) == before
    tracker, store = spark.sparkContext.statusTracker(), spark.sparkContext._jsc.sc().statusStore()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    shuffled = sum(store.lastStageAttempt(s).shuffleWriteRecords() for s in {s for j in tracker.getJobIdsForGroup("pack") for s in tracker.getJobInfo(j).stageIds})
    index = inverted.InvertedIndex.load(spark, f"{tmp_path}/i")
    index.save(f"{tmp_path}/again")  # rows that were stored are lists of one
    for df in (built.postings, index.postings, inverted.InvertedIndex.load(spark, f"{tmp_path}/again").postings):
        got = {}
        found = df.collect()
        for r in found:
            assert r.band == r.element // inverted.BAND
            got[r.file_id, r.chunk, r.element] = got.get((r.file_id, r.chunk, r.element), 0) | r.mask
        assert got == want
    assert 0 < shuffled < 0.5 * len(found), (shuffled, len(found))
    for path in tmp_path.rglob("postings/**/*.parquet"):
        stored = pq.ParquetFile(path).read(["element"]).column(0).to_pylist()
        assert stored == sorted(stored)


def test_pieces_of_many_blocks_reach_python(spark, monkeypatch):
    rng = random.Random(6)
    rows = [(k, bytes(rng.choices(b"abcd \x00\xff", k=rng.choice([0, 1, 255, 256, 257, 511, 512, 513, 4096, 4097, 16_384, 16_385, 50_000])))) for k in range(40)]
    files, seen = spark.createDataFrame([*rows, (99, None)], "file_id long, data binary").coalesce(2), []
    monkeypatch.setattr(inverted, "segment", lambda rows, size, *columns: seen.append(size) or segment(rows, size, *columns))
    want = _masks(rows)
    for piece, packed in ((4096, 4 << 20), (1, 3000), (700, 3000), (1 << 20, 1)):
        monkeypatch.setattr(inverted, "PIECE_BYTES", piece)
        monkeypatch.setattr(inverted, "PACKED_BYTES", packed)
        assert _united(inverted.InvertedIndex.build(files, 256).postings) == want
    assert seen == [4096, 256, 512, 16_384]
