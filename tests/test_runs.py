"""Run-length coding in pieces against one pass over the whole."""

import random

import pytest

from skimlode.sources import codec, runs


def _data():
    rng = random.Random(4)
    some = {f"r{k}": b"".join(bytes([rng.choice([0, 1, 65, 0xFD, 0xFE, 0xFF])]) * rng.choice([1, 1, 2, 3, 4, 5, 40, 300]) for _ in range(rng.randrange(1, 60))) for k in range(12)}
    return some | {"none": b"", "one": b"\xff", "zeros": b"\0" * 140_000, "edge": b"a" * 65_535 + b"b" * 65_536 + b"\xfe" * 65_537, "text": b"no runs in here " * 50, "ff": b"\xff\xff\xff\xff" * 30 + b"\xff\0\xff"}


def _joined(df):
    out: dict[str, list] = {}
    for r in df.collect():
        out.setdefault(r.file_id, []).append((r.piece, bytes(r.data)))
    return {k: b"".join(d for _, d in sorted(v)) for k, v in out.items()}


@pytest.mark.parametrize("size", [1, 2, 3, 7, 1000])
def test_pieces_are_coded_as_the_whole(spark, size):
    data = {k: v[:1500] if size < 1000 else v for k, v in _data().items()}
    rows = spark.createDataFrame(list(data.items()), "file_id string, data binary").repartition(3)
    coded = {k: codec.compress(v) for k, v in data.items()}
    assert _joined(runs.compress(runs.cut(rows, size))) == coded
    packed = spark.createDataFrame(list(coded.items()), "file_id string, data binary").repartition(3)
    assert _joined(runs.decompress(runs.cut(packed, size), 1 << 20)) == data


def test_codes_cut_off_and_too_many_bytes(spark):
    rows = lambda raw: runs.cut(spark.createDataFrame([("a", raw)], "file_id string, data binary"), 2)
    for raw, most in ((b"abc\xff\0\x09", 100), (b"\xff", 100), (b"\xff\0\x09x" * 3, 26)):
        with pytest.raises(Exception, match="TransportError|cut off|more than"):
            runs.decompress(rows(raw), most).collect()
    assert _joined(runs.decompress(rows(b"\xff\0\x09x" * 3), 27)) == {"a": b"x" * 27}
