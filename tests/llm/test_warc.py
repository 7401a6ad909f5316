"""WARC archives: round trips, pushdown, skipped payloads, foreign archives."""

import gzip

from skimlode.llm import common, warc

PAGES = [(3, "http://a/ b\r\nX: y", "same"), (1, "http://a/é", "same"), (2, None, None), (5, "u", ""), (None, "n", "same"), (7, "v", "é" * 300000), (8, "v", "alone\r\n\r\nWARC/1.1\r\n"), (9, "w", "twice"), (9, "w", "twice"), (9, "w", "other")]


def _written(spark, least=0):
    pages = spark.createDataFrame([(*p, "x") for p in PAGES], "page_id long, url string, html string, payload string")
    folder = common.new_folder(spark, "warc-test")
    warc.write(pages, folder, least)
    return folder


def test_round_trip(spark):
    rows = warc.read(spark, _written(spark)).collect()
    key = lambda r: (r.record_id or "", r.record_type, r.payload_digest)
    got = sorted([(r.record_id, r.record_type, r.payload_bytes, r.refers_to, r.payload_digest) for r in rows], key=lambda r: (r[0], r[1]))
    want = []
    for i, text in ((1, "same"), (2, ""), (7, "é" * 300000), (8, PAGES[6][2]), (9, "other"), (9, "twice")):
        want.append((f"urn:page:{i}", "response", len(text.encode()), None, warc.payload_digest(text.encode())))
    for i, text, first in (("3", "same", 1), ("", "same", 1), ("5", "", 2), ("9", "twice", 9)):
        want.append((f"urn:page:{i}", "revisit", len(text.encode()), f"urn:page:{first}", warc.payload_digest(text.encode())))
    assert sorted(got, key=str) == sorted(want, key=str) and key(rows[0])
    assert {bytes(r.payload).decode() for r in rows if r.record_type == "response"} == {p[2] or "" for p in PAGES}
    assert all(r.payload is None for r in rows if r.record_type == "revisit")


def test_threshold_and_empty_table(spark):
    rows = warc.read(spark, _written(spark, least=5)).where("record_type = 'revisit'").collect()
    assert [r.record_id for r in rows] == ["urn:page:9"]
    folder = common.new_folder(spark, "warc-none")
    warc.write(spark.createDataFrame([], "page_id long, url string, html string"), folder)
    assert warc.read(spark, folder).count() == 0


def test_predicates_are_pushed_and_payloads_skipped(spark, monkeypatch):
    folder = _written(spark)
    df = warc.read(spark, folder, ["record_id", "payload_bytes", "record_type"]).where("record_type = 'revisit' AND payload_bytes > 0")
    assert {r.record_id for r in df.collect()} == {"urn:page:3", "urn:page:", "urn:page:9"}
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Filter" not in plan.replace("RuntimeFilters", "")  # the source has taken all of them
    read = warc.WarcReader(df.schema, {"path": folder})
    for p in read.partitions():
        if p.value:
            with common.uri_open(p.value[0], "rb") as f:
                sizes = []
                inner = warc._Body.more
                monkeypatch.setattr(warc._Body, "more", lambda self, want: (out := inner(self, want), sizes.append(len(self.got)))[0])
                list(read.records(f, p.value[1], p.value[2]))
                assert max(sizes) < 100_000  # the payload of 600 kB is not inflated
                monkeypatch.undo()


def test_archives_of_others(spark, tmp_path):
    row = {"record_id": "urn:x:1", "record_type": "response", "target_uri": "http://h/", "date": None, "refers_to": None, "payload": b"p" * 9000}
    plain = warc.record(row) + warc.record(row | {"record_id": "urn:x:2", "payload": b""})
    (tmp_path / "a.warc").write_bytes(plain)
    (tmp_path / "b.warc.gz").write_bytes(gzip.compress(warc.record(row)) + gzip.compress(warc.record(row | {"record_id": "urn:x:3"})))
    for columns in (None, ["record_id", "payload_bytes"]):
        got = warc.read(spark, f"file://{tmp_path}", columns).collect()
        assert sorted((r.record_id, r.payload_bytes) for r in got) == [("urn:x:1", 9000), ("urn:x:1", 9000), ("urn:x:2", 0), ("urn:x:3", 9000)]


def test_writes_add_up_and_overwriting_replaces(spark):
    from pyspark.sql import functions as F

    folder = common.new_folder(spark, "warc-twice")
    page = lambda k, text: spark.createDataFrame([(k, "u", text)], "page_id long, url string, html string")
    ids = lambda: sorted(r.record_id for r in warc.read(spark, folder, ["record_id"]).collect())
    warc.write(page(1, "one"), folder)
    warc.write(page(2, "two").union(page(3, "two")), folder)
    assert ids() == ["urn:page:1", "urn:page:2", "urn:page:3"]
    bad = page(4, "four").withColumn("html", F.when(F.col("page_id") == 4, F.raise_error(F.lit("no"))).otherwise(F.col("html")))
    try:
        warc.write(bad, folder)
    except Exception as e:
        assert "no" in str(e)
    left = folder.removeprefix("file://") + "/part-" + "0" * 32 + ".warc.gz"  # as a lost attempt leaves it
    with open(left, "wb") as f:
        f.write(b"cut off")
    assert ids() == ["urn:page:1", "urn:page:2", "urn:page:3"]
    warc.write(page(5, "five"), folder, overwrite=True)
    assert ids() == ["urn:page:5"]
    warc.write(page(6, "six"), folder)
    assert ids() == ["urn:page:5", "urn:page:6"]


def test_archives_of_others_beside_own_ones(spark, tmp_path):
    row = {"record_id": "urn:x:1", "record_type": "response", "target_uri": "http://h/", "date": None, "refers_to": None, "payload": b"p"}
    (tmp_path / "a.warc").write_bytes(warc.record(row))
    warc.write(spark.createDataFrame([(1, "u", "t")], "page_id long, url string, html string"), f"file://{tmp_path}")
    assert sorted(r.record_id for r in warc.read(spark, f"file://{tmp_path}", ["record_id"]).collect()) == ["urn:page:1", "urn:x:1"]
