"""Exact dedup against grouping in Python; runs of many levels; odd rows."""

import hashlib
import re

import numpy as np
import pytest

from skimlode.llm import common, exactdedup

BIG = 1 << 62


def _expected(rows):
    groups = {}
    for i, (d, t) in enumerate(rows):
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t or ""), []).append((-len(t or ""), BIG if d is None else d, i))
    out = []
    for key, members in groups.items():
        keep = min(m[:2] for m in members)[1]
        out += [(rows[m[2]][0], None if keep == BIG else keep, len(members), hashlib.sha256(key.encode()).hexdigest()) for m in members]
    return sorted(out, key=str)


ROWS = [(1, "a b"), (2, "ab"), (3, "a\tb "), (4, None), (5, ""), (6, " \n"), (7, "é x"), (8, "éx"), (9, "x" * 200_000), (10, "x" * 200_000), (None, "ab"), (None, "only"), (2, "ab"), (11, "a b")]


def _got(df):
    return sorted(((r.doc_id, r.keep_id, r.group_size, bytes(r.digest).hex()) for r in df.collect()), key=str)


def test_groups_with_odd_rows(spark):
    docs = spark.createDataFrame([(*r, 5, b"d") for r in ROWS], "doc_id long, text string, _row int, digest binary").repartition(3)
    found = exactdedup.exact_groups(docs)
    assert _got(found) == _expected(ROWS)
    assert found.where("kept").count() == len({e[3] for e in _expected(ROWS)})
    assert exactdedup.exact_groups(docs.limit(0)).count() == 0


@pytest.mark.parametrize("parts", [1, 9, 70])
def test_many_levels_and_batches(spark, parts):
    """One level, two and three, with several batches in a run: digests keep their byte order all the way."""
    rows = [(i, f"text {i % 900}" + " " * (i % 7)) for i in range(3000)]
    held = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10")
    try:
        raw = spark.createDataFrame([(i, i, t) for i, t in rows], "_row long, doc_id long, text string").repartition(parts)
        keys = raw.mapInArrow(exactdedup.digests, "_row long, doc_id long, chars long, digest binary")
        got = exactdedup.classes(keys, len(rows)).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", held)
    want = {e[3]: (e[1], e[2]) for e in _expected(rows)}
    assert {bytes(r.digest).hex(): (r.keep_id, r.group_size) for r in got} == want and len(got) == len(want)


def test_merging_is_sorting():
    rng = np.random.default_rng(1)

    def part(n):
        x = np.zeros(n, exactdedup.ENTRY)
        d = rng.integers(0, 30, n)
        x["digest"] = np.stack([d // 7, d * 0, d % 3, d], axis=1)
        x["chars"], x["doc_id"], x["row"], x["rows"] = rng.integers(0, 3, n), rng.integers(0, 5, n), rng.permutation(n), 1
        return x

    for k in range(1, 9):
        parts = [part(int(rng.integers(1, 60))) for _ in range(k)]
        for i, p in enumerate(parts):
            p["row"] += 1000 * i
        assert exactdedup.merged([exactdedup.sorted_run([p]) for p in parts]).tobytes() == exactdedup.sorted_run(parts).tobytes()


def test_dedup_keeps_columns_of_any_name(spark):
    docs = spark.createDataFrame([(*r, i, "mine") for i, r in enumerate(ROWS)], "doc_id long, text string, _row_of_dedup int, _ROW_OF_DEDUP_ string").repartition(2)
    kept = exactdedup.dedup(docs)
    assert kept.columns == docs.columns
    out = {r["_row_of_dedup"]: r for r in kept.collect()}
    assert len(out) == len({e[3] for e in _expected(ROWS)})
    assert all((out[i].doc_id, out[i].text, out[i]["_ROW_OF_DEDUP_"]) == (*ROWS[i], "mine") for i in out)
    unique = docs.where("doc_id IS NOT NULL AND NOT (doc_id = 2 AND _row_of_dedup > 5)")
    assert {r.doc_id for r in exactdedup.dedup(unique).collect()} == {3, 6, 7, 9, 11}
    assert exactdedup.dedup(docs.limit(0)).count() == 0


def test_hot_keys_are_joined_too(spark, monkeypatch):
    """Keys with many rows by broadcast, the others by a shuffle; together all."""
    left = spark.createDataFrame([(i % 5 if i < 900 else i, i) for i in range(1000)], "k long, v long")
    right = left.groupBy("k").count()
    monkeypatch.setattr(common, "HOT_SHARE", 100)
    out = common.join_hot(left, right, "k", "count", 1000)
    assert sorted((r.k, r.v, r["count"]) for r in out.collect()) == sorted((i % 5 if i < 900 else i, i, 180 if i < 900 else 1) for i in range(1000))
