"""Fill-in-middle against plain Python cuts, exact round trips, odd rows."""

import hashlib
import random

import duckdb
import numpy as np
import pytest

from skimlode.llm import fim

SF = "/root/testdata/sf0.001"


def plain_way(doc_id, text, rate=90, spm=20, seed=1):
    t = text or ""
    h = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    draws = [int(h[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, z = sorted(d % (len(t) + 1) for d in draws[:2])
    if not t or any(s in t for s in ("<P>", "<S>", "<M>")) or draws[2] % 100 >= rate:
        return len(t), "plain", None, None, t
    if draws[3] % 100 < spm:
        return len(t), "spm", a, z - a, f"<S>{t[z:]}<P>{t[:a]}<M>{t[a:z]}"
    return len(t), "psm", a, z - a, f"<P>{t[:a]}<S>{t[z:]}<M>{t[a:z]}"


def odd_texts():
    rng = random.Random(5)
    alphabet = "ab \n<PSM>é漢字🙂👩‍👩‍👧é"
    some = ["".join(rng.choices(alphabet, k=rng.choice([0, 1, 2, 5, 50, 255, 256, 257, 700]))) for _ in range(300)]
    return [None, "", "a", "🙂", "x<P>y", "<", "<S", "<M>", "é" * 256, "漢" * 512, "a" * 1024, *some, "long 🙂 text " * 40_000]


@pytest.mark.parametrize("step", [8, 64, 256])
def test_checkpoints_find_every_code_point(step):
    text = "".join(random.Random(step).choices("aé漢🙂", k=1500))
    raw = text.encode()
    index = fim.Checkpoints(np.frombuffer(raw, np.uint8), step)
    starts = [len(text[:k].encode()) for k in range(len(text) + 1)]
    assert index.byte_of(np.arange(len(text) + 1)).tolist() == starts
    assert index.before(np.array(starts)).tolist() == list(range(len(text) + 1))
    nothing = fim.Checkpoints(np.empty(0, np.uint8), step)
    assert nothing.byte_of(np.array([0])).tolist() == [0] == nothing.before(np.array([0])).tolist()


def test_transform_is_as_cut_in_python_and_comes_back(spark):
    from pyspark.sql import functions as F

    texts = odd_texts()
    rows = [(k, t, "p") for k, t in enumerate(texts)] + [(None, "no id, 漢字", "p"), (7, "again", "p"), (7, "again", "p")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, form string").repartition(3)
    out = fim.transform(docs)
    assert out.columns == ["doc_id", "text", "n", "form", "prefix_chars", "middle_chars", "output"]
    got = out.withColumn("back", fim.restored(F.col("form"), F.col("output"))).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == plain_way(r.doc_id, r.text)
        assert r.back == (r.text or "")
    assert {r.form for r in got} == {"plain", "psm", "spm"}


def test_other_rates_and_names(spark):
    docs = spark.createDataFrame([(f"k{i}", f"text {i} é") for i in range(50)], "name string, Body string")
    got = fim.transform(docs, rate=100, suffix_first=100, seed=9, id_col="name", text_col="Body").collect()
    assert all((r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == plain_way(r.name, r.Body, 100, 100, 9) for r in got)
    assert fim.transform(docs.limit(0), id_col="name", text_col="Body").count() == 0


def test_bytes_that_are_no_utf8_stay_whole(spark):
    from pyspark.sql import functions as F

    docs = spark.range(200).select(F.col("id").alias("doc_id"), F.unhex(F.lit("8080ff61c3a9e6bc")).cast("string").alias("text"))
    out = fim.transform(docs).withColumn("back", fim.restored(F.col("form"), F.col("output")))
    assert out.where(F.hex("back") != "8080FF61C3A9E6BC").count() == 0


def test_query_is_as_its_sql_says(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{SF}/documents.parquet')")
    df = fim.op11_fill_in_middle(spark, SF)
    want = con.execute(fim.ORACLES["op11_fill_in_middle"]).fetchall()
    assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in df.collect())
