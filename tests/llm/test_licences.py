"""License scans against a plain Python count of votes, SQL, and texts that were changed."""

import re
from collections import defaultdict

import duckdb
import pytest

from skimlode.llm import licences
from skimlode.llm.licences import GRAM, LEAST, SECTION, SLACK, TEMPLATES, Template

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain_way(text):
    w, base, labels, share = words(text), [], set(), 0.0
    base_labels = set()
    for t in TEMPLATES:
        own = words(t.text)
        grams = [tuple(own[i : i + GRAM]) for i in range(len(own) - GRAM + 1)]
        for lo in range(0, len(grams), SECTION):
            part, votes = grams[lo : lo + SECTION], defaultdict(set)
            for i in range(len(w) - GRAM + 1):
                for bit, g in enumerate(part):
                    if tuple(w[i : i + GRAM]) == g:
                        votes[i - bit].add(bit)
            for start in votes:
                near = len(set().union(*[votes.get(start + k, set()) for k in range(SLACK + 1)])) / len(part)
                share = max(share, near)
                if t.exact and len(votes[start]) == len(part):
                    base.append(start)
                    base_labels.add(t.label)
                    labels.add(t.label)
                elif not t.exact and near >= LEAST:
                    labels.add(t.label)
    return len(w), len(base), min(base, default=None), max(base, default=None), ",".join(sorted(base_labels)), ",".join(sorted(labels)), share


GPL = next(t.text for t in TEMPLATES if t.label == "gpl")
ISC = next(t.text for t in TEMPLATES if t.label == "isc")
MIT = next(t.text for t in TEMPLATES if t.label == "mit" and not t.exact)
TEXTS = [
    None, "", " \n", "mit", "under the MIT license", "Under the\nMIT-License; under the mit license", "under the mit licenses", "Apache License, Version 2.0", "CC BY-NC 4.0, cc by nc", "cc by", "ünder the mit license",
    "a " * 5 + GPL + " b" * 5, GPL.replace("redistribute it", "redistribute this fine thing here it"), GPL.replace("and/or ", ""), " ".join(GPL.split()[:12]), ISC * 3, ISC + " under the mit license " + GPL, MIT, MIT[:200], MIT[150:], "software " * 300, "in the " * 5000,
]


def test_scan_is_as_counted_in_python(spark):
    rows = [(k, t, "x") for k, t in enumerate(TEXTS)] + [(None, ISC, "y"), (4, TEXTS[4], "z"), (4, TEXTS[4], "z"), (4, "another text with the same id", "z"), (None, ISC, "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, section string").repartition(3)
    got = sorted(map(str, (tuple(r) for r in licences.scan(docs).collect())))
    assert got == sorted(str((k, *plain_way(t))) for k, t, _ in rows)


def test_changed_notices_are_found_and_clean_texts_are_not(spark):
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(TEXTS)], "doc_id long, text string")
    labels = {r.doc_id: r.labels for r in licences.scan(docs).collect()}
    assert labels[12] == labels[13] == "gpl" and labels[14] == "" and labels[15] == "isc" and labels[16] == "gpl,isc,mit" and labels[17] == "mit" and labels[20] == labels[21] == ""


def test_spans(spark):
    docs = spark.createDataFrame([("k", f"one two {ISC}. three {ISC} four under the mit license, under the mit license")], "name string, body string")
    got = sorted((r.start, r.end, r.label, r.share) for r in licences.spans(docs, id_col="name", text_col="body").collect())
    n = len(words(ISC))
    a, b = 2, 2 + n + 1
    assert got == [(a, a + n, "isc", 1.0), (b, b + n, "isc", 1.0), (b + n + 1, b + n + 5, "mit", 1.0), (b + n + 5, b + n + 9, "mit", 1.0)]


def test_no_rows_and_templates_that_cannot_be(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert licences.scan(empty).count() == 0 == licences.spans(empty).count()
    for bad in (Template("a", "two words"), Template("b", "word " * 100, exact=True)):
        with pytest.raises(ValueError):
            licences.scan(empty, (bad,))


def test_query_is_as_its_sql_says_and_without_python(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{SF}/documents.parquet')")
    df = licences.op13_license_scan(spark, SF)
    want = con.execute(licences.ORACLES["op13_license_scan"]).fetchall()
    assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in df.collect())
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and not re.search("Python|Arrow|Pandas", plan)
