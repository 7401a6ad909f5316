"""The pipeline against a brute-force version of each stage, and with odd rows."""

import hashlib
import re

from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from skimlode.llm import common, wordbpe

SF = "/root/testdata/sf0.001"


def _words(text, pattern):
    fold = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    return re.findall(pattern, fold)


def _shingles(text):
    w = _words(text, r"[^\x20\x09-\x0D]+")
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def _brute(rows, items):
    rows = [r for r in rows if any(c.isalpha() for c in r[1] or "")]
    best = {}
    for r in rows:
        k = re.sub(r"[\x20\x09-\x0D]", "", r[1])
        if k not in best or (-len(r[1]), r[0]) < (-len(best[k][1]), best[k][0]):
            best[k] = r
    rows = sorted(best.values())
    sets, up = [_shingles(t) for _, t in rows], list(range(len(rows)))

    def root(i):
        return i if up[i] == i else root(up[i])

    for i in range(len(rows)):
        for j in range(i):
            if 100 * (k := len(sets[i] & sets[j])) >= 80 * (len(sets[i]) + len(sets[j]) - k) and sets[i]:
                up[max(root(i), root(j))] = min(root(i), root(j))
    rows = [r for i, r in enumerate(rows) if up[i] == i]
    pattern = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    windows = set()
    for t in items:
        w = _words(t, pattern)
        windows |= {tuple(w[i : i + 13]) for i in range(max(1, len(w) - 12))} if w else set()
    out = []
    for d, t in rows:
        w, hit = _words(t, pattern), set()
        for n in {len(x) for x in windows}:
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in windows:
                    hit |= set(range(i, i + n))
        if hit and 20 * len(hit) >= len(w):
            continue
        if hit:
            fold = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)
            spans = [m.span() for m in re.finditer(pattern, fold)]
            edges = [i for i in sorted(hit) if i - 1 not in hit]
            for a in reversed(edges):
                b = a
                while b + 1 in hit:
                    b += 1
                t = t[: spans[a][0]] + t[spans[b][1] :]
        out.append((d, t))
    return out


def test_run_against_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    library = Tokenizer.from_file(wordbpe.vocabulary("word_bpe_49k.json"))
    want = {d: library.encode(t, add_special_tokens=False).ids for d, t in _brute(rows, items)}
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, SF).collect()}
    assert set(got) == set(want)
    for d, ids in want.items():
        assert bytes(got[d].ids) == b"".join(i.to_bytes(4, "little") for i in ids) and got[d].n_tokens == len(ids)
        assert got[d].decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_stages_take_odd_rows(spark):
    text = "The quick brown fox jumps over the lazy dog again and again today. "
    rows = [(1, None, None, None, None), (2, "", "en", "a", 0), (None, text, None, None, 1), (3, text, "en", "a", 1), (3, text, "en", "a", 1), (4, text * 9, "en", "b", 2), (5, "123 !!", "en", "b", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for start in (docs, docs.limit(0)):
        frame = start
        for name, stage in corpus_pipeline.STAGES:
            frame = common.stored(stage(spark, frame, SF), name)
            if name != "encode":
                assert frame.columns == docs.columns
        assert frame.count() == (2 if start is docs else 0)


def test_rows_stay_when_no_language_is_learned(spark):
    text = "The quick brown fox jumps over the lazy dog again and again today. "
    rows = [(1, text, None), (2, "123 !!", None), (3, None, None), (4, "", None), (None, "日本", None), (5, "1 " * (1 << 19) + "a", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    out = corpus_pipeline.language(spark, docs, SF)
    assert out.columns == docs.columns
    assert sorted(str(r.doc_id) for r in out.collect()) == ["1", "5", "None"]


def test_texts_in_no_learned_language_go(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang")
    more = [(9001, "日本語の文章です" * 20, "ja"), (9002, "日本", None), (9003, "the and of to in " * 9, None), (9004, "the and of to in " * 9, "en")]
    rows = docs.unionByName(spark.createDataFrame(more, docs.schema)).selectExpr("*", "7.5 AS score", "'mine' AS LANG_PRED", "doc_id AS _keep")
    labelled = rows.withColumn("lang", F.expr("CASE WHEN lang <> 'ja' THEN lang END"))
    out = corpus_pipeline.language(spark, labelled, SF)
    assert out.columns == labelled.columns
    kept = {r.doc_id: r for r in out.collect()}
    assert {k for k in kept if k > 9000} == {9002, 9003, 9004}
    assert all((float(r.score), r.LANG_PRED, r["_keep"]) == (7.5, "mine", k) for k, r in kept.items())
    assert set(kept) - {x[0] for x in more} == {r.doc_id for r in docs.collect() if any(c.isalpha() for c in r.text or "")}


def test_stages_keep_columns_of_any_name(spark):
    text = "The quick brown fox jumps over the lazy dog again and again today. "
    names = ["_row_of_dedup", "_row_of_join", "_leak", "_text", "ids", "cls", "first", "_keep"]
    rows = [(i, text * i, "en", *[f"{n} {i}" for n in names]) for i in (1, 30)] + [(1, text, "en", *names)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, " + ", ".join(f"{n} string" for n in names))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        for start in (docs, docs.where("ids <> 'ids'")):
            out = stage(spark, start, SF)
            assert out.columns == docs.columns, name
            assert all(tuple(r) in rows for r in out.collect()), name
