"""The similarity join against all pairs, with large buckets forced into chunks too."""

import random
import re

import pytest

from skimlode.llm import jaccard

SF = "/root/testdata/sf0.001"


def _set(text):
    fold = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", fold) if x]
    return {tuple(w[i : i + 4]) for i in range(max(1, len(w) - 3))} if w else set()


def _expected(rows):
    sets = [_set(t) for _, t in rows]
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * (k := len(sets[i] & sets[j])) >= 85 * (len(sets[i]) + len(sets[j]) - k):
                up[root(i)] = root(j)
    big = 1 << 62
    least = {}
    for i, (d, _) in enumerate(rows):
        least[root(i)] = min(least.get(root(i), big), big if d is None else d)
    return sorted(((d, len(s), None if least[root(i)] == big else least[root(i)]) for i, ((d, _), s) in enumerate(zip(rows, sets))), key=str)


def _got(df):
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in df.collect()), key=str)


def _rows(seed):
    rng = random.Random(seed)
    rows, vocabulary = [], [f"w{i}" for i in range(400)]
    for _ in range(6):
        base = rng.choices(vocabulary, k=rng.choice([3, 8, 30, 120]))
        for _ in range(rng.choice([1, 3, 40])):
            words = list(base)
            for _ in range(rng.randrange(4)):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            rows.append(" ".join(words))
    rows += [None, "", " \t", "A b", "a  B", "a b c d", "a b c d", "x" * 9000]
    rng.shuffle(rows)
    out = [(i, t) for i, t in enumerate(rows)]
    return out + [(None, rows[0]), (None, "only null"), (3, rows[3]), (3, "another text of the same id")]


@pytest.mark.parametrize("few, chunk, hot", [(32, 512, 200_000), (1, 3, 200_000), (2, 2, 5)])
def test_components_against_all_pairs(spark, monkeypatch, few, chunk, hot):
    import types

    def forced(f):  # what tests set reaches workers by value
        values = f.__globals__ | {"FEW": few, "CHUNK_CLASSES": chunk, "HOT": hot, "RUN_ENTRIES": 40, "BLOCK_SHINGLES": 300}
        return types.FunctionType(f.__code__, values, f.__name__, f.__defaults__, f.__closure__)

    of_group, of_map = jaccard.common.releasing_group, jaccard.common.releasing
    monkeypatch.setattr(jaccard.common, "releasing_group", lambda f: of_group(forced(f)))
    monkeypatch.setattr(jaccard.common, "releasing", lambda f: of_map(forced(f)) if f.__module__ == jaccard.__name__ else of_map(f))
    monkeypatch.setattr(jaccard, "CHUNK_CLASSES", chunk)
    rows = _rows(few)
    docs = spark.createDataFrame([(*r, 1.0) for r in rows], "doc_id long, text string, size double").repartition(3)
    assert _got(jaccard.similar(docs)) == _expected(rows)


def test_query_against_all_pairs(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    assert _got(jaccard.op8_jaccard_join(spark, SF)) == _expected(rows)


def test_dedup_keeps_one_row_of_each(spark):
    rows = _rows(9)
    docs = spark.createDataFrame([(*r, "z") for r in rows], "doc_id long, text string, cls string")
    kept = jaccard.dedup(docs)
    assert kept.columns == docs.columns
    want = {}
    for (d, _, c), n in zip(_expected(rows), range(10**6)):
        want.setdefault((c, n if c is None else 0), 0)
    groups = {r for r in want if r[0] is not None}
    out = kept.collect()
    assert {r.doc_id for r in out} >= {c for c, _ in groups} and len(out) <= len(groups) + 5
    assert jaccard.dedup(docs.limit(0)).count() == 0
