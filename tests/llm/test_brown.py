"""Brown model: exact counts, a true distribution, exchange that never lowers the likelihood, better than the base."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from skimlode.llm import brown

SF = "/root/testdata/sf0.01"


def _tokens(text):
    fold = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [w for w in re.split(r"[\x20\x09-\x0D]+", fold) if w] + [""]


def test_query_against_brute_force(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    out = {r.doc_id: r for r in brown.op1_brown_score(spark, SF).collect()}
    counts = Counter(t for r in rows if zlib.crc32(str(r.doc_id).encode()) % 7 != 2 for t in _tokens(r.text))
    n, v = sum(counts.values()), len(counts)
    gains = []
    for r in rows:
        tokens, got = _tokens(r.text), out[r.doc_id]
        assert (got.n_tokens, got.n_known, got.train_tokens) == (len(tokens), sum(t in counts for t in tokens), n)
        assert got.base_score == pytest.approx(sum(math.log10((counts[t] + 1) / (n + v + 1)) for t in tokens), rel=1e-9)
        assert got.held_out == (zlib.crc32(str(r.doc_id).encode()) % 7 == 2)
        if got.held_out:
            gains.append((got.score - got.base_score) / len(tokens))
    assert len(out) == len(rows) and np.mean(gains) > 0


def test_model_is_a_distribution_and_matches_direct_scoring(spark):
    texts = ["a b a c", "b b a", "c d e f g", None, "", "a b a c", "A\tB x" * 30]
    docs = spark.createDataFrame([(i, t, 0.5) for i, t in enumerate(texts)], "doc_id long, text string, score double").repartition(3)
    sizes = {"least_share": 10, "first": 2, "classes": 2}
    train = docs.where("doc_id < 6")
    from skimlode.llm.common import texts as as_bytes

    raw = train.select(as_bytes(train).alias("text"))
    counts = raw.mapInArrow(brown._counted, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
    m = brown.fit(raw, counts, **sizes)
    n = {bytes(r.word): r.n for r in counts.collect()}
    other = len(m.classes) - 1
    assert set(m.lexicon) == {b"", b"a", b"b", b"c"}

    def log_p(word, before):
        i, c = m.lexicon.get(word, other), m.classes[m.lexicon.get(before, other)]
        return m.log_next[c, m.classes[i]] + (m.log_word[i] if i < other else math.log10(n.get(word, 0) + 1) - m.rest)

    for before in (b"", b"a", b"zzz", b"c"):
        assert sum(10 ** log_p(w, before) for w in [*n, b"unseen"]) == pytest.approx(1)
    for r in brown.score(docs, F.col("doc_id") < 6, **sizes).collect():
        words = [w.encode() for w in _tokens(texts[r.doc_id])]
        assert r.score == pytest.approx(sum(log_p(w, b) for w, b in zip(words, [b"", *words])))


def test_exchange_raises_the_likelihood():
    rng = np.random.default_rng(0)
    kind = rng.integers(0, 3, 40)
    pairs = rng.poisson(np.where(kind[:, None] == (kind[None, :] + 1) % 3, 30, 1))

    def likelihood(of):
        table = np.zeros((5, 5))
        np.add.at(table, (of[:, None], of[None, :]), pairs)
        return brown._xlogx(table).sum() - brown._xlogx(table.sum(0)).sum() - brown._xlogx(table.sum(1)).sum()

    steps = [likelihood(brown.exchange(pairs, 3, s)) for s in range(6)]
    assert steps == sorted(steps) and steps[-1] > steps[0]
    found = brown.exchange(pairs, 3, 10)
    assert len({(kind[i], found[i]) for i in range(1, 39)}) == 3  # the three kinds, found exactly


def test_later_rounds_find_what_exchange_finds(spark):
    """Words of three kinds that follow each other: only four of them are exchanged, the others choose."""
    rng = np.random.default_rng(1)
    texts = [" ".join(f"{'xyz'[(i + s) % 3]}{rng.integers(12)}" for i in range(60)) for s in range(90)]
    raw = spark.createDataFrame([(bytearray(t.encode()),) for t in texts], "text binary").repartition(5)
    counts = raw.mapInArrow(brown._counted, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
    m = brown.fit(raw, counts, first=10, classes=3)
    assert len(m.lexicon) == 37 and len({(w[:1], m.classes[i]) for w, i in m.lexicon.items()}) == 4


@pytest.mark.parametrize("cells", [10, brown.DENSE + 1])
def test_tally(monkeypatch, cells):
    monkeypatch.setattr(brown, "HELD", 5)
    rng, tally, want = np.random.default_rng(2), brown._Tally(cells), Counter()
    for _ in range(9):
        code = rng.integers(0, 10, rng.integers(1, 30))
        tally.add(code)
        want.update(code.tolist())
    at, n = tally.counts()
    assert dict(zip(at.tolist(), n.tolist())) == dict(want) and at.tolist() == sorted(at.tolist())


def test_no_rows(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert brown.score(docs.limit(0), F.lit(True)).count() == 0
    r = brown.score(docs, F.lit(False)).first()
    assert (r.n_tokens, r.n_known, r.train_tokens) == (3, 0, 0)


@pytest.mark.parametrize("at, n", [([], []), ([0], [1]), ([0, 1, 300, 70_000], [1, 255, 256, 1 << 40]), (range(5000), [3] * 5000)])
def test_packed_counts(at, n):
    a, b = brown._unpack(brown._pack(np.array(at, np.int64), np.array(n, np.int64)))
    assert a.tolist() == list(at) and b.tolist() == list(n)


def test_words_out_of_the_lexicon_have_classes(spark, monkeypatch):
    """Three kinds of words that follow each other: those too rare for the lexicon are told apart all the same."""
    monkeypatch.setattr(brown, "LEAST_SHARE", 100)
    rng = np.random.default_rng(3)
    texts = [" ".join(f"{'xyz'[(i + s) % 3]}{rng.integers(3) if rng.random() < 0.6 else rng.integers(3, 200)}" for i in range(60)) for s in range(90)]
    texts += ["x0 y0 z150 never", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    sizes = {"first": 10, "classes": 3}
    ours = {r.doc_id: r for r in brown.score(docs, F.col("doc_id") < 90, **sizes).collect()}
    shared = {r.doc_id: r for r in brown.score(docs, F.col("doc_id") < 90, least_share=100, **sizes).collect()}
    counts = Counter(t for text in texts[:90] for t in _tokens(text))
    assert sum(c * 100 < sum(counts.values()) for c in counts.values()) > 400  # not in the lexicon
    for d, text in enumerate(texts):
        assert (ours[d].n_tokens, ours[d].n_known) == (len(_tokens(text)), sum(t in counts for t in _tokens(text)))
        assert ours[d].base_score == pytest.approx(shared[d].base_score)
    # what is left to guess is which word of its kind comes: a third of all
    size = {c: sum(n + 1 for t, n in counts.items() if t[:1] == c) for c in "xyz"}
    ideal = sum(math.log10((counts[w] + 1) / size[w[0]]) for t in texts[:90] for w in t.split())
    base, one, all_words = (sum(f(d) for d in range(90)) for f in (lambda d: ours[d].base_score, lambda d: shared[d].score, lambda d: ours[d].score))
    assert base < one < all_words and ideal - all_words < 0.2 * (ideal - one)


@pytest.mark.parametrize("rest", [0, 7])
def test_transitions_sum_to_one(rest):
    table = np.random.default_rng(5).integers(0, 9, (5, 5)).astype(float)
    size = np.array([30, 40, 20, 10, rest], float)
    table[:, -1] *= rest > 0
    log_next, log_size = brown._estimated(table, size, np.array([3, 4, 2, 1, 1.0]))
    assert (10**log_next).sum(axis=1) == pytest.approx(np.ones(5)) and 10**log_size == pytest.approx([33, 44, 22, 11, rest + 1])


def test_best_class_of_rare_words():
    """Against the likelihood itself, word by word."""
    rng = np.random.default_rng(4)
    table = rng.integers(0, 50, (6, 6)).astype(float)
    counts = 2 * rng.integers(1, 9, 40)
    near = np.concatenate([np.stack((rng.integers(0, 6, c // 2), 6 + rng.integers(0, 6, c // 2)), axis=1).ravel() for c in counts])
    got, at = brown._best(table, near, counts), 0

    def with_word(codes, c):
        out = table.copy()
        for a in codes:
            out[(a, c) if a < 6 else (c, a - 6)] += 1
        return brown._xlogx(out).sum()

    left, right = table.sum(axis=1), table.sum(axis=0)
    for c, g in zip(counts, got):
        own = near[at : at + c]
        at += c
        # cells gain one by one where a word's own class is its neighbour's too, which is not looked at
        gain = [sum(brown._xlogx(np.float64((table[a, x] if a < 6 else table[x, a - 6]) + m)) - brown._xlogx(np.float64(table[a, x] if a < 6 else table[x, a - 6])) for a, m in Counter(own.tolist()).items()) - sum(brown._xlogx(s[x] + c / 2) - brown._xlogx(s[x]) for s in (left, right)) for x in range(4)]
        assert g == np.argmax(gain)
