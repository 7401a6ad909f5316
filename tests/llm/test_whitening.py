"""Whitening against numpy on all rows at once; merges that lose nothing; odd rows."""

import math

import numpy as np

from skimlode.llm import whitening

SF = "/root/testdata/sf0.001"


def whole(vectors, components):
    """Brute force: covariance and eigenvectors of the distinct vectors of steps."""
    kept = [(k, [math.floor(256 * float(c)) for c in v]) for k, v in vectors if v and all(c is not None and math.isfinite(c) for c in v)]
    fit = np.array(sorted({tuple(x) for _, x in kept}), float)
    centred = fit - fit.mean(axis=0)
    e, v = np.linalg.eigh(centred.T @ centred / len(fit))
    e, v = e[::-1], v[:, ::-1].T
    sums = [sum(int(r[i]) for r in fit) for i in range(fit.shape[1])]
    white = {k: ((np.array(x) - fit.mean(axis=0)) @ v[:components].T) / np.sqrt(e[:components]) for k, x in kept}
    deviation = {k: sum((len(fit) * c - s) ** 2 for c, s in zip(x, sums)) for k, x in kept}
    return len(fit), white, deviation, e


def same(a, b):
    return np.allclose(np.abs(a), np.abs(b), rtol=1e-8, atol=1e-9)


def test_merges_keep_all_dimensions():
    rng = np.random.default_rng(1)
    x = rng.integers(-300, 300, (500, 12)) * np.array([1] * 6 + [40] * 6)
    states = [whitening.State.of(p) for p in np.split(x, [1, 3, 100, 101, 350])]
    while len(states) > 1:
        states = [a.merged(b) for a, b in zip(states[::2], states[1::2])] + states[len(states) // 2 * 2 :]
    got = states[0]
    assert got.n == 500 and got.sums == x.sum(axis=0).tolist()
    centred = x - x.mean(axis=0)
    assert np.allclose(got.vectors.T @ np.diag(got.values**2) @ got.vectors, centred.T @ centred, rtol=1e-10)
    assert got.vectors.shape == (12, 12)


def test_rows_are_as_by_brute_force(spark):
    rng = np.random.default_rng(2)
    rows = [(k, [float(c) for c in rng.normal(size=6) * [5, 3, 2, 1, 0.5, 0.1]], k) for k in range(400)]
    rows += [(1000 + k, rows[3][1], 0) for k in range(200)]  # copies count once in the fit
    rows += [(2000, None, 0), (2001, [], 0), (2002, [1.0, None, 0.0, 0.0, 0.0, 0.0], 0), (2003, [float("nan")] * 6, 0), (2004, [float("inf")] * 6, 0), (2005, [1.0, 2.0], 0), (None, [-0.0] * 6, 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, deviation long").repartition(7)
    model = whitening.fit(df)
    assert 0 <= model.identity_error < 1e-9
    got = whitening.transform(df, model).collect()
    n, white, deviation, e = whole([r[:2] for r in rows if r[0] != 2005], 4)
    assert n == model.n and np.allclose(model.eigenvalues, e[:4], rtol=1e-10) and math.isclose(model.total, e.sum(), rel_tol=1e-10)
    assert sorted(r.vec_id or -1 for r in got) == sorted((k or -1) for k in white)
    signs = np.sign(np.array(next(r.whitened for r in got if r.vec_id == 0)) * white[0])
    for r in got:
        assert np.allclose(np.array(r.whitened) * signs, white[r.vec_id], rtol=1e-8, atol=1e-9) and r.deviation == deviation[r.vec_id]
    assert same(whitening.fit(df, components=None).eigenvalues, e)


def test_vectors_without_variance_and_none_at_all(spark):
    schema = "vec_id long, embedding array<float>"
    flat = spark.createDataFrame([(k, [1.0, float(k % 3), 2.0]) for k in range(30)], schema)
    model = whitening.fit(flat)
    got = whitening.transform(flat, model).collect()
    assert all(len(r.whitened) == 3 and r.whitened[0] is not None and r.whitened[1:] == [None, None] for r in got)
    one = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], schema)
    model = whitening.fit(one)
    assert model.n == 1 and model.identity_error is None and [r.whitened for r in whitening.transform(one, model).collect()] == [[None, None]] * 2
    none = flat.limit(0)
    assert whitening.fit(none) is None and whitening.transform(none, None).count() == 0


def test_large_entries_have_exact_deviations_or_none():
    x = np.array([[1 << 40, 3], [-(1 << 40), 3], [0, 4]], np.int64)
    assert whitening._deviations(x, 3, [0, 10]) == [None, None, 4]
    x = np.array([[3_000_000_000, 0]], np.int64)
    assert whitening._deviations(x, 1, [0, 0]) == [9 * 10**18]


def test_query_gives_a_row_for_each_vector_and_component(spark, tmp_path):
    got = whitening.op12_whitening(spark, SF).collect()
    vectors = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    n, white, deviation, e = whole(vectors, 4)
    assert len(got) == 4 * len(white) and {r.n for r in got} == {n}
    by = {(r.vec_id, r.component): r for r in got}
    for k in white:
        assert same([by[k, c].whitened for c in range(1, 5)], white[k]) and by[k, 1].deviation == deviation[k]
    assert all(math.isclose(by[vectors[0][0], c].explained, e[c - 1] / e.sum(), rel_tol=1e-9) for c in range(1, 5)) and got[0].identity_error < 1e-9
    spark.createDataFrame([], "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    assert whitening.op12_whitening(spark, str(tmp_path)).collect() == []
