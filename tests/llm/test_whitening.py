"""op11 against a whole-matrix computation with exact integers."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from strata.llm import whitening


def brute(rows, d, components=8):
    """Whitened coordinates by the covariance's eigenvectors, sums and deviations in Python integers."""
    kept = [(i, [math.floor(1024 * c) + 100000 for c in v]) for i, v in rows if v and len(v) == d and all(c is not None and math.isfinite(c) for c in v)]
    n, s = len(kept), [sum(x[k] for _, x in kept) for k in range(d)]
    y = [[n * c - t for c, t in zip(x, s, strict=True)] for _, x in kept]
    m = np.array(y, float) / n
    e, v = np.linalg.eigh(m.T @ m / n)
    e, v = e[::-1], v[:, ::-1]
    k = min(components, d)
    return [i for i, _ in kept], n, [sum(c * c for c in r) for r in y], m @ v[:, :k] / np.sqrt(e[:k]), e[:k] / e.sum()


def test_against_brute_force(spark):
    rng = np.random.default_rng(3)
    d = 12
    base = rng.normal(size=(400, d)) @ np.diag(np.linspace(2, 0.3, d)) + 5
    rows = [(int(i), [float(np.float32(c)) for c in v]) for i, v in enumerate(base)]
    rows += rows[:20] + [(None, rows[0][1]), (900, None), (901, []), (902, [1.0] * (d - 1) + [None]), (903, [float("nan")] * d), (904, [float("inf")] + [0.0] * (d - 1)), (905, [1.0, 2.0])]
    df = spark.createDataFrame([(i, v, 1, "a", 2.0) for i, v in rows], "vec_id long, embedding array<float>, n long, x string, component double").repartition(7)
    got = whitening.whitened(df).collect()
    ids, n, deviation, white, explained = brute(rows, d)
    assert len(got) == len(ids) * 8 and {r["n"] for r in got} == {n}
    sign = {}
    want = {i: (q, w) for i, q, w in zip(ids, deviation, white, strict=True)}
    for r in got:
        q, w = want[r["vec_id"]]
        k = r["component"] - 1
        assert r["deviation"] == q
        if abs(w[k]) > 1e-3:
            assert sign.setdefault(k, np.sign(w[k] * r["whitened"])) == np.sign(w[k] * r["whitened"])
        assert abs(abs(r["whitened"]) - abs(w[k])) < 1e-8
        assert abs(r["explained"] - explained[k]) < 1e-10 and r["identity_error"] < 1e-10


def test_many_triangles_meet_in_rounds(spark, monkeypatch):
    monkeypatch.setattr(whitening, "GROUP_BYTES", 0)  # two triangles a group
    monkeypatch.setattr(whitening, "BLOCK_BYTES", 0)
    rng = np.random.default_rng(4)
    rows = [(int(i), [float(c) for c in v]) for i, v in enumerate(rng.normal(size=(150, 5)))]
    got = whitening.whitened(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(11), components=3)
    assert got.filter(F.abs("whitened") > 50).count() == 0 and got.agg(F.max("identity_error")).first()[0] < 1e-10


@pytest.mark.parametrize("vectors", [[[1.0, 2.0]], [[1.0, 2.0], [1.0, 2.0]], [[1.0, 2.0], [1.0, 3.0], [1.0, 4.0]]])
def test_without_variance(spark, vectors):
    got = whitening.whitened(spark.createDataFrame([(i, v) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>")).collect()
    assert len(got) == 2 * len(vectors)
    assert all(r["whitened"] == 0 and r["explained"] == 0 for r in got if r["component"] == 2) and {r["identity_error"] for r in got} == {1.0}


def test_empty(spark):
    assert whitening.whitened(spark.createDataFrame([(1, None)], "vec_id long, embedding array<float>")).count() == 0


def test_jacobi_keeps_small_values():
    rng = np.random.default_rng(5)
    q, _ = np.linalg.qr(rng.normal(size=(9, 9)))
    a = np.linalg.qr(rng.normal(size=(9, 9)))[0] @ np.diag(10.0 ** -np.arange(9)) @ q.T
    sigma, v = whitening.jacobi(a)
    assert np.allclose(sigma, 10.0 ** -np.arange(9), rtol=1e-6) and np.allclose(v.T @ v, np.eye(9), atol=1e-13)
