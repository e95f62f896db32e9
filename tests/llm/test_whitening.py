"""Whitening against numpy's eigenvectors, and its parts against numpy."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from loomgraph.llm.whitening import eigenpairs, inertia, intervals, whiten

SCHEMA = "vec_id long, embedding array<float>, n int, x int"


def brute(rows, components=16):
    """{(vec_id, component): (n, deviation, whitened up to sign, explained)}"""
    kept = [(i, [int(np.floor(64 * float(np.float32(c)))) + 1000000 for c in e]) for i, e in rows
            if e and all(c is not None and np.isfinite(c) for c in e)]
    fit = sorted({tuple(x) for _, x in kept})
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    m = np.array([[float(n * a - s) / n for a, s in zip(x, sums)] for x in fit])
    v = m.T @ m / n
    e, q = np.linalg.eigh(v)
    e, q = e[::-1][:components], q[:, ::-1][:, :components]
    out = []
    for i, x in kept:
        d = [n * a - s for a, s in zip(x, sums)]
        for k in range(len(e)):
            if e[k] > 1e-9 * e[0]:
                out.append((i, k + 1, n, sum(a * a for a in d), abs(float(np.dot(d, q[:, k]) / n / np.sqrt(e[k]))), e[k] / np.trace(v)))
    return out


def check(got, want):
    key = lambda r: (r[0] is not None, r[0] or 0, r[1], r[4])
    got = sorted(((r["vec_id"], r["component"], r["n"], r["deviation"], abs(r["whitened"]), r["explained"]) for r in got), key=key)
    want = sorted(want, key=key)
    assert [g[:4] for g in got] == [w[:4] for w in want]
    assert np.allclose([g[4:] for g in got], [w[4:] for w in want], rtol=1e-9, atol=1e-9)


def vectors(seed, n, d):
    rng = np.random.default_rng(seed)
    return (rng.standard_normal((n, d)) * np.linspace(3, 0.3, d) + 1).astype(np.float32)


def test_against_numpy(spark):
    rows = [(i, v.tolist()) for i, v in enumerate(vectors(1, 300, 24))]
    rows += [(i, rows[0][1]) for i in range(400, 500)]  # one very common vector
    rows += [(7, rows[3][1]), (None, rows[4][1]), (600, None), (601, []), (602, [None] * 24),
             (603, [float("nan")] + [0.0] * 23), (604, [float("-inf")] + [0.0] * 23)]
    df = spark.createDataFrame([(i, e, 1, 2) for i, e in rows], SCHEMA).repartition(5)
    got = whiten(df).collect()
    check(got, brute(rows))
    assert len({r["identity_error"] for r in got}) == 1 and got[0]["identity_error"] < 1e-10
    for k in range(1, 17):  # the sign is the same for all rows
        at = {r["vec_id"]: r["whitened"] for r in got if r["component"] == k}
        assert at[0] == at[400] == at[450]


def test_small_tables(spark):
    assert whiten(spark.createDataFrame([], SCHEMA)).collect() == []
    assert whiten(spark.createDataFrame([(1, [1.0, 2.0], 0, 0)] * 3, SCHEMA)).collect() == []
    two = [(1, [1.0, 2.0]), (2, [3.0, 2.0])]  # one direction has variance
    check(whiten(spark.createDataFrame([(i, e, 0, 0) for i, e in two], SCHEMA)).collect(), brute(two))
    with pytest.raises(ValueError):
        whiten(spark.createDataFrame([(1, [1.0], 0, 0), (2, [1.0, 2.0], 0, 0)], SCHEMA))


def test_inertia_and_intervals():
    rng = np.random.default_rng(3)
    q, _ = np.linalg.qr(rng.standard_normal((30, 30)))
    e = np.concatenate([[5.0] * 12, [4.9999999, 3, 3, 1e-3], np.zeros(14)])
    v = (q * e) @ q.T
    v = (v + v.T) / 2
    for s in (6, 4, 2, 0.01, 5e-4, -1):
        assert inertia(v - s * np.eye(30)) == (e > s).sum()
    assert inertia(np.array([[0.0, 1], [1, 0]])) == 1 and inertia(np.zeros((3, 3))) == 0
    found = intervals(v, 16)
    assert sum(c for *_, c in found) == 16 and all(lo < hi for lo, hi, _ in found)


def test_equal_eigenvalues(spark):
    """A cluster larger than an interval's share, and one cut by the limit."""
    rng = np.random.default_rng(5)
    q, _ = np.linalg.qr(rng.standard_normal((40, 40)))
    e = np.concatenate([[9.0], [5.0] * 11, [2.0] * 10, np.linspace(1, 0.1, 18)])
    v = (q * e) @ q.T
    v = (v + v.T) / 2
    values, axes = eigenpairs(spark, v, 16)
    assert np.allclose(values, e[:16], rtol=1e-12)
    assert np.allclose(axes.T @ axes, np.eye(16), atol=1e-11)
    assert np.allclose(v @ axes, axes * values, atol=1e-11)


@pytest.mark.parametrize("upper", [[150, 146], [148, 140, 103, 73, 71], [200, 104], [300, 150, 145, 72, 67]])
def test_many_vectors_make_a_narrow_spectrum(spark, upper):
    """Few eigenvalues far above a crowd: one that a wide interval's circle does not tell from its own."""
    e = np.concatenate([upper, np.linspace(65.7, 62.5, 64 - len(upper))])
    q, _ = np.linalg.qr(np.random.default_rng(11).standard_normal((64, 64)))
    v = (q * e) @ q.T
    v = (v + v.T) / 2
    values, axes = eigenpairs(spark, v, 16)
    assert np.allclose(values, e[:16], rtol=1e-12)
    assert np.allclose(axes.T @ axes, np.eye(16), atol=1e-11)
    assert np.allclose(v @ axes, axes * values, atol=1e-10)
