"""Whitening against numpy's eigensolver and plain integer arithmetic."""

import math

import numpy as np
import pytest

from tidewright.llm import linear, queries, whitening

FORM = "vec_id long, embedding array<double>"


def spectrum(values, seed=1):
    q, _ = np.linalg.qr(np.random.default_rng(seed).normal(size=(len(values), len(values))))
    v = q @ np.diag(np.array(values, float)) @ q.T
    return (v + v.T) / 2


SPECTRA = [
    [3.0], [2.0, 1.0], [4, 3, 2, 1, 0.5, 0.1], list(np.linspace(2, 1, 40)), [1e6, 10, 1, 1e-3] + [1e-5] * 20, [5] * 6 + [1] * 20,
    [1] * 12, [3, 2] + [0] * 20, list(1 + 1e-5 * np.arange(20)[::-1]), [2, 1.9999, 1.9998, 1.9997, 1.9996] + [1] * 9, [7, 7, 1, 1, 1, 0.2],
]


@pytest.mark.parametrize("values", SPECTRA)
def test_contours_find_the_largest_eigenpairs(values):
    v = spectrum(values)
    got, vectors = whitening.feast(v, 4)
    want = np.linalg.eigvalsh(v)[::-1]
    k = min(4, int((want > 1e-12 * want.sum()).sum()))
    assert len(got) == k and np.abs(got - want[:k]).max() <= 1e-13 * want[0]
    assert np.abs(v @ vectors - vectors * got).max() <= 1e-13 * want[0]
    assert np.abs(vectors.T @ vectors - np.eye(k)).max() <= 1e-13


def test_no_variance_no_component():
    assert whitening.feast(np.zeros((3, 3)), 4)[1].shape == (3, 0)


@pytest.mark.parametrize("n", [1, 2, 5, 30])
def test_linear_algebra(n):
    r = np.random.default_rng(n)
    a, b = r.normal(size=(n, n)), r.normal(size=(n, 3))
    z = a + 1j * r.normal(size=(n, n))
    assert np.allclose(linear.solve(a, b), np.linalg.solve(a, b)) and np.allclose(linear.solve(z, b), np.linalg.solve(z, b))
    s = a + a.T
    values, vectors = linear.symmetric(s)
    assert np.allclose(values, np.linalg.eigvalsh(s)[::-1]) and np.allclose(s @ vectors, vectors * values)
    for shift in (-3.0, -0.1, 0.0, 0.7, 4.0):
        assert linear.above(s, shift) == (values > shift).sum()
    assert linear.above(np.diag([1.0, 0.0, -1.0]), 0.0) == 1 and linear.above(np.zeros((2, 2)), 0.0) == 0
    assert linear.above(np.array([[0.0, 2.0], [2.0, 0.0]]), 0.0) == 1
    with pytest.raises(ZeroDivisionError):
        linear.solve(np.zeros((2, 2)), np.ones(2))


def brute(rows):
    """{row number: (vec_id, deviation)}, fit list, covariance."""
    kept = [(i, [math.floor(256.0 * c) for c in e]) for i, e in rows if e is not None and all(c is not None and math.isfinite(c) for c in e)]
    d = max(len(x) for _, x in kept)
    kept = [(i, x + [0] * (d - len(x))) for i, x in kept]
    fit = sorted(set(tuple(x) for _, x in kept))
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    centred = np.array(fit, float) - np.array(sums) / n
    return kept, n, sums, centred.T @ centred / n


def check(got, rows, tolerance=1e-9):
    kept, n, sums, v = brute(rows)
    values, vectors = (a[..., ::-1] for a in np.linalg.eigh(v))
    k = min(4, int((values > 1e-12 * values.sum()).sum()))
    assert len(got) == k * len(kept)
    want = sorted((i, sum((n * c - s) ** 2 for c, s in zip(x, sums)), *(abs((np.array(x) - np.array(sums) / n) @ vectors[:, j] / values[j] ** 0.5) for j in range(k))) for i, x in kept)
    seen = {}
    for r in got:
        assert r["n"] == n and r["explained"] == pytest.approx(values[r["component"] - 1] / values.sum(), rel=1e-9) and r["identity_error"] < 1e-9
        seen.setdefault((r["vec_id"], r["deviation"]), {}).setdefault(r["component"], []).append(r["whitened"])
    flat = sorted((i, dev, *(abs(c[j + 1][m]) for j in range(k))) for (i, dev), c in seen.items() for m in range(len(c[1])))
    assert [f[:2] for f in flat] == [w[:2] for w in want]
    assert np.abs(np.array([f[2:] for f in flat]) - np.array([w[2:] for w in want])).max() < tolerance


def test_rows_equal_plain_arithmetic(spark):
    r = np.random.default_rng(2)
    mix = r.normal(size=(6, 6)) * [3, 2, 1.5, 1, 0.5, 0.2]
    rows = [(i, (mix @ r.normal(size=6)).tolist()) for i in range(300)]
    rows += [(i, rows[7][1]) for i in range(1000, 1200)] + [(7, rows[7][1])]  # copies count once, each row has results
    rows += [(2000, None), (2001, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (2002, [float("nan")] * 6), (2003, [1.0, float("inf"), 0.0, 0.0, 0.0, 0.0]), (2004, [-1.0 / 512, -0.0]), (2005, [])]
    frame = spark.createDataFrame(rows, FORM).selectExpr("*", "1 AS n", "2 AS x", "'c' AS component").repartition(6)
    check(whitening.whiten(frame).collect(), rows)


def test_signs_agree_over_rows(spark):
    rows = [(i, [float(i), 2.0 * i, -1.0 * (i % 3)]) for i in range(40)]
    got = [r["whitened"] for r in whitening.whiten(spark.createDataFrame(rows, FORM).repartition(5)).where("component = 1").orderBy("vec_id").collect()]
    assert all(a < b for a, b in zip(got, got[1:])) or all(a > b for a, b in zip(got, got[1:]))


def test_odd_tables(spark):
    none = spark.createDataFrame([], FORM)
    assert whitening.whiten(none).count() == 0 and whitening.whiten(none).columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    assert whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], FORM)).count() == 0
    assert whitening.whiten(spark.createDataFrame([(1, []), (2, None)], FORM)).count() == 0
    two = whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0]), (None, [3.0, 2.0])], FORM)).collect()
    assert {(r["vec_id"], r["component"], r["deviation"], round(abs(r["whitened"]), 9)) for r in two} == {(1, 1, 512**2, 1.0), (None, 1, 512**2, 1.0)}
    huge = whitening.whiten(spark.createDataFrame([(1, [1e300, 0.0]), (2, [-1e300, 5.0]), (3, [0.0, 0.0])], FORM)).collect()
    assert {r["vec_id"]: r["deviation"] for r in huge}[1] is None and {r["n"] for r in huge} == {3}


def test_the_query_reads_every_row(spark):
    folder = "/root/testdata/sf0.001"
    rows = [(r["vec_id"], [float(c) for c in r["embedding"]]) for r in queries.table(spark, folder, "embeddings").collect()]
    check(queries.op11_feast_whitening(spark, folder).collect(), rows, 1e-7)
