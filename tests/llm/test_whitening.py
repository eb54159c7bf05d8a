"""Rank-one updates against dense eigenvalues, and whitening against a plain computation."""

from fractions import Fraction

import numpy as np
import pytest

from tidewire.llm import whitening as w

SCHEMA = "vec_id long, embedding array<float>, n long, part int, d double, component int"


def cases():
    r = np.random.default_rng(1)
    plain = r.normal(size=(150, 24))
    return {
        "plain": plain,
        "repeated": np.repeat(plain[:6], 20, axis=0),
        "few dimensions": r.normal(size=(150, 4)) @ r.normal(size=(4, 24)),
        "scales": plain * 10.0 ** r.uniform(-6, 3, size=24),
        "axes": np.eye(24)[r.integers(0, 24, 150)],
        "zeros": np.zeros((5, 24)),
    }


@pytest.mark.parametrize("name", cases())
def test_rank_one_updates(name):
    x = cases()[name]
    s = w.Spectrum(24)
    for z in x:
        s.add(z)
    full = x.T @ x
    scale = max(np.abs(full).max(), 1e-300)
    assert np.abs(s.q @ np.diag(s.d) @ s.q.T - full).max() < 1e-12 * scale
    assert np.abs(s.q.T @ s.q - np.eye(24)).max() < 1e-12
    half, other = w.Spectrum(24), w.Spectrum(24)
    half.add_rows(x[:70])
    other.add_rows(x[70:])
    half.merge(other)
    assert np.abs(half.q @ np.diag(half.d) @ half.q.T - full).max() < 1e-11 * scale


def test_secular_roots():
    d, u = np.array([0.0, 1e-9, 1.0, 1.0 + 1e-10, 5.0]), np.array([1.0, 1e-3, 0.5, 1e-4, 2.0])
    pole, x = w.secular_roots(d, u)
    roots = d[pole] + x
    assert (roots[:-1] >= d[:-1]).all() and (roots[:-1] <= d[1:]).all() and roots[-1] <= d[-1] + u @ u
    assert np.allclose(roots, np.linalg.eigvalsh(np.diag(d) + np.outer(u, u)), atol=1e-14, rtol=1e-13)
    for i in range(5):  # exact arithmetic: the function changes its sign right around each root
        f = lambda y, i=i: 1 + sum(Fraction(a) ** 2 / (Fraction(b) - Fraction(d[pole[i]]) - y) for a, b in zip(u, d, strict=True))
        near = Fraction(x[i])
        step = abs(near) * Fraction(1, 10**11)
        assert f(near - step) < 0 < f(near + step)


def brute(rows, k=8):
    """(vec_id, component) to deviation, absolute whitened value and share, with exact sums and numpy's eigenvectors."""
    fine = [(i, [float(c) for c in v]) for i, v, *_ in rows if v and all(c is not None and np.isfinite(c) for c in v)]
    x = np.array([[int(np.floor(1024 * c)) + 100_000 for c in v] for _, v in fine], object)
    n, s = len(x), x.sum(axis=0)
    y = n * x - s
    z = y.astype(float) / n
    values, axes = np.linalg.eigh(z.T @ z / n)
    values, axes = values[::-1], axes[:, ::-1]
    white = z @ axes
    out = []
    for r, (i, _) in enumerate(fine):
        for c in range(min(k, x.shape[1])):
            real = values[c] > 1e-13 * values[0] > 0
            out.append((i, c + 1, n, int((y[r] * y[r]).sum()), white[r, c] / np.sqrt(values[c]) if real else None, values[c] / values.sum() if values.sum() > 0 else None))
    return out


def check(df, rows):
    got = [(r.vec_id, r.component, r.n, r.deviation, r.whitened, r.explained) for r in df.collect()]
    want = brute(rows)
    signs = {}
    key = lambda r: (repr(r[0]), r[1], r[3], abs(r[4] or 0))
    assert len(got) == len(want)
    for g, e in zip(sorted(got, key=key), sorted(want, key=key), strict=True):
        assert g[:4] == e[:4]
        assert (g[4] is None) == (e[4] is None)
        if g[4] is not None and abs(e[4]) > 1e-6:
            sign = signs.setdefault(g[1], np.sign(g[4] * e[4]))
            assert g[4] * sign == pytest.approx(e[4], rel=1e-7, abs=1e-9)
        assert g[5] == pytest.approx(e[5], rel=1e-9, abs=1e-12)
    assert all(r.identity_error < 1e-9 for r in df.select("identity_error").distinct().collect())


def frame(spark, rows, parts=5):
    return spark.createDataFrame([(i, v, 7, 1, 0.5, 3) for i, v in rows], SCHEMA).repartition(parts)


def test_against_numpy(spark):
    r = np.random.default_rng(3)
    x = r.normal(size=(700, 12)) * np.linspace(3, 0.2, 12)
    rows = [(i, v.astype(np.float32).tolist()) for i, v in enumerate(x)]
    check(w.whiten(frame(spark, rows, 20)), rows)


def test_given_table(spark, small):
    df = spark.read.parquet(f"{small}/embeddings.parquet")
    check(w.whiten(df), [(r.vec_id, r.embedding) for r in df.collect()])


def test_odd_rows(spark):
    r = np.random.default_rng(5)
    rows = [(i, v.tolist()) for i, v in enumerate(r.normal(size=(40, 3)).astype(np.float32))]
    rows += [(3, rows[3][1]), (None, rows[4][1]), (50, None), (51, []), (52, [1.0, None, 2.0]), (53, [1.0, float("nan"), 2.0]), (54, [float("inf"), 0.0, 1.0])]
    check(w.whiten(frame(spark, rows)), rows)
    longer = [*rows, (60, [1.0, 2.0])]
    assert w.whiten(frame(spark, longer)).count() == w.whiten(frame(spark, rows)).count() == 42 * 3


def test_nothing_varies(spark):
    for rows in ([(1, [0.5, 0.25])], [(i, [0.5, 0.25]) for i in range(9)]):
        got = w.whiten(frame(spark, rows)).collect()
        assert len(got) == 2 * len(rows)
        assert {(r.deviation, r.whitened, r.explained, r.identity_error) for r in got} == {(0, None, None, 0.0)}
    flat = [(i, [float(i), 2.0 * i]) for i in range(20)]
    check(w.whiten(frame(spark, flat)), flat)


def test_empty(spark):
    df = w.whiten(spark.createDataFrame([], SCHEMA))
    assert df.collect() == [] and df.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    assert w.whiten(frame(spark, [(1, None), (2, [])])).collect() == []


def test_large_numbers_stay_exact():
    x = np.array([[2**52, -(2**52)], [2**52 - 1, 5]])
    sums = [int(v) for v in x.astype(object).sum(axis=0)]
    y = w.centred(x, 2, sums)
    assert w.deviations(y) == [sum((2 * int(a) - s) ** 2 for a, s in zip(row, sums, strict=True)) for row in x]
