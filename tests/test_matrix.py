import numpy as np
import pytest

from tessera.operators import matrix as M
from tessera.operators.array import CoordArray
from tessera.operators.deviance import dense_row_deviances, row_deviances
from tessera.operators.workflows import normalize, pca, top_rows
from tessera.sources.writer import from_numpy


@pytest.fixture(scope="module")
def a():
    r = np.random.default_rng(1)
    return r.poisson(1.0, (12, 7)).astype(float) * (r.random((12, 7)) < 0.6)


@pytest.fixture(scope="module")
def x(spark, a):
    return from_numpy(spark, a, ["r", "c"])


@pytest.fixture(scope="module")
def named(spark, a):
    rows = [(f"g{i:02d}", f"s{j}", float(a[i, j])) for i, j in np.argwhere(a != 0)]
    df = spark.createDataFrame(rows, "gene string, cell string, n double")
    return CoordArray.from_coo(df, "n", {"gene": [f"g{i:02d}" for i in range(12)], "cell": [f"s{j}" for j in range(7)]})


def check(m, want):
    np.testing.assert_allclose(m.to_numpy().reshape(np.shape(want)), want, atol=1e-10)


def test_products(x, named, a):
    y, z, b = np.arange(7.0), np.arange(12.0) - 3, np.arange(21.0).reshape(7, 3)
    for m in (x, named):
        check(m @ y, (a @ y)[:, None])
        check(z @ m, (z @ a)[None])
        check(m @ b, a @ b)
        check(b.T @ m.T, b.T @ a.T)
        check(M.crossprod(m), a.T @ a)
        check(M.tcrossprod(m), a @ a.T)
        check(M.crossprod(m, z), (z @ a)[:, None])
        check(M.crossprod(z, m), (z @ a)[None])
        check(M.tcrossprod(m, y), (a @ y)[:, None])
        check(M.crossprod(m, np.arange(24.0).reshape(12, 2)), a.T @ np.arange(24.0).reshape(12, 2))
        check(M.crossprod(np.arange(24.0).reshape(12, 2), m), np.arange(24.0).reshape(12, 2).T @ a)
        check(M.tcrossprod(m, np.arange(14.0).reshape(2, 7)), a @ np.arange(14.0).reshape(2, 7).T)
        check(m @ M.crossprod(m), a @ a.T @ a)
        for s in ("join", "blocked"):
            for side, want in (("row", a.T @ a), ("col", a @ a.T)):
                check(M.gram(m, side, s), want)
    assert [d.name for d in M.crossprod(named).dims] == ["cell_a", "cell_b"] and M.tcrossprod(named).dimnames[0][0] == "g00"
    assert (x @ y).dims[1].name == "__col__" and (z @ x).dims[0].name == "__row__"
    check(M.tcrossprod(np.arange(3.0), x.subset(slice(None), [0], drop=False)), np.outer(np.arange(3.0), a[:, 0]))
    check(x[:, [0, 2]] @ np.ones(2), a[:, [0, 2]].sum(1)[:, None])


def test_product_errors(x):
    for bad in (lambda: x @ np.ones(3), lambda: x @ np.ones((3, 3)), lambda: M.crossprod(x, np.ones(7)), lambda: x @ x):
        with pytest.raises(ValueError, match="non-conformable"):
            bad()
    with pytest.raises(ValueError):
        (x + 1) @ np.ones(7)
    with pytest.raises(ValueError, match="does not scale"):
        M.gram(x, "row", "join", limit=1)


@pytest.mark.parametrize("family", ["binomial", "poisson"])
def test_deviances(spark, named, a, family):
    got = {r[0]: r[1] for r in row_deviances(named, family).collect()}
    want = dense_row_deviances(a, family)
    n, g = a.sum(0), a.sum(1)
    with np.errstate(all="ignore"):
        if family == "binomial":
            p = (g / a.sum())[:, None]
            direct = 2 * (np.nan_to_num(a * np.log(a / (n * p))) + np.nan_to_num((n - a) * np.log((n - a) / (n * (1 - p))))).sum(1)
        else:
            sz = np.exp(np.log(n) - np.log(n).mean())
            direct = 2 * (np.nan_to_num(a * np.log(a / sz)).sum(1) - np.nan_to_num(g * np.log(g / sz.sum())))
    np.testing.assert_allclose(want, direct, atol=1e-9)
    np.testing.assert_allclose([got[f"g{i:02d}"] for i in range(12)], want, atol=1e-9)
    with pytest.raises(ValueError):
        row_deviances(named, "normal")
    zero = from_numpy(spark, np.zeros((3, 2)), ["r", "c"])
    assert [r[1] for r in row_deviances(zero, family).collect()] == [0, 0, 0]


def test_workflows(x, a):
    scaled = a / a.sum(0)
    best = sorted(np.argsort(-scaled.var(1, ddof=1), kind="stable")[:5])
    assert sorted(k - 1 for k in top_rows(x.sweep(1, x.col_sums(), "/"), 5)) == best
    n = np.log1p(scaled[best])
    n = n / n.std(1, ddof=1, keepdims=True)
    got = normalize(x, 5)
    check(got, n)
    sd, vectors = pca(got, 3)
    np.testing.assert_allclose(sd, np.sqrt(np.sort(np.linalg.eigvalsh(np.cov(n)))[::-1][:3]), atol=1e-9)
    assert vectors.shape == (5, 3)
