"""Blocks of a regular grid: streamed to the driver, applied on the executors, and row deviances by block."""

import numpy as np
import pandas as pd
import pytest

from tessera.operators.array import CoordArray
from tessera.operators.deviance import block_row_deviances, dense_row_deviances
from tessera.operators.realize import apply_blocks, blocks
from tessera.sources.writer import from_numpy


@pytest.fixture(scope="module")
def a():
    r = np.random.default_rng(1)
    return r.integers(1, 9, (11, 7, 5)) * (r.random((11, 7, 5)) < 0.2) * (np.arange(11) < 8)[:, None, None]


def test_streamed_blocks_come_in_order_and_whole(spark, a):
    x = from_numpy(spark, a, ["i", "j", "k"])
    for grid in ((4, 3, 5), (11, 7, 5), (1, 7, 2), (3, 2, 2)):
        corners, out = [], np.full(a.shape, -1)
        for corner, b in blocks(x + 1, grid):
            corners.append(corner)
            out[tuple(slice(c, c + n) for c, n in zip(corner, b.shape))] = b
        assert (out == a + 1).all() and corners == sorted(corners)
        sparse = list(blocks(x, grid, sparse=True))
        assert [c for c, _ in sparse] == corners
        back = np.zeros(a.shape, int)
        for corner, (at, values) in sparse:
            back[tuple((at + corner).T)] = values
        assert (back == a).all()


def test_blocks_cost_one_pass(spark, a):
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    cells = [(int(i), int(j), float(a[i, j].sum())) for i, j in np.argwhere(a.sum(axis=2))]
    df = spark.createDataFrame(cells, "i long, j long, v double").mapInArrow(counted, "i long, j long, v double")
    x = CoordArray.from_coo(df, "v", {"i": range(11), "j": range(7)})
    assert len(list(blocks(x, (2, 2)))) == 24 and seen.value == len(cells)


def test_other_values(spark):
    df = spark.createDataFrame([(0, 0, "x"), (2, 1, None)], "i long, j long, v string")
    s = CoordArray.from_coo(df, "v", {"i": range(3), "j": range(2)})
    assert [b.tolist() for _, b in blocks(s, (2, 2))] == [[["x", ""], ["", ""]], [["", None]]]
    n = CoordArray.from_coo(spark.createDataFrame([(0, 0, 1), (1, 0, None)], "i long, j long, v int"), "v", {"i": range(2), "j": range(2)})
    (_, b), = blocks(n, (2, 2))
    assert np.isnan(b[1, 0]) and b[0].tolist() == [1, 0]
    t = CoordArray.from_coo(spark.createDataFrame([(1, 1, True)], "i long, j long, v boolean"), "v", {"i": range(2), "j": range(2)})
    assert [b.tolist() for _, b in blocks(t, (1, 2))] == [[[False, False]], [[False, True]]]
    e = CoordArray.from_coo(df.where("false"), "v", {"i": range(3), "j": range(2)})
    assert len(list(blocks(e, (2, 1)))) == 4


def test_applied_blocks(spark, a):
    x = from_numpy(spark, a, ["i", "j", "k"])
    dense = lambda at, b: pd.DataFrame({"at": [list(at)], "n": [b.size], "s": [int(b.sum())]})
    got = {tuple(r.at): (r.n, r.s) for r in apply_blocks(x, (4, 4, 4), dense, "at array<long>, n long, s long").collect()}
    want = {(i, j, k): (a[i : i + 4, j : j + 4, k : k + 4].size, a[i : i + 4, j : j + 4, k : k + 4].sum()) for i in range(0, 11, 4) for j in range(0, 7, 4) for k in range(0, 5, 4)}
    assert got == want
    sparse = lambda at, b: pd.DataFrame({"n": [len(b[1])], "s": [int(b[1].sum())]})
    rows = apply_blocks(x, (4, 4, 4), sparse, "n long, s long", sparse=True, empty=False).collect()
    assert sum(r.n for r in rows) == (a > 0).sum() and sum(r.s for r in rows) == a.sum() and all(r.n for r in rows)


@pytest.mark.parametrize("family", ["binomial", "poisson"])
def test_deviances_by_blocks_in_both_dimensions(spark, family):
    r = np.random.default_rng(3)
    a = r.poisson(0.7, (23, 31)) * (r.random((23, 31)) < 0.6)
    a[4] = 0
    a[:, 9] = 0
    a[7] = 0
    a[7, 3] = 40
    want = dense_row_deviances(a, family)
    x = from_numpy(spark, a, ["r", "c"])
    for spacing in (None, 10, (5, 8), (23, 31), (1, 31)):
        for sparse in (True, False):
            rows = block_row_deviances(x, family, spacing, as_sparse=sparse).collect()
            got = np.zeros(23)
            for q in rows:
                got[q.r - 1] = q.value
            np.testing.assert_allclose(got, want, atol=1e-8)
            assert len(rows) == 23
    with pytest.raises(ValueError, match="takes more than"):
        block_row_deviances(x, family, (1000, 1000), as_sparse=False, block_bytes=1 << 20)
    with pytest.raises(ValueError, match="family"):
        block_row_deviances(x, "other")


def test_a_row_alone_has_all(spark):
    a = np.zeros((3, 4))
    a[1] = [1, 2, 0, 5]
    for family in ("binomial", "poisson"):
        got = {r.r: r.value for r in block_row_deviances(from_numpy(spark, a, ["r", "c"]), family, (2, 2)).collect()}
        np.testing.assert_allclose([got[i] for i in (1, 2, 3)], dense_row_deviances(a, family), atol=1e-9)


def test_deviances_of_long_rows_keep_to_the_budget(spark):
    """Five million rows: blocks are as tall as the budget allows, sums do not go through the driver."""
    df = spark.range(4000).selectExpr("id * 1250 + 1 AS r", "id % 7 + 1 AS c", "CAST(id % 3 + 1 AS double) AS v")
    x = CoordArray.from_coo(df, "v", {"r": range(1, 5_000_001), "c": range(1, 8)})
    from tessera.operators.deviance import row_deviances

    one = block_row_deviances(x, "poisson", block_bytes=1 << 20).where("value <> 0")
    two = row_deviances(x, "poisson").withColumnRenamed("value", "other").where("other <> 0")
    assert one.join(two, "r").where("abs(value - other) < 1e-9").count() == one.count() == two.count() > 3000


@pytest.mark.parametrize("sparse", [True, False])
def test_blocks_without_a_cell_cost_nothing(spark, sparse):
    """Two million rows by a million columns in blocks of 2 by 2: half a billion blocks, of which 600 have a cell."""
    df = spark.range(600).selectExpr("id * 3000 + 1 AS r", "id * 1500 + 1 AS c", "CAST(id % 3 + 1 AS double) AS v")
    x = CoordArray.from_coo(df, "v", {"r": range(1, 2_000_001), "c": range(1, 1_000_001)})
    from tessera.operators.deviance import row_deviances

    for family in ("binomial", "poisson"):
        one = block_row_deviances(x, family, (2, 2), as_sparse=sparse)
        two = row_deviances(x, family).withColumnRenamed("value", "other")
        assert one.join(two, "r").where("abs(value - other) < 1e-9 and (value <> 0 or r % 3000 <> 1 or r > 1800000)").count() == 2_000_000


def test_forms_and_totals_by_blocks_of_arrays_too_large_for_the_driver(spark, a):
    """A billion cells: no block is made for what holds nothing, and local forms in blocks equal whole ones."""
    from tessera.operators.realize import block_cells, block_totals

    m = a.sum(axis=2)
    x = from_numpy(spark, m, ["i", "j"])
    for form in ("coo", "csc", "dense"):
        got = np.zeros(m.shape)
        for r in block_cells(x, (4, 3), form).collect():
            got[r.p0, r.p1] += r.value
        assert (got == m).all()
    assert sorted(r.value for r in block_cells(x + 1, (4, 3), "dense").collect()) == sorted((m + 1).ravel())
    got = {(r.p0, r.p1): (r.cells, r.total) for r in block_totals(x + 1, (4, 3)).collect()}
    assert got == {(i, j): (b.size, b.sum() + b.size) for i in range(0, 11, 4) for j in range(0, 7, 3) for b in [m[i : i + 4, j : j + 3]]}
    df = spark.range(40).selectExpr("id * 1000 AS i", "id * 600 AS j", "CAST(id + 1 AS double) AS v")
    large = CoordArray.from_coo(df, "v", {"i": range(40_000), "j": range(25_000)})
    for form in ("coo", "csc", "dense"):
        assert block_cells(large, (500, 500), form).selectExpr("count(*)", "sum(value)").first()[:] == (40, 820)
    assert block_totals(large + 1, (20_000, 25_000)).selectExpr("count(*)", "sum(total)").first()[:] == (2, 1_000_000_820)
    with pytest.raises(ValueError, match="compressed"):
        block_cells(x + 1, (4, 3), "csc")


@pytest.mark.parametrize("cells", [1, 30, 1 << 20])
def test_dense_blocks_are_made_in_stacks(spark, monkeypatch, cells):
    """Stacks of one block, of some, of all; blocks at the edges are shorter, and one block has no stored cell."""
    from tessera.operators import realize as R

    a = np.arange(77.0).reshape(11, 7) % 5
    a[4:8, 3:6] = 0
    monkeypatch.setattr(R, "STACK_CELLS", cells)
    x = from_numpy(spark, a, ["i", "j"])
    for y, want in ((x, a), (x + 1, a + 1)):
        got = np.zeros(a.shape)
        for r in R.block_cells(y, (4, 3), "dense").collect():
            assert got[r.p0, r.p1] == 0
            got[r.p0, r.p1] = r.value
        assert (got == want).all()


@pytest.mark.parametrize("most", [64, 1 << 21])
def test_dense_deviances_take_many_blocks_at_a_time(monkeypatch, most):
    """A thousand blocks of few cells each: their terms come in a few calls, as sums over each block's own rows and columns."""
    import pyarrow as pa

    from tessera.operators import deviance as D
    from tessera.operators import realize as R

    r = np.random.default_rng(16)
    at = np.unique(np.stack([r.integers(0, 1000, 5000), r.integers(0, 30, 5000), r.integers(0, 8, 5000)]), axis=1)
    v, n = r.integers(1, 5, at.shape[1]).astype(float), (at[0] % 4 * 8 + at[2] + 6).astype(float)
    names = ["g", "s", "w", "s_left", "w_left", "seen"]
    calls, terms = [], D._terms
    monkeypatch.setattr(R, "STACK_CELLS", most)
    monkeypatch.setattr(D, "_terms", lambda *x: calls.append(x[0].size) or terms(*x))
    table = pa.Table.from_arrays([pa.array(x) for x in (*at, v, n)], names=["block", "i", "j", "v", "n"])
    got = pa.Table.from_batches(D._block_terms(30, 4, names, False)(iter(table.to_batches(700)))).to_pandas().groupby("__place").sum()
    sparse = pa.Table.from_batches(D._block_terms(30, 4, names, True)(iter(table.to_batches(700)))).to_pandas().groupby("__place").sum()
    np.testing.assert_allclose(got[["g", "s", "w"]], sparse[["g", "s", "w"]])
    # dense blocks have empty cells too, which cancel out: what is left and what was seen differ by as much
    for some in (got, sparse):
        some["rest"] = some["seen"] - some["w_left"]
    np.testing.assert_allclose(got[["s_left", "rest"]], sparse[["s_left", "rest"]])
    assert len(calls) - 8 < (3 if most > 64 else 1001) and max(calls) < 100_000
