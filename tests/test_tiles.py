"""Products by tiles and truncated decompositions, against numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import matrix as M
from tessera.operators import tiles
from tessera.operators.array import CoordArray
from tessera.operators.svd import lanczos, svd
from tessera.operators.workflows import pca
from tessera.sources.writer import from_numpy


def made(spark, a, strings=False):
    if not strings:
        return from_numpy(spark, a, ["r", "c"])
    rows = [(f"g{i:03d}", f"s{j:03d}", float(a[i, j])) for i, j in np.argwhere(a != 0)]
    df = spark.createDataFrame(rows, "p string, k string, n double")
    return CoordArray.from_coo(df, "n", {"p": [f"g{i:03d}" for i in range(a.shape[0])], "k": [f"s{j:03d}" for j in range(a.shape[1])]})


@pytest.mark.parametrize(("share", "side", "strings"), [(0.9, 7, False), (0.05, 7, True), (0.3, 64, False)])
def test_gram_and_product(spark, share, side, strings):
    r = np.random.default_rng(int(share * 100))
    a = np.round(r.normal(size=(40, 23)), 2) * (r.random((40, 23)) < share)
    a[:, 5] = 1.5  # a contracted key that all rows have
    x = made(spark, a, strings)
    for contract, want in (("row", a.T @ a), ("col", a @ a.T)):
        np.testing.assert_allclose(M.gram(x, contract, "tiled", side=side).to_numpy(), want, atol=1e-9)
    np.testing.assert_allclose(M.tiled_matmul(x, x.T, side).to_numpy(), a @ a.T, atol=1e-9)
    b = np.round(r.normal(size=(23, 9)), 1)
    np.testing.assert_allclose(M.tiled_matmul(x, made(spark, b), side).to_numpy(), a @ b, atol=1e-9)


@pytest.mark.parametrize("shares", [1, 3])
def test_partial_tiles_are_added(spark, shares):
    a = np.random.default_rng(3).integers(-2, 3, (30, 50)).astype(float)
    cells = spark.createDataFrame([(int(k), int(p), float(a[p, k])) for p, k in np.argwhere(a != 0)], "k long, p long, v double")
    got = np.zeros((30, 30))
    for x in tiles.opened(tiles.product(cells, None, (30, 30), 8, shares)).collect():
        assert got[x.a, x.b] == 0
        got[x.a, x.b] = x.value
    np.testing.assert_allclose(got, a @ a.T)
    assert tiles.product(cells.where("false"), None, (30, 30), 8, shares).count() == 0


def test_a_hot_key_is_spread_and_nothing_is_joined(spark):
    """One contracted key that all rows have goes to every tile; no task has more of it than a tile's sides."""
    cells = spark.range(4000).select(F.lit(0).cast("long").alias("k"), F.col("id").alias("p"), F.lit(1.0).alias("v"))
    rows = tiles.product(cells, None, (4000, 4000), 500, 1)
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Exchange hashpartitioning") == 1
    assert rows.select(F.size("bs").alias("n")).agg(F.sum("n"), F.max("n"), F.count("n")).first()[:] == (16_000_000, 500, 32_000)


@pytest.mark.parametrize("strings", [False, True])
def test_sums_of_a_product_make_none_of_its_cells(spark, strings):
    r = np.random.default_rng(11)
    a = r.integers(-3, 4, (40, 23)) * (r.random((40, 23)) < 0.4) * 1.0
    b = r.integers(-3, 4, (23, 9)) * 1.0
    a[7], b[:, 2] = 0, 0  # a row and a column without cells
    x = made(spark, a, strings)
    value = lambda df: [row["value"] for row in df.orderBy(df.columns[0]).collect()]
    for got, want in ((M.gram(x, "col", "tiled", side=64), a @ a.T), (M.tiled_matmul(x, made(spark, b), 8), a @ b)):
        for side, axis in (("row", 1), ("col", 0)):
            sums = got.margin("sums", side)
            assert "MapInArrow" not in sums._jdf.queryExecution().executedPlan().toString()
            assert value(sums) == want.sum(axis).tolist()
    np.testing.assert_allclose(value(got.row_means()), want.mean(1))
    # Other statistics, and arrays made from the product, take its cells.
    assert value(got.col_maxs()) == want.max(0).tolist()
    assert value((got * 2 + 1).row_sums()) == (want * 2 + 1).sum(1).tolist()
    assert value(got[:, 2:6].row_sums()) == want[:, 2:6].sum(1).tolist()
    assert value(got.T.row_sums()) == want.sum(0).tolist()
    assert got.row_sums(name="total").columns[-1] == "total"
    assert got.row_sums(complete=False).count() == 39


def test_a_missing_value_makes_sums_of_a_product_nan(spark):
    cells = spark.createDataFrame([(0, 0, 1.0), (0, 1, None), (1, 1, 2.0), (2, 2, 3.0)], "r int, c int, v double")
    got = M.gram(CoordArray.from_coo(cells, "v", {"r": range(3), "c": range(3)}), "col", "tiled")
    assert [str(row["value"]) for row in got.row_sums().orderBy("r_a").collect()] == ["nan", "nan", "9.0"]


def test_name_of_a_place_may_be_taken(spark):
    df = spark.createDataFrame([("x", "u", 2.0), ("y", "u", 3.0)], "p string, k string, v double")
    x = CoordArray.from_coo(df, "v", {"p": ["x", "y"], "k": ["u", "w"]})
    assert M.gram(x, "col", "tiled").to_numpy().tolist() == [[4.0, 6.0], [6.0, 9.0]]


@pytest.mark.parametrize("centre", [True, False])
def test_svd_equals_a_dense_one(spark, centre):
    r = np.random.default_rng(5)
    a = (r.normal(size=(60, 8)) * (2.0 ** -np.arange(8))) @ r.normal(size=(8, 90)) * (r.random((60, 90)) < 0.7)
    got = svd(made(spark, a), 5, centre)
    c = a - a.mean(axis=1, keepdims=True) if centre else a
    u, d, v = np.linalg.svd(c, full_matrices=False)
    np.testing.assert_allclose(got.d, d[:5], rtol=1e-8)
    np.testing.assert_allclose(np.abs(np.sum(got.u * u[:, :5], axis=0)), 1, atol=1e-7)
    scores = np.zeros((90, 5))
    for x in got.scores().collect():
        scores[x.c - 1, x.number - 1] = x.value
    np.testing.assert_allclose(scores, c.T @ got.u, atol=1e-8)


def test_lanczos_starts_anew_and_ends_early():
    r = np.random.default_rng(6)
    q = np.linalg.qr(r.normal(size=(300, 300)))[0]
    values = 1.0 / (1 + np.arange(300.0)) ** 0.5
    c = (q * values) @ q.T
    seen = []

    def apply(x):
        seen.append(x.shape[1])
        return c @ x

    found, vectors = lanczos(apply, 300, 4, extra=4, most_bytes=16 * 300 * 40)
    np.testing.assert_allclose(found, values[:4], rtol=1e-8)
    assert len(seen) > 5 and max(seen) == 8
    low, _ = lanczos(lambda x: np.outer(q[:, 0], q[:, 0] @ x), 300, 3)  # of rank one
    np.testing.assert_allclose(low, [1, 0, 0], atol=1e-9)
    assert lanczos(lambda x: 0 * x, 5, 9)[0].tolist() == [0.0] * 5
    with pytest.raises(ValueError, match="do not fit"):
        lanczos(apply, 300, 4, most_bytes=1000)


def test_pca_by_either_way(spark):
    r = np.random.default_rng(8)
    a = r.normal(size=(30, 4)) @ r.normal(size=(4, 50)) * 3 + r.normal(size=(30, 50)) * 0.1
    x = made(spark, a)
    (one, u), (two, w) = pca(x, 4), pca(x, 4, square_rows=10)
    np.testing.assert_allclose(one, two, rtol=1e-8)
    np.testing.assert_allclose(u, w, atol=1e-6)


def test_more_rows_than_a_square_allows(spark):
    """5,000 rows of rank three: values as of the small side's square."""
    r = np.random.default_rng(9)
    left, right = r.normal(size=(5000, 3)), r.normal(size=(3, 12))
    a = np.round(left @ right, 3)
    x = made(spark, a)
    sd, loadings = pca(x, 3)
    c = a - a.mean(axis=1, keepdims=True)
    want = np.sqrt(np.maximum(np.linalg.eigvalsh(c.T @ c)[::-1][:3], 0) / 11)
    np.testing.assert_allclose(sd, want, rtol=1e-7)
    assert loadings.shape == (5000, 3)


@pytest.mark.parametrize("centre", [True, False])
def test_few_columns_send_nothing_tall_to_the_driver(spark, centre, monkeypatch):
    """A budget of 4 kB holds no block of 700 rows; values, scores and vectors are those of a dense decomposition."""
    from tessera.operators import svd as S

    r = np.random.default_rng(10)
    a = np.round(r.normal(size=(700, 6)) * (r.random((700, 6)) < 0.6), 2)
    a[5] = 0
    with monkeypatch.context() as m:
        m.setattr(S, "DRIVER_BYTES", 4096)
        got = svd(made(spark, a), 6, centre)
        scores = np.zeros((6, 6))
        for x in got.scores().collect():
            scores[x.c - 1, x.number - 1] = x.value
        with pytest.raises(ValueError, match="do not fit"):
            got.u
        table = got.vectors().collect()
    c = a - a.mean(axis=1, keepdims=True) if centre else a
    np.testing.assert_allclose(got.d, np.linalg.svd(c)[1], rtol=1e-8, atol=1e-6)
    np.testing.assert_allclose(scores, c.T @ got.u, atol=1e-6)
    u = np.zeros((700, 6))
    for x in table:
        u[x.r - 1, x.number - 1] = x.value
    np.testing.assert_allclose(u, got.u, atol=1e-12)
    np.testing.assert_allclose(u.T @ u, np.diag([1.0] * 5 + [0.0 if centre else 1.0]), atol=1e-8)
    assert all(u[np.abs(u[:, i]).argmax(), i] >= 0 for i in range(6))


def test_dropped_slices_are_matrices(spark):
    a = np.random.default_rng(4).integers(0, 4, (4, 3, 2)).astype(float)
    x = from_numpy(spark, a, ["i", "j", "k"])
    y, m = x[:, 1, :], x[:, 1, :].as_matrix()
    assert (m.to_numpy() == a[:, 1]).all() and m.shape == (4, 2) and type(m) is M.CoordMatrix and [d.name for d in m.dims] == ["i", "k"]
    assert (y.T.to_numpy() == a[:, 1].T).all()
    np.testing.assert_allclose((y @ [1.0, 2.0]).to_numpy().ravel(), a[:, 1] @ [1, 2])
    np.testing.assert_allclose((np.arange(4.0) @ y).to_numpy().ravel(), np.arange(4) @ a[:, 1])
    np.testing.assert_allclose(M.crossprod(y.as_matrix()).to_numpy(), a[:, 1].T @ a[:, 1])
    assert (m.row_sums().count(), (m + 1).fill_value) == (4, 1)
    assert x[[2], 1, :].as_matrix().shape in ((2,), (1, 2)) and len(x[[2], 1, :].as_matrix().dims) == 2
    with pytest.raises(ValueError, match="two key columns"):
        x.as_matrix()
    with pytest.raises(ValueError, match="two dimensions"):
        x.T


@pytest.mark.parametrize("two", [False, True])
def test_cells_go_only_to_tiles_with_partners(spark, two):
    """Fifty groups that share no key: a cell is sent to its own tile, not to all 50 of its row."""
    r = np.random.default_rng(12)
    cells = [(g * 4 + k, g * 8 + p, float(r.integers(1, 9))) for g in range(50) for k in range(4) for p in range(8) if r.random() < 0.6]
    left = spark.createDataFrame(cells, "k long, p long, v double")
    a = np.zeros((400, 200))
    for k, p, v in cells:
        a[p, k] = v
    rows = tiles.product(left, left if two else None, (400, 400), 8, 1, partners=True)
    got = np.zeros((400, 400))
    for x in tiles.opened(rows).collect():
        got[x.a, x.b] = x.value
    np.testing.assert_allclose(got, a @ a.T)
    sent = spark.sparkContext.accumulator(0)
    whole = tiles._multiply

    def counted(*options):
        run = whole(*options)

        def each(batches):
            def seen():
                for b in batches:
                    sent.add(b.num_rows)
                    yield b

            return run(seen())

        return each

    tiles._multiply = counted
    try:
        tiles.product(left, left if two else None, (400, 400), 8, 1, partners=True).count()
    finally:
        tiles._multiply = whole
    assert sent.value == len(cells) * (2 if two else 1)


def test_products_of_many_pairs_go_by_tiles(spark, monkeypatch):
    """A join that was not limited by its caller is no error, and arrays are multiplied by tiles."""
    a = np.random.default_rng(13).integers(0, 4, (30, 9)).astype(float)
    x = made(spark, a)
    monkeypatch.setattr(M, "GRAM_PAIRS", 100)
    monkeypatch.setattr(M.tiles, "SIDE", 2)
    np.testing.assert_allclose(M.gram(x, "row", "join").to_numpy(), a.T @ a)
    np.testing.assert_allclose((x @ x.T).to_numpy(), a @ a.T)
    with pytest.raises(ValueError, match="does not scale"):
        M.gram(x, "row", "join", limit=100)


@pytest.mark.parametrize("stored", [False, True])
@pytest.mark.parametrize("two", [False, True])
def test_packed_cells_are_few_rows_and_hot_keys_go_in_pieces(monkeypatch, two, stored):
    """Stretches of 64 cells; a key of more than 100 goes in pieces. All meet in their tiles, once, as few rows."""
    import pyarrow as pa

    r = np.random.default_rng(14)
    a = r.integers(1, 9, (50, 300)) * (r.random((50, 300)) < 0.03) * 1.0
    a[7] = a[31] = np.arange(300) % 5 + 1
    b = r.integers(1, 9, (50, 90)) * (r.random((50, 90)) < 0.2) * 1.0 if two else a
    b[8] = 2
    cells = sorted((int(k), bool(s), int(p), float(x[k, p])) for s, x in enumerate((a, b) if two else (a,)) for k, p in np.argwhere(x != 0))
    monkeypatch.setattr(tiles, "STRETCH", 64)
    monkeypatch.setattr(tiles, "HOT", 100)
    batches = [pa.RecordBatch.from_pylist([dict(zip(("k", "right", "p", "v"), c)) for c in cells[i : i + 33]]) for i in range(0, len(cells), 33)]
    found = list(tiles._stretched(iter(batches)))
    assert {key for key, *_ in found} >= {None, 7, 31} and sum(len(x[0]) + len(y[0]) for _, x, y in found) == len(cells)
    if stored:
        rows = pa.Table.from_batches(tiles._stored(not two)(iter(batches)))
        assert sum(p or 0 for p in rows["pairs"].to_pylist()) == sum((a[k] != 0).sum() * (b[k] != 0).sum() for k in range(50) if k not in {key for key, *_ in found})
        found = tiles._restored(not two)(iter(rows.to_batches()))
    shape, side = (300, b.shape[1]), 100
    sent = [r for part in tiles._packed(side, shape, 1, not two)(iter(found)) for r in part.to_pylist()]
    sent.sort(key=lambda x: (x["i"], x["j"], x["share"], -1 if x["key"] is None else x["key"]))
    whole = pa.RecordBatch.from_pylist(sent)
    got = np.zeros(shape)
    for part in tiles._multiply(side, shape, not two, True)(tiles._unpacked(side)(iter([whole.slice(0, 5), whole.slice(5)]))):
        for x in part.to_pylist():
            assert not got[x["a"], x["bs"]].any()
            got[x["a"], x["bs"]] = x["vs"]
    np.testing.assert_allclose(got, a.T @ b)
    assert len(sent) < len(cells) / 4


def test_a_product_with_its_own_transpose_sends_cells_once(spark):
    a = np.random.default_rng(15).integers(0, 4, (30, 9)).astype(float)
    x, y = made(spark, a), made(spark, a)
    assert M._own_transpose(x.T, x) and not M._own_transpose(x.T, y) and not M._own_transpose(x.T, x + 0 * x) and not M._own_transpose(x, x.T[:, :5])
    got = (x.T @ x, M.tiled_matmul(x.T, x, 4))
    assert [d.name for d in got[0].dims] == [d.name for d in got[1].dims] == ["c_a", "c_b"]
    for g in got:
        np.testing.assert_allclose(g.to_numpy(), a.T @ a)


def test_packed_cells_may_be_of_short_types(spark):
    a = np.random.default_rng(17).integers(0, 3, (40, 6))
    cells = spark.createDataFrame([(int(k), int(p), int(a[p, k])) for p, k in np.argwhere(a)], "k int, p int, v int")
    stored = tiles.stretches(cells, None)
    assert tiles.pairs(stored) == sum((a[:, k] != 0).sum() ** 2 for k in range(6))
    for s in (None, stored):
        got = np.zeros((40, 40))
        for x in tiles.opened(tiles.product(cells, None, (40, 40), 8, partners=True, stored=s)).collect():
            got[x.a, x.b] = x.value
        assert (got == a @ a.T).all()
