import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators.array import CoordArray
from tessera.operators.realize import apply_blocks, blocks, to_csc
from tessera.sources.readers import read_csv, read_parquet, read_sql, read_table
from tessera.sources.writer import from_numpy

LEVELS = {"class": ["1st", "2nd", "3rd", "Crew"], "sex": ["F", "M"], "age": ["A", "C"], "fate": [10, 20, 30]}


@pytest.fixture(scope="module")
def dense():
    r = np.random.default_rng(0)
    x = r.integers(-4, 9, (4, 2, 2, 3)) * (r.random((4, 2, 2, 3)) < 0.5)
    x[2] = 0
    x[1, 0, 0] = 0
    return x


@pytest.fixture(scope="module")
def coo(spark, dense):
    rows = [(*(LEVELS[n][i] for n, i in zip(LEVELS, at)), int(dense[at])) for at in itertools.product(*map(range, dense.shape)) if dense[at]]
    return spark.createDataFrame(rows, "class string, sex string, age string, fate int, n int").cache()


@pytest.fixture(scope="module")
def x(coo):
    return CoordArray.from_coo(coo, "n", LEVELS)


def check(a, want):
    got = a.to_numpy()
    assert got.shape == want.shape and a.shape == want.shape
    np.testing.assert_allclose(got.astype(float), want.astype(float), rtol=1e-12)


def test_metadata(x, dense):
    assert x.shape == (4, 2, 2, 3) and x.size == 48 and x.type == "integer" and x.zero_filled and x.is_sparse
    assert x.dimnames == [list(v) for v in LEVELS.values()]
    assert repr(x) == '<4 x 2 x 2 x 3> sparse CoordArray object of type "integer"'
    check(x, dense)
    named = x.with_dimnames({"fate": ["a", "b", "c"]})
    assert named.dimnames[3] == ["a", "b", "c"] and named.dim("fate").levels == (10, 20, 30)
    with pytest.raises(ValueError):
        x.with_dimnames({"fate": ["a"]})
    assert x.with_dim_tables({"class": dict.fromkeys(LEVELS["class"], 1)}).dim_tables["class"][0] == "class_group"


def test_levels(coo, dense):
    found = CoordArray.from_coo(coo, "n", ["class", "sex", "age", "fate"])
    assert found.shape[1:] == (2, 2, 3) and found.dim("fate").levels == (10, 20, 30)
    part = CoordArray.from_coo(coo, F.col("n") * 2, {"class": ["Crew", "1st"], "sex": {"women": "F"}, "age": ["A", "C"], "fate": [30, 10]})
    check(part, 2 * dense[[3, 0]][:, [0]][..., [2, 0]])
    assert part.dimnames[1] == ["women"]
    with pytest.raises(TypeError):
        CoordArray.from_coo(coo, ["n"], LEVELS)


@pytest.mark.parametrize("kind", ["logical", "integer", "integer64", "double", "character"])
def test_cast(coo, x, kind):
    a = CoordArray.from_coo(coo, "n", LEVELS, type=kind)
    assert a.type == kind and a.fill_value == {"logical": False, "character": ""}.get(kind, 0)
    if kind != "character":
        check(a, x.to_numpy().astype(bool) if kind == "logical" else x.to_numpy())
        assert x.astype(kind).type == kind
    else:
        assert (a == "3").nzcount() == (x.to_numpy() == 3).sum() and (a != "").nzcount() == (x.to_numpy() != 0).sum()


def test_subsets(x, dense):
    check(x[:, 0, :, 1], dense[:, 0, :, 1])
    check(x[[3, 1], :, ::-1, [True, False, True]], dense[[3, 1]][:, :, ::-1][..., [0, 2]])
    check(x[["Crew", "2nd"], "M", :, :], dense[[3, 1]][:, 1])
    check(x[1, 1, 1, 1], dense[1, 1, 1, 1].reshape(1))
    check(x.subset(1, 1, slice(None), slice(None), drop=False), dense[1:2, 1:2])
    check(x[[1, 1, 0], :, :, :], dense[[1, 1, 0]])
    check(x[:, 0, :, :][:, :, [0]], dense[:, 0, :, [0]].transpose(1, 2, 0)[:, :, 0])
    assert x[1, 1, 1, 1].dimnames is None and type(x[:, 0, :, 1]) is CoordArray
    for bad in ((9, 0, 0, 0), ("no", 0, 0, 0), (0, 0, 0), ([True], 0, 0, 0)):
        with pytest.raises(IndexError):
            x[bad]


def test_order(x, dense):
    check(x.aperm((2, 0, 3, 1)), dense.transpose(2, 0, 3, 1))
    m = x[:, 0, :, 1].as_matrix()
    with pytest.raises(ValueError, match="permutation"):
        x.aperm((0, 0, 1, 2))
    with pytest.raises(ValueError):
        x.T
    assert m.shape == (4, 2) if len(m.dims) == 2 else True


def test_order_of_a_matrix(spark):
    a = np.arange(6).reshape(2, 3)
    m = from_numpy(spark, a, ["r", "c"])
    check(m.T, a.T)
    check(m[:, 1], a[:, 1])
    assert type(m).__name__ == "CoordMatrix" and m.T.dimnames == [[1, 2, 3], [1, 2]]


def test_arithmetic(x, dense):
    d = dense.astype(float)
    with np.errstate(all="ignore"):
        for got, want in [
            (x + x, d + d), (x + 3, d + 3), (3 - x, 3 - d), (x * x, d * d), (x / 4, d / 4), (4 / (x + 5), 4 / (d + 5)), (x % 3, np.mod(d, 3)), (x // 3, np.floor(d / 3)),
            (x**2, d**2), (2**x, 2**d), (-x, -d), (+x, d), (x + 7 - x * 2.5, d + 7 - d * 2.5), (x / x, d / d), (x % 0, np.mod(d, 0)), (1 / x, 1 / d), (True + x, d + 1), (-7 % (x - 20), np.mod(-7, d - 20)),
        ]:
            check(got, want)
    assert (x + 1).fill_value == 1 and (x / 0).fill_value != (x / 0).fill_value and not (x + 1).zero_filled


def test_logic_and_comparison(x, dense):
    for name in ("__eq__", "__ne__", "__lt__", "__le__", "__gt__", "__ge__"):
        check(getattr(x, name)(2), getattr(dense, name)(2))
        check(getattr(x, name)(x * 2 - 1), getattr(dense, name)(dense * 2 - 1))
    check((x > 1) & (x < 5), (dense > 1) & (dense < 5))
    check((x > 1) | (x == 0), (dense > 1) | (dense == 0))
    check(~x, dense == 0)
    check(~(x > 0) & True, dense <= 0)
    assert (x > 0).type == "logical"


def test_incompatible(x, coo):
    for other in (x[[0, 1], :, :, :], CoordArray.from_coo(coo.select("*"), "n", LEVELS)):
        with pytest.raises(ValueError, match="compatible"):
            x + other
    for name in ("cumsum", "digamma", "cospi"):
        with pytest.raises(NotImplementedError):
            getattr(x, name)()
    with pytest.raises(AttributeError):
        x.nothing


def test_math_and_sparsity(x, dense):
    d = dense.astype(float)
    with np.errstate(all="ignore"):
        check(x.exp(), np.exp(d))
        check((x / 4).floor(), np.floor(d / 4))
        check(abs(x).sqrt().log1p(), np.log1p(np.sqrt(abs(d))))
        check((x / x).is_nan(), np.isnan(d / d))
        check((1 / x).is_infinite(), np.isinf(1 / d))
        check((1 / x).is_finite(), np.isfinite(1 / d))
    check(x.is_nonzero(), dense != 0)
    assert x.nzcount() == (dense != 0).sum() and (x + 7).nzcount() == (dense + 7 != 0).sum()
    assert [r.value for r in x.nzvals().collect()] == [v for v in dense.ravel(order="F") if v]


STATS = {
    "sums": lambda v: v.sum(1), "means": lambda v: v.mean(1), "mins": lambda v: v.min(1), "maxs": lambda v: v.max(1),
    "vars": lambda v: v.var(1, ddof=1), "sds": lambda v: v.std(1, ddof=1), "counts": lambda v: (v == 1).sum(1), "nnzs": lambda v: (v != 0).sum(1),
}


@pytest.mark.parametrize("what", sorted(STATS))
@pytest.mark.parametrize("add", [0, 7, -3])
def test_margins(x, dense, what, add):
    a, d = (x + add, dense + add) if add else (x, dense)
    for dims in (1, 2, 3):
        cells = int(np.prod(d.shape[:dims]))
        for side, flat in (("row", d.reshape(cells, -1)), ("col", d.reshape(cells, -1).T)):
            options = {"value": 1} if what == "counts" else {}
            got = a.margin(what, side, dims, **options).toPandas()
            kept = list(LEVELS)[:dims] if side == "row" else list(LEVELS)[dims:]
            assert list(got.columns) == [*kept, "value"]
            want = dict(zip(itertools.product(*(LEVELS[k] for k in kept)), STATS[what](flat)))
            have = {tuple(r[:-1]): r[-1] for r in got.itertuples(index=False)}
            assert have.keys() == want.keys()
            for k in want:
                assert abs(float(have[k]) - float(want[k])) < 1e-9


def test_margin_options(spark, x, dense):
    for v in (0, 3, 7):
        got = {r["class"]: r["value"] for r in x.row_counts(value=v).collect()}
        assert list(got.values()) == [got[k] for k in got] and got == dict(zip(LEVELS["class"], (dense.reshape(4, -1) == v).sum(1).tolist()))
    got = {r[0]: r[1] for r in (x > 2).row_counts().collect()}
    assert got == dict(zip(LEVELS["class"], (dense.reshape(4, -1) > 2).sum(1).tolist()))
    m = CoordArray.from_coo(spark.createDataFrame([(1, 1, 1.0), (1, 3, None), (2, 1, 4.0), (2, 2, 5.0), (2, 3, 6.0)], "r int, c int, v double"), "v", {"r": [1, 2], "c": [1, 2, 3]})
    assert [r.value for r in m.row_sums().orderBy("r").collect()] == [None, 15.0]
    assert [r.value for r in m.row_sums(na_rm=True).orderBy("r").collect()] == [1.0, 15.0]
    assert [r.value for r in m.row_means(na_rm=True).orderBy("r").collect()] == [0.5, 5.0]
    assert [round(r.value, 9) for r in m.row_vars(na_rm=True).orderBy("r").collect()] == [0.5, 1.0]
    assert [r.value for r in m.col_maxs().orderBy("c").collect()] == [4.0, 5.0, None]
    assert np.isnan(m.to_numpy()[0, 2])
    with pytest.raises(ValueError):
        m.row_sums(dims=2)
    inside = x[:, 0, :, :].row_sums()
    assert {r[0]: r[1] for r in inside.collect()} == dict(zip(LEVELS["class"], dense[:, 0].reshape(4, -1).sum(1).tolist()))


def test_summary(x, dense):
    for a, d in ((x, dense), (x + 7, dense + 7), (x > -9, dense > -9)):
        assert a.summary("sum") == d.sum() and a.summary("min") == d.min() and a.summary("range") == (d.min(), d.max())
        assert a.summary("any") == bool(d.any()) and a.summary("all") == bool(d.all())
        assert abs(a.summary("prod") / max(1.0, abs(float(np.prod(d.astype(float))))) - np.prod(d.astype(float)) / max(1.0, abs(float(np.prod(d.astype(float)))))) < 1e-9


def test_sweep(x, dense):
    d = dense.astype(float)
    stats = [2.0, 3.0, 4.0, 5.0]
    s = np.array(stats).reshape(4, 1, 1, 1)
    for fun, want in (("*", d * s), ("/", d / s), ("%/%", np.floor(d / s)), ("%%", np.mod(d, s))):
        check(x.sweep(0, stats, fun), want)
    both = x.sweep(0, stats, "/").sweep(3, [1, 10, 100], "*")
    check(both, d / s * np.array([1, 10, 100.0]))
    table = x.row_sums(dims=2)
    with np.errstate(all="ignore"):
        want = np.where(dense != 0, d / d.sum((2, 3), keepdims=True), 0)
    check(x.sweep((0, 1), table, "/"), want)
    with pytest.raises(ValueError):
        (x + 1).sweep(0, stats)
    with pytest.raises(ValueError, match="STATS"):
        x.sweep(0, [1, 2])
    with pytest.raises(ValueError, match="FUN"):
        x.sweep(0, stats, "+")


def test_realise(spark, x, dense):
    m = from_numpy(spark, dense.reshape(8, 6), ["r", "c"])
    p, i, v = to_csc(m)
    back = np.zeros((8, 6), int)
    for c in range(6):
        back[i[p[c] : p[c + 1]], c] = v[p[c] : p[c + 1]]
    assert (back == dense.reshape(8, 6)).all()
    out = np.zeros((8, 6))
    for (r, c), b in blocks(m, (3, 4)):
        out[r : r + b.shape[0], c : c + b.shape[1]] = b
    assert (out == dense.reshape(8, 6)).all()
    import pandas as pd

    got = apply_blocks(m, (3, 4), lambda at, b: pd.DataFrame({"s": [float(b.sum())]}), "s double").agg(F.sum("s")).first()[0]
    assert got == dense.sum()
    full = (m + 2).dense_df().toPandas().pivot(index="r", columns="c", values="value").to_numpy()
    assert (full == dense.reshape(8, 6) + 2).all()


def test_readers(spark, coo, dense, tmp_path):
    coo.write.parquet(str(tmp_path / "p"))
    coo.write.option("header", True).option("compression", "gzip").csv(str(tmp_path / "c"))
    coo.createOrReplaceTempView("titanic_cells")
    for a in (read_parquet(spark, str(tmp_path / "p"), "n", LEVELS), read_csv(spark, str(tmp_path / "c"), "n", LEVELS), read_table(spark, "titanic_cells", "n", LEVELS), read_sql(spark, "SELECT * FROM titanic_cells", F.expr("n"), LEVELS)):
        check(a, dense)
    plan = read_parquet(spark, str(tmp_path / "p"), "n", LEVELS)[["1st"], :, :, :].rows()._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [" in plan and "class" in plan.split("PushedFilters")[1].split("]")[0]
