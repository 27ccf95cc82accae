"""Dimensions of many keys, pruning at run time, and joins with hot keys."""

import numpy as np
import pytest
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators import matrix as M
from tessera.operators.array import CoordArray
from tessera.operators.deviance import row_deviances
from tessera.plans import dims as D
from tessera.sources.writer import from_numpy, read_coo, write_coo


@pytest.fixture
def few_on_the_driver(spark):
    spark.conf.set(D.LEVELS_CONF, "10")
    yield
    spark.conf.unset(D.LEVELS_CONF)


@pytest.fixture
def cells(spark):
    r = np.random.default_rng(1)
    rows = [(f"g{k:04d}", int(c), float(k % 7 + 1)) for k in r.permutation(300) for c in r.choice(40, 3, replace=False) * 3]
    return spark.createDataFrame(rows, "g string, c long, v double"), rows


def test_many_keys_are_a_table_and_stay_there(spark, few_on_the_driver, cells, monkeypatch):
    df, rows = cells
    gathered = []
    to_pandas = DataFrame.toPandas
    monkeypatch.setattr(DataFrame, "toPandas", lambda self: gathered.append(out := to_pandas(self)) or out)
    x = CoordArray.from_coo(df, "v", ["g", "c"])
    assert all(len(t) <= 11 for t in gathered)
    names, columns = sorted({r[0] for r in rows}), sorted({r[1] for r in rows})
    d = x.dim("g")
    assert isinstance(d.levels, D.LevelTable) and x.shape == (300, len(columns))
    assert [tuple(r) for r in d.table(spark).orderBy("__place").collect()] == [(n, i) for i, n in enumerate(names)]
    with pytest.raises(ValueError, match="kept as a table"):
        x.dimnames
    a = np.zeros(x.shape)
    for g, c, v in rows:
        a[names.index(g), columns.index(c)] = v
    assert (x.to_numpy() == a).all()
    sums = {r.g: r.value for r in x.row_sums().collect()}
    assert sums == dict(zip(names, a.sum(axis=1)))
    part = x[5:120, :]
    assert isinstance(part.dim("g").levels, D.LevelTable) and (part.to_numpy() == a[5:120]).all() and part.row_nnzs().count() == 115
    assert (part[10:20, 3:9].to_numpy() == a[15:25, 3:9]).all() and part[0, :].dims[0].levels == ("g0005",)
    assert (x[["g0200", "g0003"], :].to_numpy() == a[[200, 3]]).all() and (x[[7, 7, 299], :].to_numpy() == a[[7, 7, 299]]).all() and (x[::-50, :].to_numpy() == a[::-50]).all()
    with pytest.raises(IndexError, match="no level"):
        x[["none"], :]
    y, z = np.arange(300.0), np.arange(float(len(columns)))
    np.testing.assert_allclose((y @ x).to_numpy()[0], y @ a)
    np.testing.assert_allclose((x @ z).to_numpy().ravel(), a @ z)
    np.testing.assert_allclose(M.gram(x, "row").to_numpy(), a.T @ a)
    np.testing.assert_allclose(M.gram(x, "col", "tiled", side=64).to_numpy(), a @ a.T)
    b = np.arange(600.0).reshape(300, 2)
    np.testing.assert_allclose((x.T @ b).to_numpy(), a.T @ b)
    np.testing.assert_allclose((x.T @ x).to_numpy(), a.T @ a)
    np.testing.assert_allclose(x.sweep(0, y, "*").to_numpy(), a * y[:, None])
    assert (x + 1).dense_df().count() == 300 * len(columns)


def test_few_keys_and_ranges(spark, few_on_the_driver):
    df = spark.range(500).selectExpr("id + 7 AS i", "CAST(id % 3 AS string) AS s", "id * 2 AS e", "1 AS v")
    x = CoordArray.from_coo(df, "v", ["i", "s", "e"])
    assert x.dims[0].levels == range(7, 507) and x.dims[1].levels == ("0", "1", "2") and isinstance(x.dims[2].levels, D.LevelTable)
    assert x.dims[2].places_of([4, 998]) == [2, 499] and CoordArray.from_coo(df.where("false"), "v", ["i", "s"]).shape == (0, 0)


def test_partitions_are_pruned_at_run_time(spark, tmp_path):
    r = np.random.default_rng(2)
    a = r.integers(1, 5, (60, 40))
    path = str(tmp_path / "d")
    write_coo(from_numpy(spark, a, ["i", "j"]), path, ["i", "j"], grid=(10, 8))
    x = read_coo(spark, path)
    x = x.with_dim_tables({"i": D.group_table(spark, x.dim("i"), 10), "j": D.group_table(spark, x.dim("j"), 8)})
    for index, files in (((slice(12, 18), slice(None)), 5), (([3, 59], [0, 1]), 2), ((slice(None), slice(None)), 30)):
        part = x[index]
        rows = part.rows()
        assert ("dynamicpruning" in rows._jdf.queryExecution().executedPlan().toString()) == (files < 30)
        want = a[index] if isinstance(index[0], slice) else a[np.ix_(*index)]
        assert sum(q.value for q in rows.collect()) == want.sum()
        assert read_files(rows) == files
    with pytest.raises(ValueError, match="its group"):
        x.with_dim_tables({"i": spark.range(3)})


def read_files(df):
    """The files that a plan's scan of the cells read, after pruning."""
    plan = df._jdf.queryExecution().executedPlan()
    todo, found = [plan], []
    while todo:
        p = todo.pop()
        name = p.nodeName()
        if name.startswith("AdaptiveSparkPlan"):
            todo.append(p.executedPlan())
        elif "QueryStage" in name:
            todo.append(p.plan())
        elif name.startswith("Scan parquet") and "value" in p.simpleString(200):
            found.append(p.metrics().apply("numFiles").value())
        children = p.children()
        todo += [children.apply(i) for i in range(children.size())]
    return max(found)


def test_a_hot_key_is_dealt_to_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(D, "BROADCAST_ROWS", 0)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        df = spark.range(20_000).select((F.col("id") % 997).alias("r"), F.when(F.col("id") < 10_000, 5).otherwise(F.col("id") % 100).cast("long").alias("c"), ((F.col("id") % 4) + 1).cast("double").alias("v"))
        df = df.groupBy("r", "c").agg(F.sum("v").alias("v"))
        x = CoordArray.from_coo(df, "v", {"r": range(997), "c": range(100)})
        y = np.arange(100.0) + 1
        swept = x.sweep(1, y, "/")
        sizes = [r["count"] for r in swept.rows().groupBy(F.spark_partition_id()).count().collect()]
        n = sum(sizes)
        hot = df.where("c = 5").count()
        assert len(sizes) == 16 and hot > n / 20 and max(sizes) < 2.5 * n / 16
        a = x.to_numpy()
        np.testing.assert_allclose(swept.to_numpy(), a / y)
        np.testing.assert_allclose((x @ y).to_numpy().ravel(), a @ y)
        from tessera.operators.deviance import dense_row_deviances

        np.testing.assert_allclose([r.value for r in row_deviances(x).orderBy("r").collect()], dense_row_deviances(a), rtol=1e-8, atol=1e-6)
        one = spark.range(5000).select(F.lit(3).cast("long").alias("r"), F.col("id").alias("c"), F.lit(1.0).alias("v"))
        z = CoordArray.from_coo(one, "v", {"r": range(10), "c": range(5000)}).sweep(0, np.ones(10) * 2)
        sizes = [r["count"] for r in z.rows().groupBy(F.spark_partition_id()).count().collect()]
        assert len(sizes) >= 12 and max(sizes) < 1500
    finally:
        for name in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.coalescePartitions.enabled"):
            spark.conf.unset(name)
        spark.conf.set("spark.sql.shuffle.partitions", "4")
