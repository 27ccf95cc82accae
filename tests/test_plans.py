"""What the plans of common work look like: pruned scans, one shuffle, no Python."""

import pytest
from pyspark.sql import functions as F

from tessera.operators import matrix as M
from tessera.plans.dims import Dim
from tessera.sources.readers import read_parquet


@pytest.fixture(scope="module")
def x(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("cells") / "p")
    spark.range(2000).select((F.col("id") % 50).alias("r"), F.floor(F.col("id") / 50).cast("long").alias("c"), (F.col("id") % 7).cast("double").alias("v"), F.lit("x").alias("other")).write.parquet(path)
    return read_parquet(spark, path, "v", {"r": Dim("r", range(50), restricted=False), "c": Dim("c", range(40), restricted=False)})


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_margin_is_one_shuffle_of_partial_sums(x):
    text = plan((x * 2 + 1).row_vars(complete=False))
    assert text.count("Exchange hashpartitioning") == 1 and "partial_" in text and "Python" not in text
    assert "other" not in text.split("ReadSchema")[1]


def test_elementwise_work_is_one_projection(x):
    text = plan(((x + 1).log().exp() / 3 > 0.2).rows())
    assert "Exchange" not in text and "Join" not in text and text.count("FileScan") == 1


def test_subsets_reach_the_reader(x):
    text = plan(x[[3, 17], 5:20].rows())
    pushed = text.split("PushedFilters: [")[1].split("ReadSchema")[0]
    assert "In(r, [" in pushed and "GreaterThanOrEqual(c,5)" in pushed and "LessThanOrEqual(c,19)" in pushed
    assert "Exchange" not in text


def test_sweep_and_products_broadcast_small_sides(x):
    assert "BroadcastHashJoin" in plan(x.sweep(1, x.col_sums(), "/").rows())
    text = plan((x @ ([1.0] * 40)).rows())
    assert "BroadcastHashJoin" in text and text.count("Exchange hashpartitioning") == 1


def test_blocked_gram_adds_up_before_the_shuffle(x):
    text = plan(M.gram(x, "row", "blocked").rows())
    assert "MapInArrow" in text and "SortMergeJoin" not in text and "CartesianProduct" not in text


def test_slices_of_long_ranges_take_no_space(spark):
    from tessera.operators.array import CoordArray

    df = spark.createDataFrame([(5, 3, 1.0), (2_000_000_000, 4, 2.0)], "r long, c long, v double")
    x = CoordArray.from_coo(df, "v", {"r": range(1, 3_000_000_001), "c": range(1, 11)})
    y = x[1:2_999_999_999, :4]
    assert y.shape == (2_999_999_998, 4) and isinstance(y.dims[0].levels, range) and isinstance(y.dims[1].levels, range)
    assert sorted(r.value for r in y.rows().collect()) == [1.0, 2.0] and len(x[5:2, :].dims[0]) == 0


def test_gram_guard_counts_hot_keys_and_local_forms_are_bounded(spark):
    import pytest

    from tessera.operators import matrix as M
    from tessera.operators.array import CoordArray
    from tessera.operators.realize import to_coo

    rows = spark.range(1000).selectExpr("1 AS r", "id + 1 AS c", "1.0D AS v")
    x = CoordArray.from_coo(rows, "v", {"r": range(1, 1_000_001), "c": range(1, 1001)})
    with pytest.raises(ValueError, match="self-join of about 1e"):
        M.gram(x, "row", "join", limit=10_000)
    with pytest.raises(ValueError, match="too many for the driver"):
        to_coo(x, limit=999)


def test_hilbert_order_walks_between_neighbours(spark):
    from pyspark.sql import functions as F

    from tessera.sources.writer import hilbert

    grid = spark.range(256).selectExpr("id div 16 AS x", "id % 16 AS y")
    got = sorted((r.d, r.x, r.y) for r in grid.select("x", "y", hilbert([F.col("x"), F.col("y")], 4).alias("d")).collect())
    assert [d for d, _, _ in got] == list(range(256))
    assert all(abs(a[1] - b[1]) + abs(a[2] - b[2]) == 1 for a, b in zip(got, got[1:]))
