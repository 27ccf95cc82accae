import hashlib
import os

import numpy as np
import pytest

from tessera.operators.array import CoordArray
from tessera.plans.dims import Dim, dim_tables
from tessera.sources.writer import from_numpy, integer_type, read_coo, side_info, write_coo, write_dense
from tessera.streaming.append import append_slabs


@pytest.fixture(scope="module")
def a():
    r = np.random.default_rng(2)
    return np.round(r.random((50, 8)) * 9, 1) * (r.random((50, 8)) < 0.7)


@pytest.fixture(scope="module")
def x(spark, a):
    return from_numpy(spark, a, ["i", "j"])


def prints(path):
    return {os.path.join(d, f): hashlib.md5(open(os.path.join(d, f), "rb").read()).hexdigest() for d, _, fs in os.walk(path) for f in fs}


@pytest.mark.parametrize("options", [{}, {"single": True}, {"grid": (10, 4)}, {"grid": (50, 3), "cluster_by": "zorder"}, {"grid": (7, 8), "cluster_by": ["i"]}])
def test_round_trip(spark, x, a, tmp_path, options):
    path = str(tmp_path / "d")
    write_coo(x, path, ["i", "j"], **options)
    back = read_coo(spark, path)
    assert (back.to_numpy() == a).all() and back.df.schema["i"].dataType.simpleString() == "tinyint"
    if options.get("grid") == (10, 4):
        assert sorted(n for n in os.listdir(path) if n.startswith("i_")) == [f"i_group={g}" for g in range(1, 6)]
        assert sorted(os.listdir(path + "/i_group=1"))[0] == "j_group=1"
        assert all(len([f for f in fs if f.endswith(".parquet")]) == 1 for d, _, fs in os.walk(path) if "j_group" in d)
    with pytest.raises(ValueError, match="exists"):
        write_coo(x, path, ["i", "j"], **options)


def test_types(spark, x, tmp_path):
    assert [integer_type(n).simpleString() for n in (127, 128, 40000, 3_000_000_000)] == ["tinyint", "smallint", "int", "bigint"]
    path = str(tmp_path / "t")
    write_coo((x * 10).floor() % 100, path, ["i", "j"], max_dim=(40000, 3_000_000_000))
    schema = {f["name"]: f["type"] for f in side_info(spark, path)["schema"]["fields"]}
    assert schema == {"i": "integer", "j": "long", "value": "byte"}
    for k, v in (("double", "double"), ("int", "integer")):
        write_coo(x.floor(), str(tmp_path / k), ["i", "j"], "v", type=k)
        assert side_info(spark, str(tmp_path / k))["schema"]["fields"][2]["type"] == v


def test_empty_and_bad(spark, x, tmp_path):
    for n, grid in enumerate((None, (2, 2))):
        path = str(tmp_path / f"e{n}")
        write_dense(spark, np.zeros((3, 4), int), path, ["i", "j"], grid=grid)
        assert read_coo(spark, path).to_numpy().shape == (3, 4) and read_coo(spark, path).nzcount() == 0
    for options, words in (
        ({"max_dim": "a"}, "must be NULL or an integer vector"),
        ({"max_dim": (1, 1)}, "must be >= dim"),
        ({"append": 1}, "'append' must be a single logical"),
        ({"along": "k"}, "'along' must be"),
        ({"offset": -1}, "'offset' must be"),
        ({"group_offset": 1.5}, "'group_offset' must be"),
        ({"append": True}, "target directory does not exist"),
        ({"grid": (0, 1)}, "'grid' must be"),
    ):
        with pytest.raises(ValueError, match=words):
            write_coo(x, str(tmp_path / "no"), ["i", "j"], **options)
    with pytest.raises(ValueError, match="indexcols"):
        write_coo(x, str(tmp_path / "no"), ["i"])
    with pytest.raises(ValueError, match="array-like"):
        from_numpy(spark, 3, ["i"])
    with pytest.raises(ValueError, match="filled with zero"):
        write_coo(x + 1, str(tmp_path / "no"), ["i", "j"])
    assert not os.path.exists(tmp_path / "no")


def test_append(spark, a, tmp_path):
    path = str(tmp_path / "s")
    first, second = from_numpy(spark, a[:, :4], ["i", "j"]), from_numpy(spark, a[:, 4:], ["i", "j"])
    write_coo(first, path, ["i", "j"], grid=(25, 2), max_dim=(50, 200))
    before = prints(path)
    wide = from_numpy(spark, np.where(a[:, :4] > 0, 7.25, 0), ["i", "j"])
    strings = CoordArray.from_coo(spark.createDataFrame([(1, 1, "s")], "i long, j long, v string"), "v", {"i": range(1, 51), "j": range(1, 5)})
    for array, options, words in (
        (second, {"along": "j", "offset": 4, "group_offset": 0}, "would write into an existing partition"),
        (second, {"along": "j", "offset": 40000, "group_offset": 2}, "schema mismatch on 'j'"),
        (strings, {"along": "j", "offset": 4, "group_offset": 2}, "schema mismatch on 'value'"),
        (wide, {"along": "j", "offset": 4, "group_offset": 2, "value": "other"}, "lacks field 'other'"),
    ):
        with pytest.raises(ValueError, match=words):
            write_coo(array, path, ["i", "j"], grid=(25, 2), append=True, **options)
        assert prints(path) == before
    with pytest.raises(ValueError, match="hive-partitioned"):
        write_coo(second, path, ["i", "j"], append=True, along="j", offset=4)
    write_coo(second, path, ["i", "j"], grid=(25, 2), append=True, along="j", offset=4, group_offset=2)
    assert (read_coo(spark, path).to_numpy() == a).all()
    assert set(before) - {os.path.join(path, n) for n in ("_SUCCESS", "._SUCCESS.crc", "_tessera.json", "._tessera.json.crc")} <= set(prints(path))


def test_dim_tables_prune(spark, x, tmp_path):
    path = str(tmp_path / "p")
    write_coo(x, path, ["i", "j"], grid=(10, 4))
    tables = dim_tables(x.dims, (10, 4))
    assert tables["i"][11] == 2 and dim_tables(x.dims, (50, 4))["i"] is None and dim_tables([Dim("k", range(3))], None) == {"k": None}
    back = read_coo(spark, path, tables)
    part = back[[3, 47], :]
    plan = part.rows()._jdf.queryExecution().executedPlan().toString()
    filters = plan.split("PartitionFilters: [")[1].split("]")[0]
    assert "i_group" in filters
    assert (part.to_numpy() == x.to_numpy()[[3, 47]]).all()


def test_stream(spark, a, tmp_path):
    source, path = str(tmp_path / "in"), str(tmp_path / "out")
    for k in range(2):
        slab = from_numpy(spark, a[:, 4 * k : 4 * k + 4], ["i", "j"]).rows("v")
        slab.coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema("i long, j long, v double").option("maxFilesPerTrigger", 1).parquet(source)
    query = append_slabs(stream, path, ["i", "j"], "v", "j", 4, (50, 4)).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    got = read_coo(spark, path).to_numpy()
    assert got.shape == (50, 8) and sorted([got[:, :4].sum().round(6), got[:, 4:].sum().round(6)]) == sorted([a[:, :4].sum().round(6), a[:, 4:].sum().round(6)])


@pytest.mark.parametrize("options", [{"single": True}, {"single": True, "cluster_by": "hilbert"}, {"grid": (25, 8), "cluster_by": "hilbert"}, {"grid": (25, 8), "cluster_by": "zorder"}])
def test_sorts_are_bounded_and_of_columns(spark, x, a, tmp_path, monkeypatch, options):
    """A single file is sorted in ranges of 40 rows; curves are worked out before the sort; files are in order."""
    import pyarrow.parquet as pq
    from pyspark.sql import DataFrame
    from pyspark.sql import functions as F

    from tessera.sources import writer as W

    plans, write = [], DataFrame.write.fget
    monkeypatch.setattr(W, "SORT_ROWS", 40)
    monkeypatch.setattr(type(x.df), "write", property(lambda df: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or write(df)), raising=False)
    path = str(tmp_path / "d")
    write_coo(x, path, ["i", "j"], **options)
    sort = next(line for line in plans[-1].splitlines() if "Sort [" in line)
    assert "aggregate(" not in sort and "shiftleft" not in sort and "<<" not in sort and "__curve" not in plans[-1].splitlines()[0]
    files = [os.path.join(d, f) for d, _, fs in os.walk(path) for f in fs if f.endswith(".parquet")]
    assert (read_coo(spark, path).to_numpy() == a).all() and len(files) == (1 if "single" in options else 2)
    if "single" in options:
        assert f", {-(-int((a != 0).sum()) // 40)}" in next(line for line in plans[-1].splitlines() if "RepartitionByExpression" in line)
    curve = {"hilbert": W.hilbert, "zorder": W.morton}.get(options.get("cluster_by"))
    for f in files:
        t = pq.ParquetFile(f).read().to_pandas()
        if curve is None:
            assert t[["j", "i"]].apply(tuple, axis=1).is_monotonic_increasing
        else:
            keys = {(r.i, r.j): r.d for r in spark.createDataFrame(t[["i", "j"]].astype("int64")).select("i", "j", curve([F.col("i"), F.col("j")], 6).alias("d")).collect()}
            assert [keys[k] for k in zip(t.i, t.j)] == sorted(keys.values())


@pytest.mark.parametrize("options", [{}, {"grid": (25, 8)}])
def test_cells_are_made_once(spark, a, tmp_path, options):
    """What makes the cells runs once for the values' type, the ranges and the sort; nothing of it is left."""
    made = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            made.add(b.num_rows)
            yield b

    cells = from_numpy(spark, a, ["i", "j"]).rows().mapInArrow(counted, "i long, j long, value double")
    path, shared = str(tmp_path / "once"), spark.conf.get("spark.checkpoint.dir").removeprefix("file://")
    before = {n for n in os.listdir(shared) if n.startswith("cells-")}
    write_coo(CoordArray.from_coo(cells, "value", {"i": range(1, 51), "j": range(1, 9)}), path, ["i", "j"], **options)
    assert made.value == (a != 0).sum() and {n for n in os.listdir(shared) if n.startswith("cells-")} == before
    assert (read_coo(spark, path).to_numpy() == a).all()


@pytest.mark.parametrize("bits", [1, 3, 4, 6, 9, 23])
def test_hilbert_numbers_by_tables_are_those_bit_by_bit(spark, bits):
    """A few looks into a table, in generated code, and no function that is interpreted for each bit and row."""
    from pyspark.sql import functions as F

    from tessera.sources.writer import hilbert

    def number(x, y):
        d = 0
        for b in reversed(range(bits)):
            side, right, up = 1 << b, x >> b & 1, y >> b & 1
            d += side * side * ((3 * right) ^ up)
            x, y = x & side - 1, y & side - 1
            if not up:
                x, y = (side - 1 - y, side - 1 - x) if right else (y, x)
        return d

    r = np.random.default_rng(bits)
    at = [(int(x), int(y)) for x, y in r.integers(0, 2**bits, (300, 2))] + [(2**bits - 1, 0), (2**bits - 1, 2**bits - 1)]
    df = spark.createDataFrame(at, "x long, y int").select("x", "y", hilbert([F.col("x"), F.col("y")], bits).alias("d"))
    assert "aggregate(" not in df._jdf.queryExecution().optimizedPlan().toString()
    assert [tuple(r) for r in df.collect()] == [(x, y, number(x, y)) for x, y in at]


@pytest.mark.parametrize("options", [{"single": True}, {"grid": (25, 8), "cluster_by": "hilbert"}])
def test_sorts_are_of_ranges_and_columns(spark, x, a, tmp_path, monkeypatch, options):
    """The last write sorts by columns, not by an expression: a single file in ranges of 40 rows."""
    from tessera.sources import writer as W

    plans, write = [], type(x.df).write.fget
    monkeypatch.setattr(W, "SORT_ROWS", 40)
    monkeypatch.setattr(type(x.df), "write", property(lambda df: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or write(df)))
    path = str(tmp_path / "d")
    write_coo(x, path, ["i", "j"], **options)
    lines = plans[-1].splitlines()
    sort = next(line for line in lines if "Sort [" in line)
    assert "aggregate(" not in sort and "split(" not in sort and "__curve" not in lines[0]
    if "single" in options:
        assert f", {-(-int((a != 0).sum()) // 40)}" in next(line for line in lines if "RepartitionByExpression" in line)
    assert (read_coo(spark, path).to_numpy() == a).all()
