"""Writes that end half way, that run twice, and that meet; large grid cells; row groups."""

import glob
import os
import shutil

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tessera.operators.array import CoordArray
from tessera.sources import writer as W
from tessera.sources.writer import from_numpy, joined_boxes, read_coo, side_info, write_coo
from tessera.streaming.append import append_slabs


class Killed(Exception):
    pass


@pytest.fixture(scope="module")
def a():
    return np.random.default_rng(1).integers(0, 5, (6, 12))


def slab(spark, a, k):
    return from_numpy(spark, a[:, 4 * k : 4 * k + 4], ["i", "j"])


def put(spark, a, path, k, **options):
    return write_coo(slab(spark, a, k), path, ["i", "j"], grid=(3, 2), append=k > 0, along="j", offset=4 * k, group_offset=2 * k, max_dim=(6, 12), **options)


def dies(monkeypatch, name, when=lambda *a: True, after=False):
    """The step of that name runs (or not) and then the job is gone."""
    step = getattr(W, name)

    def run(*args):
        if when(*args):
            if after:
                step(*args)
            raise Killed(name)
        return step(*args)

    monkeypatch.setattr(W, name, run)


@pytest.mark.parametrize(("name", "after"), [("_clear", False), ("_publish", False), ("_publish", True), ("_committed", False), ("_write_side", False)])
def test_an_append_that_dies_does_not_exist_and_can_be_made_again(spark, a, tmp_path, monkeypatch, name, after):
    path = str(tmp_path / "d")
    put(spark, a, path, 0)
    with monkeypatch.context() as m:
        dies(m, name, after=after)
        with pytest.raises(Killed):
            put(spark, a, path, 1)
    assert (read_coo(spark, path).to_numpy() == a[:, :4]).all() and side_info(spark, path)["dim"] == [6, 4]
    assert put(spark, a, path, 1)
    assert (read_coo(spark, path).to_numpy() == a[:, :8]).all()
    put(spark, a, path, 2)
    assert (read_coo(spark, path).to_numpy() == a).all() and side_info(spark, path)["boxes"] == [[[1, 2], [1, 6]]]
    with pytest.raises(ValueError, match="existing partition"):
        put(spark, a, path, 1)


def test_half_a_move_and_half_a_side_file_are_not_seen(spark, a, tmp_path, monkeypatch):
    path = str(tmp_path / "d")
    put(spark, a, path, 0)
    other = a.copy()
    other[:3, 4:8] = 9  # an append of other data to the same cells, which ends after one folder

    def half(spark, staged, path, groups):
        one = sorted(glob.glob(f"{staged}/i_group=1/j_group=*"))[0]
        shutil.move(one, f"{path}/i_group=1/")
        raise Killed

    with monkeypatch.context() as m:
        m.setattr(W, "_publish", half)
        with pytest.raises(Killed):
            put(spark, other, path, 1)
    assert (read_coo(spark, path).to_numpy() == a[:, :4]).all()
    with open(f"{path}/_tessera.1.json", "w") as f:
        f.write('{"schema": {"fields"')  # its writer died in it
    assert side_info(spark, path)["version"] == 0
    a2 = a.copy()
    a2[:3, 4:6] = 0  # nothing goes to the cell that was left
    put(spark, a2, path, 1)
    assert (read_coo(spark, path).to_numpy() == a2[:, :8]).all() and side_info(spark, path)["version"] == 2


def test_a_first_write_that_dies_leaves_no_dataset(spark, a, tmp_path, monkeypatch):
    path = str(tmp_path / "d")
    for name in ("_write_side", "_first"):
        with monkeypatch.context() as m:
            dies(m, name)
            with pytest.raises(Killed):
                put(spark, a, path, 0)
        assert not os.path.exists(path)
    put(spark, a, path, 0)
    assert (read_coo(spark, path).to_numpy() == a[:, :4]).all()


def test_a_batch_is_written_once(spark, a, tmp_path):
    path = str(tmp_path / "d")
    assert put(spark, a, path, 0, batch=("s", 0)) and not put(spark, a, path, 0, batch=("s", 0))
    assert put(spark, a, path, 1, batch=("s", 1)) and not put(spark, a, path, 1, batch=("s", 1)) and not put(spark, a, path, 1, batch=("s", 0))
    assert put(spark, a, path, 2, batch=("other", 0))
    assert (read_coo(spark, path).to_numpy() == a).all() and side_info(spark, path)["batches"] == {"s": 1, "other": 0}


def test_two_appends_at_a_time(spark, a, tmp_path, monkeypatch):
    """The one that comes second takes the other's slab along, unless both have the same cells."""
    write = W._write_side
    for first, error in ((2, None), (1, "existing partition")):
        path, other = str(tmp_path / f"d{first}"), []
        put(spark, a, path, 0)

        def late(*args, path=path, other=other, first=first):
            if not other:
                other.append(1)
                put(spark, a, path, first)
            return write(*args)

        with monkeypatch.context() as m:
            m.setattr(W, "_write_side", late)
            if error:
                with pytest.raises(ValueError, match=error):
                    put(spark, a, path, 1)
            else:
                put(spark, a, path, 1)
        assert (read_coo(spark, path).to_numpy() == a[:, : 8 if error else 12]).all()


def test_boxes(spark):
    boxes = [[[1, 2], [5, 6]], [[1, 2], [1, 4]], [[3, 3], [1, 4]], [[3, 3], [5, 6]], [[9, 9], [1, 1]]]
    assert joined_boxes(boxes) == [[[1, 3], [1, 6]], [[9, 9], [1, 1]]] and joined_boxes([]) == []


def stream(spark, source, path, checkpoint):
    read = spark.readStream.schema("i long, j long, v double").option("maxFilesPerTrigger", 1).parquet(source)
    query = append_slabs(read, path, ["i", "j"], "v", "j", 4, (6, 4)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination(120)


def test_a_stream_goes_on_after_it_dies_and_after_a_replay(spark, a, tmp_path, monkeypatch):
    source, path, checkpoint = (str(tmp_path / n) for n in ("in", "out", "ck"))
    for k in range(3):
        slab(spark, a, k).rows("v").selectExpr("i", "j", "CAST(v AS double) AS v").coalesce(1).write.mode("append").parquet(source)
    # the files' order is the stream's, so compare sums of slabs
    with monkeypatch.context() as m:
        dies(m, "_committed", lambda spark, path, info, box, dim, batch: batch[1] == 1)
        with pytest.raises(Exception, match="_committed"):
            stream(spark, source, path, checkpoint)
    assert read_coo(spark, path).shape == (6, 4)
    stream(spark, source, path, checkpoint)
    got = read_coo(spark, path).to_numpy()
    assert got.shape == (6, 12) and sorted(got[:, 4 * k : 4 * k + 4].sum() for k in range(3)) == sorted(a[:, 4 * k : 4 * k + 4].sum() for k in range(3))
    os.remove(f"{checkpoint}/commits/2")  # it died after the slab, before its own mark
    for crc in glob.glob(f"{checkpoint}/commits/.2.crc"):
        os.remove(crc)
    stream(spark, source, path, checkpoint)
    assert (read_coo(spark, path).to_numpy() == got).all()


def test_a_large_grid_cell_is_written_by_many_tasks(spark, tmp_path):
    path = str(tmp_path / "d")
    rows = spark.range(20_000).select((F.when(F.col("id") < 18_000, F.col("id") % 50).otherwise(50 + F.col("id") % 150) + 1).alias("i"), F.floor(F.col("id") / 50 + 1).cast("long").alias("j"), F.lit(2).alias("v"))
    x = CoordArray.from_coo(rows, "v", {"i": range(1, 201), "j": range(1, 401)})
    write_coo(x, path, ["i", "j"], grid=(50, 400), file_rows=3000)
    files = {g: sorted(glob.glob(f"{path}/i_group={g}/j_group=1/*.parquet")) for g in range(1, 5)}
    assert len(files[1]) >= 5 and all(len(files[g]) == 1 for g in (2, 3, 4))
    spans = []
    for f in files[1]:
        t = pq.read_table(f, partitioning=None).to_pydict()
        keys = list(zip(t["j"], t["i"]))
        assert keys == sorted(keys) and len(keys) < 9000
        spans.append((keys[0], keys[-1]))
    spans.sort()
    assert all(x[1] < y[0] for x, y in zip(spans, spans[1:]))
    back = read_coo(spark, path)
    assert back.df.count() == 20_000 and back.row_sums().agg(F.sum("value")).first()[0] == 40_000


def scanned(df):
    """Rows that a plan's scan handed on: whole row groups, less pages that their index rules out."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    return plan.collectLeaves().apply(0).metrics().apply("numOutputRows").value()


def test_row_groups_are_read_by_either_key(spark, tmp_path):
    """A row's cells come from one row group, by minima and maxima of the leading key or by a Bloom filter of the other."""
    path = str(tmp_path / "d")
    # row i has cells in ten columns next to each other only, and row numbers are far apart and in no order
    rows = spark.range(200_000).select((F.pmod(F.xxhash64(F.floor(F.col("id") / 10)), F.lit(5_000_000)) + 1).alias("i"), (F.col("id") + 1).alias("j"), F.lit(1).alias("v"))
    x = CoordArray.from_coo(rows, "v", {"i": range(1, 5_000_001), "j": range(1, 200_001)})
    write_coo(x, path, ["i", "j"], single=True, row_group_rows=10_000)
    (file,) = glob.glob(f"{path}/*.parquet")
    meta = pq.ParquetFile(file).metadata
    assert meta.num_row_groups == 20 and all(meta.row_group(i).num_rows == 10_000 for i in range(20))
    back = read_coo(spark, path)
    some = rows.where("id = 77777").first()
    by_row, by_col = back[[some.i - 1], :].rows(), back[:, [77_777]].rows()
    assert by_col.count() == 1 and scanned(by_col) <= 10_000
    assert by_row.count() >= 10 and scanned(by_row) <= 10_000
    absent = next(i for i in range(1, 100) if not rows.where(F.col("i") == i).head(1))
    assert scanned(back[[absent - 1], :].rows()) == 0
