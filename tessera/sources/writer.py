"""Coordinate tables on disk: partitioned by a grid, sorted, and safely appended to.

Each dimension's place (from 1) is an index column; cells of the grid are partition folders
<index>_group=<g>. A side file holds the schema, the extents and the boxes of grid cells that
have been written, so that arrays without stored cells read back, and appends are held against
it before anything is written.

A write becomes visible in one step. The first one is made in a folder beside the target, which is
then renamed. A slab is written to a staging folder, its partition folders are renamed into
place, and then the next version of the side file is created, which fails if it is there. Readers
take the last whole version and see the grid cells in its boxes only, so a slab without a
version does not exist: the next append to its cells removes what it left. Slabs
with a batch are known by it, so one that is written again is passed over. Two appends at a
time may go to different boxes; of two to the same one, the later fails or both must not run at once.
On stores whose rename is a copy, the steps hold but take longer.

Cells of the grid with many rows are cut into files by ranges of the sort order, by so many tasks; the others
are one file each. Row groups have a fixed number of rows, with minima and maxima of every
page; index columns other than the one that leads the order also get Bloom filters where they are long.
"""

from __future__ import annotations

import itertools
import json
import math
import uuid
from collections.abc import Sequence
from functools import cache
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.array import CoordArray
from ..operators.realize import placed
from ..plans.dims import Dim
from ..session import shared_folder, stored_table

SIDE_FILE = "_tessera.json"
STAGING = "_staging"
#: Rows of a row group; rows of a file of a cell of the grid that has more; bytes that a row group may take meanwhile.
ROW_GROUP_ROWS = 491_520
FILE_ROWS = 8 * ROW_GROUP_ROWS
ROW_GROUP_BYTES = 256 << 20
#: Rows that the task of a single file sorts at once.
SORT_ROWS = 2_000_000
#: So many large grid cells are told to all tasks; if there are more, all cells are dealt by ranges.
HEAVY_CELLS = 100_000
#: Versions of the side file that are kept.
VERSIONS = 20
_INTEGERS = ((127, T.ByteType()), (32767, T.ShortType()), (2**31 - 1, T.IntegerType()), (2**63 - 1, T.LongType()))


def integer_type(largest: int) -> T.DataType:
    """The narrowest signed integer that holds 0 to largest."""
    return next(t for top, t in _INTEGERS if largest <= top)


def _value_stats(v: Column) -> list[Column]:
    return [F.min(v).alias("low"), F.max(v).alias("high"), F.bool_and(v == F.floor(v).cast("double")).alias("entire")]


def _narrowest(kind: T.DataType, low: float | None, high: float | None, entire: bool | None) -> T.DataType:
    if low is None:
        return kind
    if not entire or max(abs(low), abs(high)) >= 2**53:
        return T.DoubleType()
    return integer_type(max(int(high), -int(low) - 1, 0))


def value_type(df: DataFrame, value: str) -> T.DataType:
    """The narrowest type of a value column: integers where all are whole, as 0 is; else its own."""
    kind = df.schema[value].dataType
    if not isinstance(kind, T.NumericType):
        return kind
    return _narrowest(kind, *df.agg(*_value_stats(F.col(value).cast("double"))).first())


def _fs(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def _exists(spark: SparkSession, path: str) -> bool:
    fs, at = _fs(spark, path)
    return fs.exists(at)


def _remove(spark: SparkSession, path: str) -> None:
    fs, at = _fs(spark, path)
    fs.delete(at, True)


def _version(name: str) -> int | None:
    """The version of a side file by its name: 0 for the first."""
    stem, end = SIDE_FILE.rsplit(".", 1)
    if name == SIDE_FILE:
        return 0
    middle = name[len(stem) + 1 : -len(end) - 1]
    return int(middle) if name.startswith(stem + ".") and name.endswith("." + end) and middle.isdigit() else None


def _side_path(path: str, version: int) -> str:
    stem, end = SIDE_FILE.rsplit(".", 1)
    return f"{path}/{SIDE_FILE}" if version == 0 else f"{path}/{stem}.{version}.{end}"


def _versions(spark: SparkSession, path: str) -> list[int]:
    """Versions of the side file, the last one first."""
    fs, at = _fs(spark, path)
    if not fs.exists(at):
        return []
    found = (_version(s.getPath().getName()) for s in fs.listStatus(at))
    return sorted((v for v in found if v is not None), reverse=True)


def side_info(spark: SparkSession, path: str) -> dict[str, Any]:
    """The last whole version of the side file; a version whose writer died in it does not parse and does not count."""
    for version in _versions(spark, path):
        fs, at = _fs(spark, _side_path(path, version))
        stream = fs.open(at)
        try:
            reader = spark._jvm.java.io.BufferedReader(spark._jvm.java.io.InputStreamReader(stream, "UTF-8"))
            text = reader.readLine()
        finally:
            stream.close()
        try:
            return json.loads(text or "") | {"version": version}
        except ValueError:
            continue
    raise ValueError(f"'{path}' lacks {SIDE_FILE}: not a coordinate dataset")


def _write_side(spark: SparkSession, path: str, info: dict[str, Any], version: int) -> bool:
    """Creates a version of the side file; false if it is there."""
    fs, at = _fs(spark, _side_path(path, version))
    try:
        out = fs.create(at, False)
    except Exception as e:
        if "AlreadyExists" in str(e):
            return False
        raise
    out.write(bytearray(json.dumps({k: v for k, v in info.items() if k != "version"}).encode()))
    out.close()
    return True


Box = list[list[int]]  # lowest and highest group of every dimension


def _meet(a: Box, b: Box) -> bool:
    return all(x[0] <= y[1] and y[0] <= x[1] for x, y in zip(a, b, strict=True))


def joined_boxes(boxes: Sequence[Box]) -> list[Box]:
    """The same grid cells in fewer boxes: those that differ in one dimension only, and touch in it, become one."""
    out = sorted([list(x) for x in b] for b in boxes)
    again = True
    while again:
        again = False
        for i, a in enumerate(out):
            for j in range(i + 1, len(out)):
                apart = [d for d, (x, y) in enumerate(zip(a, out[j], strict=True)) if x != y]
                if len(apart) == 1 and a[apart[0]][1] + 1 == out[j][apart[0]][0]:
                    d = apart[0]
                    out[i] = [[x[0], out[j][d][1]] if k == d else x for k, x in enumerate(a)]
                    del out[j]
                    again = True
                    break
            if again:
                break
    return out


def _visible(info: dict[str, Any]) -> Column | None:
    """Which partitions a version of the side file tells of."""
    if not info["groups"] or "boxes" not in info:
        return None
    out = F.lit(False)
    for box in info["boxes"]:
        each = [F.col(g).between(low, high) for g, (low, high) in zip(info["groups"], box, strict=True)]
        inside = each[0]
        for c in each[1:]:
            inside = inside & c
        out = out | inside
    return out


def _folders(fs, folder, column: str) -> list[tuple[int, Any]]:
    """The partition folders of a column in a folder, by group."""
    if not fs.exists(folder):
        return []
    found = [s.getPath() for s in fs.listStatus(folder) if s.isDirectory()]
    return [(int(p.getName().split("=")[1]), p) for p in found if p.getName().startswith(column + "=")]


def _clear(spark: SparkSession, path: str, groups: Sequence[str], box: Box) -> None:
    """Removes the grid cells of a box: what an append left that ended before its version of the side file."""
    fs, at = _fs(spark, path)

    def walk(folder, left: Sequence[str], bounds: Box) -> None:
        for g, p in _folders(fs, folder, left[0]):
            if bounds[0][0] <= g <= bounds[0][1]:
                if len(left) == 1:
                    fs.delete(p, True)
                else:
                    walk(p, left[1:], bounds[1:])

    walk(at, groups, box)


def _publish(spark: SparkSession, staged: str, path: str, groups: Sequence[str]) -> None:
    """Renames the staged partition folders into place, a whole branch at a time where there is none yet."""
    fs, source = _fs(spark, staged)
    _, target = _fs(spark, path)

    def move(folder, to, left: Sequence[str]) -> None:
        for _, p in _folders(fs, folder, left[0]):
            goal = spark._jvm.org.apache.hadoop.fs.Path(to, p.getName())
            if len(left) > 1 and fs.exists(goal):
                move(p, goal, left[1:])
            elif not fs.rename(p, goal):
                raise OSError(f"cannot move {p} to {goal}")

    move(source, target, groups)


def _committed(spark: SparkSession, path: str, info: dict[str, Any], box: Box, dim: Sequence[int], batch: tuple[str, int] | None) -> None:
    """Creates the next version of the side file with a slab in it."""
    while True:
        batches = dict(info.get("batches", {}))
        if batch is not None:
            batches[batch[0]] = batch[1]
        now = info | {"dim": [max(a, b) for a, b in zip(info["dim"], dim, strict=True)], "boxes": joined_boxes([*info["boxes"], box]), "batches": batches}
        versions = _versions(spark, path)
        if _write_side(spark, path, now, versions[0] + 1):
            break
        info = side_info(spark, path)  # another append came first
        if any(_meet(box, b) for b in info["boxes"]):
            raise ValueError("the append would write into an existing partition")
    fs, _ = _fs(spark, path)
    for version in versions[VERSIONS:]:
        fs.delete(_fs(spark, _side_path(path, version))[1], False)


def morton(places: Sequence[Column], bits: int = 20) -> Column:
    """Interleaved bits of places, so that cells near in all dimensions are near in order."""
    out = F.lit(0).cast("long")
    for b in range(min(bits, 62 // len(places))):
        for i, p in enumerate(places):
            bit = F.shiftright(p.cast("long"), b).bitwiseAND(F.lit(1))
            out = out.bitwiseOR(F.shiftleft(bit, b * len(places) + i))
    return out


def hilbert(places: Sequence[Column], bits: int = 31) -> Column:
    """The number of a cell of two places along a Hilbert curve: cells next to each other in order are next to each other in the plane."""
    if len(places) != 2:
        raise ValueError("the Hilbert order is for two dimensions; see 'zorder' for more")
    x, y = (p.cast("long") for p in places)
    out, state, left = F.lit(0).cast("long"), F.lit(0), bits
    while left:
        width = left % HILBERT_BITS or HILBERT_BITS
        left -= width
        column, row = (F.shiftright(v, left).bitwiseAND(F.lit(2**width - 1)).cast("int") for v in (x, y))
        found = F.get(F.split(F.lit(_hilbert_steps(width)), ",").cast("array<int>"), state * 4**width + column * 2**width + row)
        out = F.shiftleft(out, 2 * width).bitwiseOR(F.shiftright(found, 2).cast("long"))
        state = found.bitwiseAND(F.lit(3))
    return out


#: Bits of each place that one look into a table takes.
HILBERT_BITS = 4


@cache
def _hilbert_steps(bits: int) -> str:
    """For each state, and so many bits of both places: the bits of the number, and the state for the bits that follow.

    A state says whether the places are exchanged (1) and whether their bits are turned over (2).
    """
    steps = []
    for state, x, y in itertools.product(range(4), range(2**bits), range(2**bits)):
        number = 0
        for b in reversed(range(bits)):
            right, up = ((v >> b & 1) ^ (state >> 1) for v in (x, y))
            right, up = (up, right) if state & 1 else (right, up)
            number = number << 2 | (3 * right) ^ up
            state ^= 0 if up else 1 | 2 * right
        steps.append(number << 2 | state)
    return ",".join(map(str, steps))


def _checked(x: CoordArray, index: Sequence[str], grid: Sequence[int] | None, max_dim: Any, append: Any, along: Any, offset: Any, group_offset: Any) -> tuple[list[int], int | None]:
    shape = [len(d) for d in x.dims]
    if len(index) != len(shape) or len(set(index)) != len(index):
        raise ValueError("'indexcols' must name every dimension once")
    if grid is not None and (len(grid) != len(shape) or any(not isinstance(g, (int, np.integer)) or g < 1 for g in grid)):
        raise ValueError("'grid' must be a spacing of at least 1 for every dimension")
    if not isinstance(append, bool):
        raise ValueError("'append' must be a single logical")
    if max_dim is not None:
        if len(max_dim) != len(shape) or any(isinstance(m, bool) or not isinstance(m, (int, np.integer)) for m in max_dim):
            raise ValueError("'max_dim' must be NULL or an integer vector with an extent for every dimension")
        if any(m < n for m, n in zip(max_dim, shape, strict=True)):
            raise ValueError("'max_dim' must be >= dim(x)")
    axis = None
    if along is not None:
        if along not in index and not (isinstance(along, (int, np.integer)) and 0 <= along < len(index)):
            raise ValueError("'along' must be a dimension's name or place")
        axis = list(index).index(along) if isinstance(along, str) else int(along)
    elif append and len(index) > 0 and (offset or group_offset):
        raise ValueError("'along' must be given with an offset")
    for name, n in (("offset", offset), ("group_offset", group_offset)):
        if isinstance(n, bool) or not isinstance(n, (int, np.integer)) or n < 0:
            raise ValueError(f"'{name}' must be a single non-negative integer")
    return [int(g) for g in grid] if grid is not None else shape, axis


def write_coo(
    x: CoordArray,
    path: str,
    index: Sequence[str],
    value: str = "value",
    grid: Sequence[int] | None = None,
    suffix: str = "_group",
    type: str | T.DataType | None = None,
    max_dim: Sequence[int] | None = None,
    append: bool = False,
    along: str | int | None = None,
    offset: int = 0,
    group_offset: int = 0,
    cluster_by: str | Sequence[str] | None = None,
    single: bool = False,
    batch: tuple[str, int] | None = None,
    file_rows: int = FILE_ROWS,
    row_group_rows: int = ROW_GROUP_ROWS,
) -> bool:
    """Writes the stored cells of an array filled with zero, without zeros.

    grid: the spacing of the partition grid in each dimension; one cell in all dimensions means
    no partitions. max_dim: extents to come, for the width of index columns. append: adds a slab
    along a dimension, whose places start after offset and whose groups start after group_offset.
    cluster_by: sorts each file by these columns, by "zorder" or, for two dimensions, by "hilbert"; else by the index, the first
    dimension fastest. single: one file. batch: a name and a number that rises with each write; one that the
    dataset has, or a lower one, is passed over. file_rows: rows of a file where a grid cell has more.
    Returns whether anything was written.
    """
    spark = x.spark
    if not x.zero_filled:
        raise ValueError("only arrays filled with zero can be written as coordinates")
    spacing, axis = _checked(x, index, grid, max_dim, append, along, offset, group_offset)
    shape = [len(d) for d in x.dims]
    value = value if value not in index else value + "_"
    extents = [n + (offset if i == axis else 0) for i, n in enumerate(shape)]
    extents = [max(n, m) for n, m in zip(extents, max_dim, strict=True)] if max_dim is not None else extents
    groups = [g + suffix for g in index]
    cut = [s < n for s, n in zip(spacing, shape, strict=True)]
    parted = any(cut) or group_offset > 0
    cells = placed(x.rows("__v").where(F.col("__v") != F.lit(x.zero)), x.dims)
    cells = cells.select(*[(F.col(f"__place_{d.name}") + 1 + (offset if i == axis else 0)).alias(index[i]) for i, d in enumerate(x.dims)], F.col("__v").alias(value))

    if parted:
        for i, g in enumerate(groups):
            first = F.floor((F.col(index[i]) - 1 - (offset if i == axis else 0)) / spacing[i]) + 1
            cells = cells.withColumn(g, (first + (group_offset if i == axis else 0)).cast("int"))
    box = [[1 + (group_offset if i == axis else 0), -(-n // spacing[i]) + (group_offset if i == axis else 0)] for i, n in enumerate(shape)]
    dim = [n + (offset if i == axis else 0) for i, n in enumerate(shape)]

    def checked(info: dict[str, Any]) -> T.StructType:
        held = T.StructType.fromJson(info["schema"])
        if bool(info["groups"]) != parted or info["groups"] not in ([], groups) or not parted:
            raise ValueError("appending needs a hive-partitioned dataset of the same grid columns")
        for name in [*index, value]:
            if name not in held.fieldNames():
                raise ValueError(f"the dataset lacks field '{name}'")
        for i, name in enumerate(index):
            if integer_type(extents[i]).simpleString() != held[name].dataType.simpleString() and _wider(integer_type(extents[i]), held[name].dataType):
                raise ValueError(f"schema mismatch on '{name}': {held[name].dataType.simpleString()} cannot hold {extents[i]}")
        if "boxes" not in info:
            raise ValueError("the dataset does not tell which grid cells it has: write it anew")
        return held

    there = _exists(spark, path)
    info = side_info(spark, path) if there and (append or batch is not None) else None
    if batch is not None and info is not None and info.get("batches", {}).get(batch[0], -1) >= batch[1]:
        return False
    if append and not there:
        raise ValueError("the target directory does not exist")
    if not append and there:
        raise ValueError(f"'{path}' exists")
    held = checked(info) if append else None
    kind = T._parse_datatype_string(type) if isinstance(type, str) else type
    # The cells are made once: they are read for the values' type and each grid cell's rows, for the ranges, and to be sorted.
    kept = f"{shared_folder(spark)}/cells-{uuid.uuid4().hex}"
    cells = stored_table(cells, "cells", kept)
    sizes, number = None, isinstance(cells.schema[value].dataType, T.NumericType)
    if parted:
        stats = _value_stats(F.col(value).cast("double") if number else F.lit(None).cast("double"))
        sizes = stored_table(cells.groupBy(*groups).agg(F.count(F.lit(1)).alias("rows"), *stats), "sizes")
        found = sizes.agg(F.min("low"), F.max("high"), F.bool_and("entire")).first()
        own = _narrowest(cells.schema[value].dataType, *found) if number else cells.schema[value].dataType
    else:
        *found, n_cells = cells.agg(*_value_stats(F.col(value).cast("double") if number else F.lit(None).cast("double")), F.count(F.lit(1))).first()
        own = _narrowest(cells.schema[value].dataType, *found) if number else cells.schema[value].dataType
    if append:
        if type is not None and kind != held[value].dataType or _wider(own, held[value].dataType):
            raise ValueError(f"schema mismatch on '{value}': {own.simpleString()} and {held[value].dataType.simpleString()}")
        if any(_meet(box, b) for b in info["boxes"]):
            raise ValueError("the append would write into an existing partition")
    schema = held or T.StructType([*[T.StructField(n, integer_type(e)) for n, e in zip(index, extents, strict=True)], T.StructField(value, kind or own)])
    typed = cells.select(*[F.col(f.name).cast(f.dataType) for f in schema if f.name in cells.columns], *(groups if parted else []))
    lead = None
    bits = max(1, max(extents)).bit_length()
    if cluster_by in ("zorder", "hilbert"):  # a column, as a sort works an expression out again for each comparison
        curve = morton if cluster_by == "zorder" else hilbert
        typed = typed.withColumn("__curve", curve([F.col(n) for n in index], bits))
        order = [F.col("__curve")]
    else:
        names = [cluster_by] if isinstance(cluster_by, str) else cluster_by or list(reversed(index))
        order, lead = [F.col(n) for n in names], names[0]
    if parted:
        typed = _by_cell(typed, sizes, groups, order, file_rows)
    elif single:
        # sorted range after range, which one task then writes as they come: it never holds more than one of them
        typed = typed.repartitionByRange(max(1, -(-n_cells // SORT_ROWS)), *order).sortWithinPartitions(*order).coalesce(1)
    else:
        typed = typed.repartitionByRange(*order).sortWithinPartitions(*order)
    out = typed.drop("__curve").write.option("compression", "zstd").option("parquet.block.size", ROW_GROUP_BYTES).option("parquet.block.row.count.limit", row_group_rows)
    for name, extent in zip(index, extents, strict=True):
        if name != lead and 8 * extent >= row_group_rows:  # shorter keys are in most row groups, or in their dictionaries
            out = out.option(f"parquet.bloom.filter.enabled#{name}", "true").option(f"parquet.bloom.filter.expected.ndv#{name}", min(extent, row_group_rows))
    out = out.partitionBy(*groups) if parted else out
    token = uuid.uuid4().hex if batch is None else f"{batch[0]}-{batch[1]}"
    if append:
        staged = f"{path}/{STAGING}/{token}"
        out.mode("overwrite").parquet(staged)
        _remove(spark, kept)
        _clear(spark, path, groups, box)
        _publish(spark, staged, path, groups)
        _committed(spark, path, info, box, dim, batch)
        fs, at = _fs(spark, staged)
        fs.delete(at, True)
        return True
    parent, _, name = path.rstrip("/").rpartition("/")
    staged = f"{parent}/_{name}.{token}" if parent or path.startswith("/") else f"_{name}.{token}"
    out.mode("overwrite").parquet(staged)
    _remove(spark, kept)
    side = {"schema": schema.jsonValue(), "index": list(index), "value": value, "groups": groups if parted else [], "dim": dim, "fill": x.zero if not isinstance(x.zero, bool) else bool(x.zero), "boxes": [box], "batches": {} if batch is None else {batch[0]: batch[1]}}
    fs, at = _fs(spark, _side_path(staged, 0))
    fs.delete(at, False)
    _write_side(spark, staged, side, 0)
    _first(spark, staged, path)
    return True


def _first(spark: SparkSession, staged: str, path: str) -> None:
    """Renames a new dataset's folder into place."""
    fs, source = _fs(spark, staged)
    _, target = _fs(spark, path)
    if fs.exists(target) or not fs.rename(source, target):
        raise ValueError(f"'{path}' exists")
    inside = spark._jvm.org.apache.hadoop.fs.Path(target, source.getName())
    if fs.exists(inside):  # another writer's folder came first, and a rename to a folder moves into it
        fs.delete(inside, True)
        raise ValueError(f"'{path}' exists")


def _by_cell(typed: DataFrame, sizes: DataFrame, groups: Sequence[str], order: Sequence[Column], file_rows: int) -> DataFrame:
    """Rows dealt to tasks by grid cell: small cells whole, large ones by ranges of the order, sorted either way."""
    large = sizes.where(F.col("rows") > file_rows)
    found = large.select(*groups, "rows").limit(HEAVY_CELLS + 1).collect()
    if not found:
        return typed.repartition(*groups).sortWithinPartitions(*groups, *order)
    if len(found) > HEAVY_CELLS:
        files = math.ceil(sizes.agg(F.sum("rows")).first()[0] / file_rows)
        return typed.repartitionByRange(files, *groups, *order).sortWithinPartitions(*groups, *order)
    keys = F.broadcast(typed.sparkSession.createDataFrame([tuple(r)[:-1] for r in found], T.StructType([T.StructField(g, T.IntegerType()) for g in groups])))
    files = sum(math.ceil(r["rows"] / file_rows) for r in found)
    few = typed.join(keys, list(groups), "left_anti").repartition(*groups)
    many = typed.join(keys, list(groups), "left_semi").repartitionByRange(files, *groups, *order)
    return few.select(*typed.columns).unionByName(many.select(*typed.columns)).sortWithinPartitions(*groups, *order)


def _wider(a: T.DataType, b: T.DataType) -> bool:
    """Whether values of a may not fit b."""
    rank = ["boolean", "tinyint", "smallint", "int", "bigint", "float", "double"]
    a, b = a.simpleString(), b.simpleString()
    return a != b and (a not in rank or b not in rank or rank.index(a) > rank.index(b))


def write_dense(spark: SparkSession, values: np.ndarray, path: str, index: Sequence[str], **options: Any) -> None:
    """Writes a local array."""
    write_coo(from_numpy(spark, values, index), path, index, **options)


def from_numpy(spark: SparkSession, values: np.ndarray, index: Sequence[str]) -> CoordArray:
    """A local array as coordinates, keyed by place from 1."""
    if not hasattr(values, "shape") or values.ndim != len(index):
        raise ValueError("'x' must be array-like, with a name for every dimension")
    zero = "" if values.dtype.kind in "OU" else values.dtype.type(0)
    at = np.nonzero(values != zero)
    kind = {"b": T.BooleanType(), "i": T.LongType(), "u": T.LongType(), "f": T.DoubleType()}.get(values.dtype.kind, T.StringType())
    schema = T.StructType([*[T.StructField(n, T.LongType()) for n in index], T.StructField("value", kind)])
    held = values[at]
    held = held.astype({"b": bool, "i": np.int64, "u": np.int64, "f": np.float64}.get(values.dtype.kind, object))
    table = pa.table([*(pa.array(i + 1) for i in at), pa.array(held)], names=[*index, "value"])
    df = spark.createDataFrame(table, schema) if len(held) else spark.createDataFrame([], schema)
    return CoordArray.from_coo(df, "value", {n: Dim(n, range(1, s + 1), T.LongType(), None, False) for n, s in zip(index, values.shape, strict=True)})


def read_coo(spark: SparkSession, path: str, dim_tables: dict[str, Any] | None = None) -> CoordArray:
    """The array that write_coo() wrote, also when no cell is stored."""
    info = side_info(spark, path)
    schema = T.StructType.fromJson(info["schema"])
    full = T.StructType([*schema.fields, *[T.StructField(g, T.IntegerType()) for g in info["groups"]]])
    df = spark.read.schema(full).parquet(path)
    visible = _visible(info)
    df = df if visible is None else df.where(visible)
    dims = {n: Dim(n, range(1, d + 1), schema[n].dataType, None, False) for n, d in zip(info["index"], info["dim"], strict=True)}
    return CoordArray.from_coo(df, info["value"], dims, dim_tables=dim_tables)
