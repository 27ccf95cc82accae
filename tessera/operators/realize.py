"""Arrays brought to the driver, and streamed by blocks."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..plans.dims import Dim, small

DTYPES = {"logical": np.bool_, "integer": np.int64, "integer64": np.int64, "double": np.float64, "character": object}


def placed(df: DataFrame, dims: Sequence[Dim]) -> DataFrame:
    """df with the place from 0 of each dimension's key, as __place_<name>."""
    for d in dims:
        at = d.place_of(F.col(d.name))
        if at is not None:
            df = df.withColumn(f"__place_{d.name}", at)
        else:
            df = df.join(small(d.table(df.sparkSession, f"__place_{d.name}"), len(d)), d.name)
    return df


def to_coo(x, limit: int = 50_000_000) -> tuple[np.ndarray, np.ndarray]:
    """Places (a row for each stored cell, a column for each dimension) and values, of at most limit stored cells."""
    table = placed(x.rows(), x.dims).select(*[f"__place_{d.name}" for d in x.dims], "value")
    if x.size > limit and (stored := table.count()) > limit:
        raise ValueError(f"{stored} stored cells are too many for the driver; see apply_blocks()")
    table = table.toPandas()
    coords = np.stack([table[f"__place_{d.name}"].to_numpy(np.int64) for d in x.dims], axis=1)
    values = table["value"]
    kind = DTYPES[x.type]
    if values.isna().any() and x.type != "character":
        kind = np.float64
    order = np.lexsort(coords.T)  # the last dimension is the slowest
    return coords[order], values.to_numpy()[order].astype(kind)


def to_numpy(x, limit: int = 200_000_000) -> np.ndarray:
    """The dense array; missing numbers become NaN. For arrays of at most limit cells."""
    if x.size > limit:
        raise ValueError(f"an array of {x.size} cells is too large to realise; see blocks()")
    coords, values = to_coo(x)
    kind = values.dtype if x.fill_value is not None else np.float64
    out = np.full([len(d) for d in x.dims], np.nan if x.fill_value is None else x.fill_value, dtype=kind if x.type != "character" else object)
    out[tuple(coords.T)] = values
    return out.reshape(x.shape)


def to_csc(x) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Column pointers, row places and values of a matrix filled with zero, without zeros."""
    if len(x.dims) != 2 or not x.zero_filled:
        raise ValueError("only matrices filled with zero have a compressed sparse form")
    coords, values = to_coo(x)
    use = values != x.zero
    coords, values = coords[use], values[use]
    pointers = np.concatenate([[0], np.cumsum(np.bincount(coords[:, 1], minlength=len(x.dims[1])))])
    return pointers, coords[:, 0], values


#: Cells of the dense grid that a partition of streamed blocks stands for, and the most partitions.
STREAM_CELLS, STREAM_PARTS = 1 << 22, 100_000


def block_numbers(dims: Sequence[Dim], spacings: Sequence[int]) -> tuple[Column, list[Column], list[int]]:
    """Of placed() cells: the number of the grid's block (the first dimension is the slowest), the places in it, and how many blocks lie along each dimension."""
    counts = [-(-len(d) // s) for d, s in zip(dims, spacings, strict=True)]
    number, stride = F.lit(0).cast("long"), 1
    for d, s, n in reversed(list(zip(dims, spacings, counts, strict=True))):
        number = number + F.floor(F.col(f"__place_{d.name}") / s).cast("long") * stride
        stride *= max(1, n)
    return number, [F.pmod(F.col(f"__place_{d.name}"), F.lit(s)).cast("long") for d, s in zip(dims, spacings, strict=True)], counts


def each_block(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[pa.Array]]]:
    """Of rows sorted by block (the first column), each block's number and other columns; rows without a first place only say that the block is there."""
    number, held = None, []

    def whole() -> tuple[int, list[pa.Array]]:
        table = pa.Table.from_batches(held).combine_chunks()
        table = table.filter(pc.is_valid(table.column(1)))
        return number, [c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in table.columns[1:]]

    for b in batches:
        if not b.num_rows:
            continue
        numbers = np.asarray(b.column(0))
        edges = [0, *(np.flatnonzero(np.diff(numbers)) + 1), b.num_rows]
        for first, last in zip(edges, edges[1:]):
            if int(numbers[first]) != number:
                if held:
                    yield whole()
                number, held = int(numbers[first]), []
            held.append(b.slice(first, last - first))
    if held:
        yield whole()


def each_stretch(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.Table]:
    """Rows sorted by block (the first column) in stretches of whole blocks: of so many rows, or of the one block that has more."""
    held, n = [], 0
    for b in batches:
        if not b.num_rows:
            continue
        held.append(b)
        n += b.num_rows
        if n >= rows:
            table = pa.Table.from_batches(held)
            numbers = table.column(0).to_numpy()
            cut = int(np.searchsorted(numbers, numbers[-1]))
            if cut:
                yield table.slice(0, cut).combine_chunks()
                held, n = table.slice(cut).to_batches(), len(numbers) - cut
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _corner(number: int, counts: Sequence[int], spacings: Sequence[int]) -> tuple[int, ...]:
    out = []
    for n, s in zip(reversed(counts), reversed(spacings)):
        out.append(number % n * s)
        number //= n
    return tuple(reversed(out))


def _values(column: pa.Array, kind: Any) -> np.ndarray:
    """A block's values; missing numbers make it one of floats."""
    return np.asarray(column.to_numpy(zero_copy_only=False)).astype(np.float64 if column.null_count and kind is not object else kind)


def _dense(extent: Sequence[int], at: Sequence[np.ndarray], values: np.ndarray, fill: Any, kind: Any) -> np.ndarray:
    kind = np.float64 if fill is None and kind is not object else values.dtype if len(values) else kind
    out = np.full(extent, np.nan if fill is None and kind is not object else fill, dtype=kind)
    out[tuple(at)] = values
    return out


def _blocked(x, spacings: Sequence[int], empty: bool) -> tuple[DataFrame, list[int]]:
    """Stored cells with their block's number; with empty, a row for every block besides."""
    number, places, counts = block_numbers(x.dims, spacings)
    cells = placed(x.rows(), x.dims).select(number.alias("block"), *[p.alias(f"at{i}") for i, p in enumerate(places)], "value")
    if empty:
        total = int(np.prod(counts, dtype=object))
        cells = cells.unionByName(x.spark.range(total).withColumnRenamed("id", "block"), allowMissingColumns=True)
    return cells, counts


def blocks(x, spacings: Sequence[int], sparse: bool = False) -> Iterator[tuple[tuple[int, ...], Any]]:
    """Blocks of a regular grid in order, one at a time: the place of each one's corner, and its cells.

    A block is a dense array, or with sparse the places in it (a row for each stored cell) and the values.
    All blocks come from one pass over the cells: these are dealt to partitions by block, and the
    partitions, of bounded extent, come to the driver one after the other.
    """
    shape, d, kind = [len(d) for d in x.dims], len(x.dims), DTYPES[x.type]
    cells, counts = _blocked(x, spacings, False)
    total = int(np.prod(counts, dtype=object))
    if not total:
        return
    parts = max(1, min(total, STREAM_PARTS, max(x.spark.sparkContext.defaultParallelism, -(-x.size // STREAM_CELLS))))
    dealt = cells.repartitionById(parts, F.floor(F.col("block") / (total / parts)).cast("int")) if parts > 1 else cells.coalesce(1)
    schema = "block long, " + ", ".join(f"at{i} array<long>" for i in range(d)) + f", value array<{x.schema_type.simpleString()}>"

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, columns in each_block(batches):
            lists = [pa.ListArray.from_arrays(pa.array([0, len(c)], pa.int32()), c) for c in columns]
            yield pa.RecordBatch.from_arrays([pa.array([number]), *lists], names=["block", *[f"at{i}" for i in range(d)], "value"])

    fill, done = x.fill_value, 0

    def made(number: int, at: list, values: list) -> tuple[tuple[int, ...], Any]:
        corner = _corner(number, counts, spacings)
        extent = [min(s, n - c) for s, n, c in zip(spacings, shape, corner, strict=True)]
        at, values = [np.asarray(a, dtype=np.int64) for a in at], _values(pa.array(values), kind) if values else np.zeros(0, kind)
        return corner, ((np.stack(at, axis=1), values) if sparse else _dense(extent, at, values, fill, kind))

    for r in dealt.sortWithinPartitions("block").mapInArrow(packed, schema).toLocalIterator():
        while done < r["block"]:
            yield made(done, [[]] * d, [])
            done += 1
        yield made(r["block"], [r[f"at{i}"] for i in range(d)], r["value"])
        done += 1
    while done < total:
        yield made(done, [[]] * d, [])
        done += 1


def apply_blocks(x, spacings: Sequence[int], fn, schema: str, sparse: bool = False, empty: bool = True) -> DataFrame:
    """fn(corner, block) -> pandas frame, run on the executors for every block of a regular grid, empty ones too unless told otherwise.

    A block is as in blocks(). A task holds one block at a time.
    """
    shape, d = [len(d) for d in x.dims], len(x.dims)
    fill, kind = x.fill_value, DTYPES[x.type]
    cells, counts = _blocked(x, spacings, empty)
    spacings = list(spacings)
    arrow = to_arrow_schema(T._parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, columns in each_block(batches):
            corner = _corner(number, counts, spacings)
            at, values = [np.asarray(c) for c in columns[:d]], _values(columns[d], kind)
            extent = [min(s, n - c) for s, n, c in zip(spacings, shape, corner, strict=True)]
            out = fn(corner, (np.stack(at, axis=1), values) if sparse else _dense(extent, at, values, fill, kind))
            yield from pa.Table.from_pandas(out[arrow.names], arrow, preserve_index=False).to_batches()

    return cells.repartition("block").sortWithinPartitions("block").mapInArrow(run, schema)


def block_cells(x, spacings: Sequence[int], form: str, name: str = "value") -> DataFrame:
    """The cells of an array's local forms, made block by block on the executors: places p0, p1, ... and the value.

    form: "coo" and "csc" hold a block's stored cells as places, or as columns' pointers, rows and values; "dense" holds all
    cells, and blocks without a stored one too, unless the array is filled with zero: then cells of zero are left out.
    """
    d, zero = len(x.dims), x.zero_filled
    if form == "csc" and (d != 2 or not zero):
        raise ValueError("only matrices filled with zero have a compressed sparse form")

    def table(places: np.ndarray, corner: tuple[int, ...], values: np.ndarray) -> pd.DataFrame:
        return pd.DataFrame({**{f"p{i}": places[:, i] + corner[i] for i in range(d)}, name: values.astype(np.float64)})

    def coo(corner: tuple[int, ...], block: tuple[np.ndarray, np.ndarray]) -> pd.DataFrame:
        places, values = block
        order = np.lexsort(places.T)  # the last dimension is the slowest
        return table(places[order], corner, values[order])

    def csc(corner: tuple[int, ...], block: tuple[np.ndarray, np.ndarray]) -> pd.DataFrame:
        places, values = block
        order = np.lexsort(places.T)
        order = order[values[order] != 0]
        pointers, rows, values = np.concatenate([[0], np.cumsum(np.bincount(places[order, 1], minlength=spacings[1]))]), places[order, 0], values[order]
        return table(np.stack([rows, np.repeat(np.arange(spacings[1]), np.diff(pointers))], axis=1), corner, values)

    schema = ", ".join([*[f"p{i} long" for i in range(d)], f"{name} double"])
    if form != "dense":
        return apply_blocks(x, spacings, {"coo": coo, "csc": csc}[form], schema, sparse=True, empty=False)
    cells, counts = _blocked(x, spacings, not zero)
    stacks = _dense_stacks([len(q) for q in x.dims], list(spacings), counts, x.fill_value, DTYPES[x.type], zero, name)
    return cells.repartition("block").sortWithinPartitions("block").mapInArrow(stacks, schema)


#: Cells of the dense blocks that are made at once, one block at least; stored cells that are taken at once.
STACK_CELLS, STACK_ROWS = 1 << 21, 1 << 17


def compact_stacks(number: np.ndarray, i: np.ndarray, j: np.ndarray) -> Iterator[tuple]:
    """Stacks of blocks, dense in the rows and columns that a block has cells in: below each other, as wide as the widest. Cells are sorted by block.

    Of each stack: its cells, as a slice; the row and column of each cell in it; each cell's and each row's block,
    counted from the stack's first; the rows' places in their block; the blocks' numbers; and the width.
    """
    at = np.r_[True, np.diff(number) != 0]
    block, starts = np.cumsum(at) - 1, np.r_[np.flatnonzero(at), len(number)]
    extent = [int(x.max()) + 1 for x in (i, j)]
    (rows, r), (cols, c) = (np.unique(block * n + x, return_inverse=True) for x, n in zip((i, j), extent, strict=True))
    row_first, col_first = (np.searchsorted(x // n, np.arange(len(starts))) for x, n in zip((rows, cols), extent, strict=True))
    width, first = np.diff(col_first), 0
    most = STACK_CELLS // int(width.max())
    while first < len(width):
        last = max(first + 1, int(np.searchsorted(row_first, row_first[first] + most, "right")) - 1)
        cells, top = slice(starts[first], starts[last]), row_first[first]
        part = rows[top : row_first[last]]
        yield cells, r[cells] - top, c[cells] - col_first[block[cells]], block[cells] - first, part // extent[0] - first, part % extent[0], number[starts[first:last]], int(width[first:last].max())
        first = last


def _compact_cells(spacings: list[int], counts: list[int], kind: Any, name: str):
    """Stored cells of a matrix filled with zero, sorted by block, to the cells of dense blocks that are not zero, many blocks at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in each_stretch(batches, STACK_ROWS):
            number, i, j = (c.to_numpy() for c in table.columns[:3])
            values = _values(table.column(3), kind)
            for cells, r, c, of, row_of, row, numbers, wide in compact_stacks(number, i, j):
                cols = np.zeros((len(numbers), wide), np.int64)
                cols[of, c] = j[cells]
                stack = _dense([len(row), wide], (r, c), values[cells], 0, kind)
                x, y = np.nonzero(stack)
                corners = np.unravel_index(numbers[row_of[x]], counts)
                places = (corners[0] * spacings[0] + row[x], corners[1] * spacings[1] + cols[row_of[x], y])
                yield pa.RecordBatch.from_arrays([*map(pa.array, places), pa.array(stack[x, y].astype(np.float64))], names=["p0", "p1", name])

    return run


def _dense_stacks(shape: list[int], spacings: list[int], counts: list[int], fill: Any, kind: Any, zero: bool, name: str):
    """Stored cells, sorted by block, to the cells of dense blocks, many blocks at a time; without zeros for an array filled with zero."""
    if zero and len(shape) == 2:
        return _compact_cells(spacings, counts, kind, name)
    per = max(1, STACK_CELLS // max(1, int(np.prod(spacings, dtype=object))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in each_stretch(batches, STACK_ROWS):
            numbers = table.column(0).to_numpy()
            starts = np.flatnonzero(np.r_[True, np.diff(numbers) != 0])
            for first in range(0, len(starts), per):
                a, z = starts[first], starts[first + per] if first + per < len(starts) else len(numbers)
                part, found = table.slice(a, z - a), numbers[starts[first : first + per]]
                part = part.filter(pc.is_valid(part.column(1)))  # rows without a place only say that the block is there
                at = [np.searchsorted(found, part.column(0).to_numpy()), *[c.to_numpy() for c in part.columns[1:-1]]]
                stack = _dense([len(found), *spacings], at, _values(part.column(part.num_columns - 1), kind), fill, kind)
                corners = np.unravel_index(found, counts)
                where = np.nonzero(stack) if zero else tuple(i.ravel() for i in np.indices(stack.shape))
                places = [corners[i][where[0]] * s + where[i + 1] for i, s in enumerate(spacings)]
                inside = np.all([p < n for p, n in zip(places, shape, strict=True)], axis=0)  # the last blocks of a dimension may be shorter
                columns = [*[p[inside] for p in places], stack[where][inside].astype(np.float64)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=[*[f"p{i}" for i in range(len(shape))], name])

    return run


def block_totals(x, spacings: Sequence[int]) -> DataFrame:
    """A row for each block of a regular grid: its corner p0, p1, ..., its number of cells, and the sum of all of them, by one aggregation of stored cells.

    Cells that are not stored come in by their number, so blocks may have any size and number.
    """
    number, _, counts = block_numbers(x.dims, spacings)
    stored = placed(x.rows(), x.dims).groupBy(number.alias("block")).agg(F.sum(F.col("value").cast("double")).alias("sum"), F.count(F.lit(1)).alias("stored"))
    every = x.spark.range(int(np.prod(counts, dtype=object))).withColumnRenamed("id", "block")
    corners, extent, stride = [], F.lit(1).cast("long"), 1
    for d, s, n in reversed(list(zip(x.dims, spacings, counts, strict=True))):
        corner = (F.floor(F.col("block") / stride).cast("long") % max(1, n)) * s
        corners.insert(0, corner)
        extent = extent * F.least(F.lit(s).cast("long"), F.lit(len(d)).cast("long") - corner)
        stride *= max(1, n)
    out = every.join(stored, "block", "left").select(*[c.alias(f"p{i}") for i, c in enumerate(corners)], extent.alias("cells"), F.coalesce("sum", F.lit(0.0)).alias("sum"), F.coalesce("stored", F.lit(0)).alias("stored"))
    return out.withColumn("total", F.col("sum") + x.fill.cast("double") * (F.col("cells") - F.col("stored"))).drop("sum", "stored")
