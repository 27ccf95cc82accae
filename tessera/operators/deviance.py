"""Row deviances of count matrices from a constant-rate model, for choosing features."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import numeric as N
from ..plans.dims import spread_join
from ..session import narrow_rows, stored_table
from .matrix import sides
from .realize import STACK_ROWS, block_numbers, compact_stacks, each_stretch, placed

FAMILIES = ("binomial", "poisson")


def row_deviances(x, family: str = "binomial", name: str = "value") -> DataFrame:
    """The rows' keys and deviances; rows without cells have 0.

    The logarithms of a cell's expected count split into parts of its row, its column and the
    whole, so the cells meet their column's sum only, and one aggregation by row does the rest;
    the totals are a scalar subquery. Nothing passes through the driver.
    """
    if family not in FAMILIES:
        raise ValueError(f"family must be one of {FAMILIES}")
    row, col = sides(x)
    cells = x.rows("__v").select(row.name, col.name, N.number(F.col("__v")).alias("x")).where(F.col(row.name).isNotNull() & F.col(col.name).isNotNull() & (F.col("x") != 0))
    per_col = cells.groupBy(col.name).agg(F.sum("x").alias("n")).where("n <> 0")
    x_, n = F.col("x"), F.col("n")
    ln = lambda v: F.ln(F.when(v > 0, v))
    term = lambda v: F.when((v > 0) & (n > 0), v * ln(v / n)).otherwise(0.0)
    some = lambda v: F.when((v > 0) & (n > 0), v).otherwise(0.0)
    joined = spread_join(cells, per_col, [col.name], len(col), "inner")
    if family == "poisson":
        # sizes are exp(ln n - m), with m the mean of ln n over the columns
        each = joined.groupBy(row.name).agg(F.sum("x").alias("g"), F.sum(term(x_)).alias("s"), F.sum(some(x_)).alias("w"))
        mean = per_col.agg(F.struct(F.avg(ln(n)).alias("m"), F.sum("n").alias("t"))).scalar()
        each = each.withColumn("of", mean)
        g, all_ = F.col("g"), F.col("of.t") * F.exp(-F.col("of.m"))
        null = F.when((g > 0) & (all_ > 0), g * ln(g / F.when(all_ > 0, all_))).otherwise(0.0)
        out = each.select(row.name, (2 * (F.col("s") + F.col("w") * F.col("of.m") - null)).alias("d"))
    else:
        left = n - x_
        sums = {"g": F.sum("x"), "seen": F.sum("n"), "s": F.sum(term(x_)), "w": F.sum(some(x_)), "s_left": F.sum(term(left)), "w_left": F.sum(some(left))}
        each = joined.groupBy(row.name).agg(*[v.alias(k) for k, v in sums.items()])
        each = each.withColumn("t", per_col.agg(F.sum("n")).scalar()).withColumn("p", F.col("g") / F.col("t"))
        p = F.col("p")
        hit = F.when(p > 0, F.col("s") - F.col("w") * ln(p)).otherwise(0.0)
        # columns without a cell in the row each add n * ln(1 / (1 - p))
        miss = F.when(p < 1, F.col("s_left") - (F.col("w_left") + F.col("t") - F.col("seen")) * ln(1 - p)).otherwise(0.0)
        out = each.select(row.name, (2 * (hit + miss)).alias("d"))
    levels = row.table(x.spark).select(row.name)
    return levels.join(out, row.name, "left").select(row.name, F.coalesce(F.when(~F.isnan("d"), F.col("d")), F.lit(0.0)).alias(name))


def block_row_deviances(x, family: str = "binomial", spacing: int | tuple[int, int] | None = None, name: str = "value", as_sparse: bool = True, block_bytes: int = 64 << 20) -> DataFrame:
    """The same, block by block of a grid in both dimensions, worked out on the executors.

    spacing: rows and columns of a block, or its columns; the rest follows from block_bytes, so that a dense
    block with its work arrays takes no more. as_sparse: blocks hold stored cells only; else they are dense in the rows
    and columns that have a cell in them. Cells come with their column's sum by a join, logarithms of a row's sum are
    split off and come in with the row, and what a row has outside its blocks' columns follows from their sums, so
    blocks without a cell cost nothing. Nothing goes through the driver. A row's terms are added up over the blocks.
    """
    if family not in FAMILIES:
        raise ValueError(f"family must be one of {FAMILIES}")
    row, col = sides(x)
    if spacing is None or isinstance(spacing, int):
        cols = min(len(col), spacing or 1000) or 1
        spacing = (max(1, min(len(row), block_bytes // (64 * cols))), cols)
    elif spacing[0] * spacing[1] * 64 > block_bytes and not as_sparse:
        raise ValueError(f"a block of {spacing[0]} by {spacing[1]} cells takes more than {block_bytes} bytes")
    cells = x.rows("__v").select(row.name, col.name, N.number(F.col("__v")).alias("v")).where(F.col("v") != 0)
    cells = stored_table(cells, "counts")  # read for the columns' sums and again for the blocks
    n = cells.groupBy(col.name).agg(F.sum("v").alias("n")).where("n > 0")
    # the whole's total and the mean logarithm of library sizes: one row
    whole = n.agg(F.struct(F.sum("n").alias("t"), F.avg(F.ln("n")).alias("m"))).scalar()
    cells = placed(spread_join(cells, n, [col.name], len(col), "inner"), (row, col))
    number, (i, j), counts = block_numbers((row, col), spacing)
    dealt = cells.select(number.alias("block"), i.alias("i"), j.alias("j"), "v", "n").repartition("block").sortWithinPartitions("block")
    names = ["g", "s", "w", *(["s_left", "w_left", "seen"] if family == "binomial" else [])]
    parts = dealt.mapInArrow(_block_terms(spacing[0], counts[1], names, as_sparse), "__place long, " + ", ".join(f"{c} double" for c in names))
    with narrow_rows(x.spark):
        sums = stored_table(parts.groupBy("__place").agg(*[F.sum(c).alias(c) for c in names]), "terms")
    sums = sums.withColumn("of", whole)
    ln = lambda v: F.ln(F.when(v > 0, v))
    if family == "poisson":  # sizes are exp(ln n - m), with m the mean of ln n over the columns
        g, sizes = F.col("g"), F.col("of.t") * F.exp(-F.col("of.m"))
        d = F.col("s") + F.col("w") * F.col("of.m") - F.when(g > 0, g * ln(g / sizes)).otherwise(0.0)
    else:
        p = F.col("g") / F.col("of.t")
        hit = F.when(p > 0, F.col("s") - F.col("w") * ln(p)).otherwise(0.0)
        # columns without a cell in the row each add n * ln(1 / (1 - p))
        d = hit + F.when(p < 1, F.col("s_left") - (F.col("w_left") + F.col("of.t") - F.col("seen")) * ln(1 - p)).otherwise(0.0)
    sums = sums.select("__place", (2 * d).alias("d"))
    levels = placed(row.table(x.spark).select(row.name), [row])
    return levels.join(sums, levels[f"__place_{row.name}"] == sums["__place"], "left").select(row.name, F.coalesce(F.when(~F.isnan("d"), F.col("d")), F.lit(0.0)).alias(name))


def _terms(v: np.ndarray, n: np.ndarray, many: int) -> list[np.ndarray]:
    """What each cell adds to its row's g, s, w, s_left, w_left and seen, the first so many of them."""

    def both(x: np.ndarray) -> list[np.ndarray]:
        use = (x > 0) & (n > 0)
        log = np.zeros(x.shape)
        there = use & (x != n)  # the others' logarithm is 0: of a dense block's empty cells too
        log[there] = x[there] * np.log(x[there] / n[there])
        return [log, np.where(use, x, 0.0)]

    return [v, *both(v), *(both(n - v) if many > 3 else []), n][:many]


def _block_terms(rows: int, across: int, names: list[str], as_sparse: bool):
    """Cells (block, i, j, v, n), sorted by block, to the sums of each block's rows, for many blocks at once."""

    def batch(place: np.ndarray, sums: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(place), *[pa.array(x) for x in sums]], names=["__place", *names])

    def sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            number, i, _, v, n = (np.asarray(c.to_numpy(zero_copy_only=False)) for c in b.columns)
            place, cell = np.unique(number // across * rows + i, return_inverse=True)
            yield batch(place, np.stack([np.bincount(cell, t, len(place)) for t in _terms(v, n, len(names))]))

    def dense(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in each_stretch(batches, STACK_ROWS):
            number, i, j, v, n = (c.to_numpy() for c in table.columns)
            for cells, r, c, of, row_of, row, numbers, wide in compact_stacks(number, i, j):
                stack, of_col = np.zeros((len(row), wide)), np.zeros((len(numbers), wide))
                stack[r, c], of_col[of, c] = v[cells], n[cells]
                yield batch(numbers[row_of] // across * rows + row, np.stack([t.sum(axis=1) for t in _terms(stack, of_col[row_of], len(names))]))

    return sparse if as_sparse else dense


def sparse_row_deviances(pointers: np.ndarray, rows: np.ndarray, values: np.ndarray, n_rows: int, family: str = "binomial") -> np.ndarray:
    """The same for a local matrix in compressed sparse columns, from its stored cells alone."""
    if family not in FAMILIES:
        raise ValueError(f"family must be one of {FAMILIES}")
    values = np.asarray(values, dtype=np.float64)
    cols = np.repeat(np.arange(len(pointers) - 1), np.diff(pointers))
    n, g = np.bincount(cols, values, len(pointers) - 1), np.bincount(rows, values, n_rows)
    keep = n > 0
    with np.errstate(divide="ignore", invalid="ignore"):
        term = lambda x, e: np.where(x > 0, x * np.log(x / e), 0.0)
        if family == "poisson":
            size = np.where(keep, np.exp(np.log(np.where(keep, n, 1)) - np.log(n[keep]).mean()) if keep.any() else 0.0, 0.0)
            out = 2 * (np.bincount(rows, term(values, size[cols]), n_rows) - term(g, size.sum()))
        else:
            p = g / max(n.sum(), 1e-300)
            expected = n[cols] * p[rows]
            cell = term(values, expected) + term(n[cols] - values, n[cols] - expected)
            # cells that are not stored each add n * ln(1 / (1 - p))
            left = n.sum() - np.bincount(rows, n[cols], n_rows)
            out = 2 * (np.bincount(rows, cell, n_rows) + np.where(left > 0, left * np.log(1 / (1 - p)), 0.0))
    return np.nan_to_num(out, nan=0.0)


def dense_row_deviances(counts: np.ndarray, family: str = "binomial") -> np.ndarray:
    """The same for a local dense matrix."""
    if family not in FAMILIES:
        raise ValueError(f"family must be one of {FAMILIES}")
    counts = np.asarray(counts, dtype=np.float64)
    n = counts.sum(axis=0)
    counts, n = counts[:, n > 0], n[n > 0]
    with np.errstate(divide="ignore", invalid="ignore"):
        term = lambda x, e: np.where(x > 0, x * np.log(x / e), 0.0)
        if family == "poisson":
            size = np.exp(np.log(n) - np.log(n).mean())
            g = counts.sum(axis=1)
            out = 2 * (term(counts, size).sum(axis=1) - term(g, size.sum()))
        else:
            expected = n * (counts.sum(axis=1) / max(n.sum(), 1e-300))[:, None]
            out = 2 * (term(counts, expected) + term(n - counts, n - expected)).sum(axis=1)
    return np.nan_to_num(out, nan=0.0)
