"""Truncated decompositions of lazy matrices by block Lanczos steps.

The matrix is never squared and never made dense: a step applies it and its transpose to a
block of a few vectors in one pass over stored columns, and the means of rows are subtracted
from the block afterwards (implicit centring). Tasks send their parts of the new block by
stretches of rows, which a second stage adds up; the driver holds blocks as tall as the
matrix and as wide as the number of vectors asked for, whose bytes are checked.

A matrix with few columns, and more rows, is decomposed by the square of its columns instead, to
which each row, less its mean, adds its part on the executors: nothing as tall as the matrix reaches the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stored_table
from .matrix import CoordMatrix, _cells, _keyed, _placed, matmul, sides

#: Bytes of basis and images that the driver may hold.
DRIVER_BYTES = 1 << 30
STRETCH = 1024
#: Cells that a task multiplies at a time.
CELLS = 1 << 18
#: Up to so many columns their square is decomposed on the driver.
SQUARE_COLS = 1024
#: Singular values below this part of the largest count as zero where a square was decomposed.
NOTHING = 1e-7


def _applied(q, n_rows: int):
    """Packed columns (rs, vs) to stretches of X (t(X) q): (stretch, values)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = q.value
        width = block.shape[1]
        total, touched = np.zeros((n_rows, width)), np.zeros(n_rows, bool)
        for b in batches:
            offsets = np.asarray(b.column(0).offsets, dtype=np.int64)
            rows, values = (np.asarray(b.column(i).values)[offsets[0] : offsets[-1]] for i in (0, 1))
            offsets = offsets - offsets[0]
            at = 0
            while at < b.num_rows:
                to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + CELLS, "right")) - 1)
                r, v = rows[offsets[at] : offsets[to]], values[offsets[at] : offsets[to]]
                col = np.repeat(np.arange(to - at), np.diff(offsets[at : to + 1]))
                for i in range(width):
                    z = np.bincount(col, v * block[r, i], to - at)
                    total[:, i] += np.bincount(r, v * z[col], n_rows)
                touched[r] = True
                at = to
        for first in range(0, n_rows, STRETCH):
            if touched[first : first + STRETCH].any():
                part = total[first : first + STRETCH].ravel()
                yield pa.RecordBatch.from_arrays([pa.array([first]), pa.array([part], pa.list_(pa.float64()))], names=["first", "part"])

    return run


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stretches, sorted, to their sums."""
    now, total = None, None
    for b in batches:
        for i, first in enumerate(b.column(0).to_pylist()):
            part = np.asarray(b.column(1)[i].values)
            if first != now:
                if now is not None:
                    yield pa.RecordBatch.from_arrays([pa.array([now]), pa.array([total], pa.list_(pa.float64()))], names=["first", "part"])
                now, total = first, part.copy()
            else:
                total += part
    if now is not None:
        yield pa.RecordBatch.from_arrays([pa.array([now]), pa.array([total], pa.list_(pa.float64()))], names=["first", "part"])


class Operator:
    """q -> (X - m 1')(X - m 1')' q, for a matrix with its columns packed in a stored table."""

    def __init__(self, x: CoordMatrix, centre: bool):
        self.row, self.col = sides(x)
        self.spark = x.spark
        cells = _placed(_cells(x, "r_", "__c", "v"), self.row, "r_", "r")
        # a column has a cell a row at most, and a block as tall as the rows is on the driver anyway
        packed = cells.groupBy("__c").agg(F.collect_list(F.struct("r", "v")).alias("cells")).select(F.col("cells.r").alias("rs"), F.col("cells.v").alias("vs"))
        self.packed = stored_table(packed, "columns")
        self.means = np.zeros(len(self.row))
        if centre:
            sums = self.packed.select(F.inline(F.arrays_zip("rs", "vs"))).groupBy("rs").agg(F.sum("vs").alias("s"))
            for r in sums.collect():
                self.means[r["rs"]] = r["s"] / max(1, len(self.col))

    def __call__(self, q: np.ndarray) -> np.ndarray:
        shared = self.spark.sparkContext.broadcast(q)
        tasks = self.spark.sparkContext.defaultParallelism
        parts = self.packed.coalesce(tasks).mapInArrow(_applied(shared, len(q)), "first long, part array<double>")
        sums = parts.repartition("first").sortWithinPartitions("first").mapInArrow(_summed, "first long, part array<double>")
        out = np.zeros_like(q)
        for first, part in sums.collect():
            part = np.array(part).reshape(-1, q.shape[1])
            out[first : first + len(part)] = part
        shared.destroy()
        return out - len(self.col) * np.outer(self.means, self.means @ q)


def _independent(w: np.ndarray, basis: np.ndarray, scale: float) -> np.ndarray:
    """An orthonormal basis of what w adds to one."""
    for _ in range(2):
        w = w - basis @ (basis.T @ w)
    q, r = np.linalg.qr(w)
    q = q[:, np.abs(np.diag(r)) > 1e-10 * scale]
    return q - basis @ (basis.T @ q)


def lanczos(apply, m: int, k: int, extra: int = 10, tolerance: float = 1e-9, most_steps: int = 60, most_bytes: int = DRIVER_BYTES) -> tuple[np.ndarray, np.ndarray]:
    """The k largest eigenvalues and their vectors of a positive operator on vectors of length m.

    A basis grows by blocks of k + extra vectors; when it fills its share of memory it starts anew from the
    best vectors so far. Ends once all residuals are below the tolerance times the largest value.
    """
    k = min(k, m)
    width = min(m, k + extra)
    widest = most_bytes // (16 * max(1, m))
    if widest < 2 * width:
        raise ValueError(f"{m} rows by {2 * width} vectors do not fit the driver's {most_bytes} bytes: choose fewer rows or vectors")
    basis = np.linalg.qr(np.random.default_rng(11).standard_normal((m, width)))[0]
    images = np.zeros((m, 0))
    fresh = basis
    values, vectors = np.zeros(k), basis[:, :k]
    for _ in range(most_steps):
        images = np.hstack([images, apply(fresh)])
        small = basis.T @ images
        found, turn = np.linalg.eigh((small + small.T) / 2)
        best = np.argsort(-found)[:width]
        vectors, turned = basis @ turn[:, best], images @ turn[:, best]
        values = found[best]
        scale = max(float(np.abs(values).max(initial=0.0)), 1e-300)
        rest = np.linalg.norm(turned[:, :k] - vectors[:, :k] * values[:k], axis=0)
        if rest.max(initial=0.0) <= tolerance * scale or basis.shape[1] >= m:
            break
        last = images[:, -fresh.shape[1] :]
        if basis.shape[1] + width > min(widest, m):
            last = turned - vectors * values
            basis, images = vectors, turned
        fresh = _independent(last, basis, scale)
        if not fresh.shape[1]:
            break
        fresh = fresh[:, : m - basis.shape[1]]
        basis = np.hstack([basis, fresh])
    return values[:k], vectors[:, :k]


def _rows(batches: Iterator[pa.RecordBatch], n_cols: int, centre: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Packed rows (r, cs, vs) as places and dense stretches of rows, less their means if centred."""
    per = max(1, CELLS // max(1, n_cols))
    for b in batches:
        place = np.asarray(b.column(0))
        offsets = np.asarray(b.column(1).offsets, dtype=np.int64)
        cols, values = (np.asarray(b.column(i).values)[offsets[0] : offsets[-1]] for i in (1, 2))
        offsets = offsets - offsets[0]
        for at in range(0, b.num_rows, per):
            to = min(b.num_rows, at + per)
            c, v = cols[offsets[at] : offsets[to]], values[offsets[at] : offsets[to]]
            row = np.repeat(np.arange(to - at), np.diff(offsets[at : to + 1]))
            dense = np.bincount(row * n_cols + c, v, (to - at) * n_cols).reshape(-1, n_cols)
            yield place[at:to], dense - dense.mean(axis=1, keepdims=True) if centre else dense


class Squared:
    """The square t(X) X of a matrix with few columns, and its rows times a block; X less its rows' means if centred."""

    def __init__(self, x: CoordMatrix, centre: bool):
        self.row, self.col = sides(x)
        self.centre, n_cols = centre, len(self.col)
        cells = _placed(_placed(_cells(x, "r_", "c_", "v"), self.row, "r_", "r"), self.col, "c_", "c")
        packed = cells.groupBy("r").agg(F.collect_list(F.struct("c", "v")).alias("cells")).select("r", F.col("cells.c").alias("cs"), F.col("cells.v").alias("vs"))
        self.packed = stored_table(packed, "rows")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((n_cols, n_cols))
            for _, dense in _rows(batches, n_cols, centre):
                total += dense.T @ dense
            for i in np.flatnonzero(total.any(axis=1)):
                yield pa.RecordBatch.from_arrays([pa.array([i]), pa.array([total[i]], pa.list_(pa.float64()))], names=["first", "part"])

        parts = self.packed.coalesce(x.spark.sparkContext.defaultParallelism).mapInArrow(run, "first long, part array<double>")
        self.square = np.zeros((n_cols, n_cols))
        for first, part in parts.repartition("first").sortWithinPartitions("first").mapInArrow(_summed, "first long, part array<double>").collect():
            self.square[first] = part

    def times(self, block: np.ndarray) -> DataFrame:
        """Each stored row's place, and its values of X block."""
        n_cols, centre = len(self.col), self.centre

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for place, dense in _rows(batches, n_cols, centre):
                out = dense @ block
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(out) + 1) * out.shape[1], pa.int32()), pa.array(out.ravel()))
                yield pa.RecordBatch.from_arrays([pa.array(place), lists], names=["__at", "us"])

        return self.packed.mapInArrow(run, "__at long, us array<double>")


@dataclass
class Decomposition:
    """d: singular values, falling; x: what was decomposed; left: the rows' vectors and means, or right: the columns' vectors and the square that they are from."""

    x: CoordMatrix
    d: np.ndarray
    left: tuple[np.ndarray, np.ndarray] | None = None
    right: tuple[np.ndarray, Squared] | None = None

    @cached_property
    def u(self) -> np.ndarray:
        """The rows' vectors, as columns of a local array; see vectors() for a table."""
        if self.left is not None:
            return self.left[0]
        row, _ = sides(self.x)
        if 8 * len(row) * len(self.d) > DRIVER_BYTES:
            raise ValueError(f"{len(row)} rows by {len(self.d)} vectors do not fit the driver's {DRIVER_BYTES} bytes: see vectors()")
        out = np.zeros((len(row), len(self.d)))
        table = self.right[1].times(self._turn()).toPandas()
        if len(table):
            out[table["__at"].to_numpy()] = np.stack(table["us"].to_list())
        return out

    def _turn(self) -> np.ndarray:
        """What turns rows into entries of the rows' vectors; those of singular values of zero are zero."""
        some = self.d > NOTHING * self.d.max(initial=0.0)
        return np.where(some, self.right[0] / np.where(some, self.d, 1.0), 0.0)

    def vectors(self) -> DataFrame:
        """The rows' vectors as a table: key, number (from 1) and value, for entries that are not zero."""
        row, _ = sides(self.x)
        if self.left is None:
            cells = self.right[1].times(self._turn()).select("__at", F.posexplode("us").alias("number", "value"))
        else:
            at = np.argwhere(self.left[0] != 0)
            cells = self.x.spark.createDataFrame([(int(r), int(i), float(self.left[0][r, i])) for r, i in at], "__at long, number long, value double")
        return _keyed(cells.where("value <> 0"), row, "__at", row.name).select(row.name, (F.col("number") + 1).cast("long").alias("number"), "value")

    def scores(self) -> DataFrame:
        """The columns' principal components: key, number (from 1) and value, a row for each."""
        _, col = sides(self.x)
        if self.left is None:
            rows = [(c, i + 1, float(v)) for c, each in enumerate(self.right[0] * self.d) for i, v in enumerate(each)]
            return _keyed(self.x.spark.createDataFrame(rows, "__at long, number long, value double"), col, "__at", col.name).select(col.name, "number", "value")
        u, means = self.left
        shift = means @ u
        numbers = self.x.spark.createDataFrame([(i + 1, float(-s)) for i, s in enumerate(shift)], "__col__ long, shift double")
        product = matmul(self.x.T, u).rows("value")
        full = col.table(self.x.spark).select(col.name).crossJoin(F.broadcast(numbers))  # a row of the result each
        out = full.join(product, [col.name, "__col__"], "left")
        return out.select(col.name, F.col("__col__").alias("number"), (F.coalesce("value", F.lit(0.0)) + F.col("shift")).alias("value"))


def svd(x: CoordMatrix, k: int, centre: bool = True, **options) -> Decomposition:
    """The k largest singular values and the rows' vectors of x, less its rows' means if centred.

    A vector's largest entry is positive. Ties between singular values give any basis of their space.
    """
    row, col = sides(x)
    if len(col) < len(row) and len(col) <= SQUARE_COLS and not options:
        return _by_square(x, min(k, len(row)), centre)
    operator = Operator(x, centre)
    values, u = lanczos(operator, len(operator.row), k, **options)
    if u.shape[1]:
        u = u * np.where(u[np.abs(u).argmax(axis=0), np.arange(u.shape[1])] < 0, -1, 1)
    return Decomposition(x, np.sqrt(np.maximum(values, 0)), left=(u, operator.means))


def _by_square(x: CoordMatrix, k: int, centre: bool) -> Decomposition:
    squared = Squared(x, centre)
    values, v = np.linalg.eigh((squared.square + squared.square.T) / 2)
    best = np.argsort(-values)[:k]
    d, v = np.sqrt(np.maximum(values[best], 0)), v[:, best]
    # there may be fewer columns than vectors asked for
    d, v = np.concatenate([d, np.zeros(k - len(d))]), np.hstack([v, np.zeros((len(v), k - v.shape[1]))])
    found = Decomposition(x, d, right=(v, squared))
    entries = squared.times(found._turn()).select("__at", F.posexplode("us").alias("i", "u"))
    largest = entries.groupBy("i").agg(F.max(F.struct(F.abs("u"), -F.col("__at"), "u")).getField("u").alias("u")).collect()
    turned = [r["i"] for r in largest if r["u"] < 0]
    v[:, turned] *= -1
    return found
