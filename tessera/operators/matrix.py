"""Matrix products over coordinate tables: joins on the shared key and grouped sums."""

from __future__ import annotations

from dataclasses import replace
from typing import Any, ClassVar

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import numeric as N
from ..plans.dims import Dim, small, spread_join
from . import tiles
from .array import CoordArray

#: Pairs of a self-join above which a Gram product goes by tiles.
GRAM_PAIRS = 500_000_000
PAIR_CONF = "spark.tessera.gramPairLimit"
#: Up to so many tiles lie along a product's side before tiles are made larger.
MOST_TILES = 4


class CoordMatrix(CoordArray):
    """An array of two key columns."""

    #: Of a product by tiles: the cells (k, p, v) of both factors, and how many contracted keys there are. Arrays made from the product have none.
    factors: ClassVar[tuple[DataFrame, DataFrame, int] | None] = None

    def __post_init__(self) -> None:
        if len(self.dims) != 2:
            raise ValueError("a matrix needs two key columns")

    def margin(self, what: str, side: str = "row", dims: int = 1, **options) -> DataFrame:
        """Sums and means of a product by tiles are one factor times the other's sums by contracted key, so they need none of its cells."""
        if self.factors is None or what not in ("sums", "means") or side not in ("row", "col") or dims != 1 or not options.get("complete", True):
            return super().margin(what, side, dims, **options)
        (near, far, n), (kept, gone) = (self.factors, self.dims) if side == "row" else ((self.factors[1], self.factors[0], self.factors[2]), self.dims[::-1])
        v = F.coalesce("v", F.lit(float("nan")))  # as tiles read a missing value
        got = spread_join(near, far.groupBy("k").agg(F.sum(v).alias("__t")), ["k"], n, "inner")
        got = _keyed(got.groupBy(F.col("p").alias("__p")).agg(F.sum(v * F.col("__t")).alias("value")), kept, "__p", kept.name)
        sums = _made(got.withColumn("__one__", F.lit(1).cast("long")), kept, Dim("__one__", range(1, 2))).margin("sums", **options)
        return sums if what == "sums" else sums.withColumn(sums.columns[-1], N.divide(F.col(sums.columns[-1]), F.lit(len(gone))))


def sides(x: CoordArray) -> tuple[Dim, Dim]:
    dims = x.dims if len(x.dims) == 2 else tuple(d for d in x.dims if len(d) > 1)
    if len(dims) != 2:
        raise ValueError("products need exactly two dimensions")
    if not x.zero_filled:
        raise ValueError("products need arrays filled with zero")
    return dims[0], dims[1]


def _cells(x: CoordArray, row: str, col: str, value: str) -> DataFrame:
    a, b = sides(x)
    return x.rows("__v").select(F.col(a.name).alias(row), F.col(b.name).alias(col), N.number(F.col("__v")).alias(value)).where(F.col(value).isNull() | (F.col(value) != 0))


def _made(df: DataFrame, row: Dim, col: Dim) -> CoordMatrix:
    return CoordMatrix(df, (replace(row, restricted=False), replace(col, restricted=False)), F.col("value"), F.lit(0.0))


def _vector(x: CoordArray, d: Dim, y: Any, name: str) -> DataFrame:
    """A vector in the order of a dimension's levels, or keyed by them, as a table."""
    if isinstance(y, DataFrame):
        other = [c for c in y.columns if c != d.name]
        if d.name not in y.columns or len(other) != 1:
            raise ValueError(f"a table as a vector needs the key '{d.name}' and one more column")
        return y.select(F.col(d.name).alias("__k"), F.col(other[0]).cast("double").alias(name))
    y = np.asarray(y, dtype=np.float64).ravel()
    if len(y) != len(d):
        raise ValueError("non-conformable arguments")
    return d.valued(x.spark, y.tolist(), name).withColumnRenamed(d.name, "__k")


def matvec(x: CoordArray, y: Any) -> CoordMatrix:
    """x %*% y for a vector: a matrix of one column, keyed __col__ = 1."""
    row, col = sides(x)
    got = spread_join(_cells(x, "__r", "__k", "__x"), _vector(x, col, y, "__y"), ["__k"], len(col), "inner")
    got = got.groupBy(F.col("__r").alias(row.name)).agg(F.sum(F.col("__x") * F.col("__y")).alias("value"))
    return _made(got.withColumn("__col__", F.lit(1).cast("long")), row, Dim("__col__", range(1, 2)))


def vecmat(y: Any, x: CoordArray) -> CoordMatrix:
    """y %*% x for a vector: a matrix of one row, keyed __row__ = 1."""
    row, col = sides(x)
    got = spread_join(_cells(x, "__k", "__c", "__x"), _vector(x, row, y, "__y"), ["__k"], len(row), "inner")
    got = got.groupBy(F.col("__c").alias(col.name)).agg(F.sum(F.col("__x") * F.col("__y")).alias("value"))
    return _made(got.withColumn("__row__", F.lit(1).cast("long")), Dim("__row__", range(1, 2)), col)


def _from_dense(x: CoordArray, y: np.ndarray, shared: Dim, other: str, transposed: bool) -> CoordMatrix:
    """A dense local matrix as coordinates, its rows keyed by the shared dimension."""
    y = np.asarray(y, dtype=np.float64)
    y = y.T if transposed else y
    if y.shape[0] != len(shared):
        raise ValueError("non-conformable arguments")
    at = np.argwhere(y != 0)
    rows = [(int(i), int(j) + 1, float(y[i, j])) for i, j in at]
    df = small(x.spark.createDataFrame(rows, T.StructType([T.StructField("__at", T.LongType()), T.StructField(other, T.LongType()), T.StructField("value", T.DoubleType())])), len(rows))
    return CoordMatrix(_keyed(df, shared, "__at", shared.name), (replace(shared, restricted=False), Dim(other, range(1, y.shape[1] + 1), restricted=False)), F.col("value"), F.lit(0.0))


def _placed(cells: DataFrame, d: Dim, key: str, place: str) -> DataFrame:
    """cells with a key's place in its dimension instead of the key."""
    at = d.place_of(F.col(key))
    if at is not None:
        return cells.withColumn(place, at).drop(key)
    table = d.table(cells.sparkSession).select(F.col(d.name).alias(key), F.col("__place").alias(place))
    return cells.join(small(table, len(d)), key).drop(key)


def _keyed(cells: DataFrame, d: Dim, place: str, key: str) -> DataFrame:
    """The reverse of _placed()."""
    if isinstance(d.levels, range):
        return cells.withColumn(key, (F.col(place) + d.levels.start).cast(d.type)).drop(place)
    table = d.table(cells.sparkSession).select(F.col(d.name).alias(key), F.col("__place").alias(place))
    return cells.join(small(table, len(d)), place).drop(place)


def _side(shape: tuple[int, int], side: int) -> tuple[int, bool]:
    """A tile's side, larger than asked for where the result has many, up to tiles.SIDE, and whether cells go only to tiles with partners."""
    side = max(side, min(tiles.SIDE, -(-max(shape) // MOST_TILES)))
    return side, max(shape) > tiles.MANY * side


def _factors(a: CoordArray, b: CoordArray | None, row: Dim, gone: Dim, col: Dim) -> tuple[DataFrame, DataFrame | None]:
    """The cells (k, p, v) of a, rows by contracted keys, and of b: contracted place, place in the result, value."""
    left = _placed(_placed(_cells(a, "p_", "k_", "v"), row, "p_", "p"), gone, "k_", "k").select("k", "p", "v")
    if b is None:
        return left, None
    other, _ = sides(b)
    return left, _placed(_placed(_cells(b, "k_", "p_", "v"), col, "p_", "p"), other, "k_", "k").select("k", "p", "v")


def _tiled(a: CoordArray, b: CoordArray | None, row: Dim, gone: Dim, col: Dim, names: tuple[str, str], side: int, stored: DataFrame | None = None) -> CoordMatrix:
    """A product by tiles; b None: of a (rows by contracted keys) and its transpose. stored: its cells as stretches."""
    shape = (len(row), len(col))
    side, partners = _side(shape, side)
    left, right = _factors(a, b, row, gone, col)
    cells = tiles.opened(tiles.product(left, right, shape, side, partners=partners, stored=stored))
    cells = _keyed(_keyed(cells, row, "a", names[0]), col, "b", names[1])
    out = _made(cells.select(*names, "value"), replace(row, name=names[0]), replace(col, name=names[1]))
    object.__setattr__(out, "factors", (left, left if right is None else right, len(gone)))
    return out


def _own_transpose(a: CoordArray, b: CoordArray) -> bool:
    """Whether b is a's transpose: the same cells, by the same dimensions the other way round."""
    (ra, ca), (rb, cb) = sides(a), sides(b)
    return a.df is b.df and a.value is b.value and a.fill is b.fill and ra is cb and ca is rb


def tiled_matmul(a: CoordArray, b: CoordArray, side: int = tiles.SIDE) -> CoordMatrix:
    """a %*% b by tiles: for results of which most cells are filled, as it makes no row a pair of cells."""
    (ra, ca), (rb, cb) = sides(a), sides(b)
    if len(ca) != len(rb):
        raise ValueError("non-conformable arguments")
    names = (ra.name, cb.name) if ra.name != cb.name else (ra.name + "_a", cb.name + "_b")
    return _tiled(a, None if _own_transpose(a, b) else b, ra, ca, cb, names, side)


def _product(a: CoordArray, b: CoordArray) -> CoordMatrix:
    """Rows of a by columns of b, whose rows are a's columns by place: by tiles where a join would make many pairs for each cell of a tile."""
    (ra, ca), (rb, cb) = sides(a), sides(b)
    if len(ca) != len(rb):
        raise ValueError("non-conformable arguments")
    if _own_transpose(a, b):
        return gram(b, "row")
    left, right = _cells(a, "__r", "__k", "__x"), _cells(b, "__k", "__c", "__y")
    if ca.levels != rb.levels:  # other keys for the same places
        right = _keyed(_placed(right, rb, "__k", "__at"), ca, "__at", "__k")
    row, col = (ra.name, cb.name) if ra.name != cb.name else (ra.name + "_a", cb.name + "_b")
    stored = None
    if _side((len(ra), len(cb)), tiles.SIDE)[1]:
        stored = tiles.stretches(*_factors(a, b, ra, ca, cb))
        pairs = tiles.pairs(stored)
    else:
        n, m = left.groupBy("__k").agg(F.count(F.lit(1)).cast("double").alias("n")), right.groupBy("__k").agg(F.count(F.lit(1)).cast("double").alias("m"))
        pairs = n.join(m, "__k").agg(F.coalesce(F.sum(F.col("n") * F.col("m")), F.lit(0.0))).first()[0]
    if pairs > 4 * min(max(len(ra), len(cb)), tiles.SIDE) ** 2:
        return _tiled(a, b, ra, ca, cb, (row, col), tiles.SIDE, stored)
    got = left.join(right, "__k").groupBy(F.col("__r").alias(row), F.col("__c").alias(col)).agg(F.sum(F.col("__x") * F.col("__y")).alias("value"))
    return _made(got, replace(ra, name=row), replace(cb, name=col))


def _is_vector(y: Any) -> bool:
    return isinstance(y, DataFrame) or (not isinstance(y, CoordArray) and np.ndim(y) == 1)


def matmul(x: Any, y: Any) -> CoordMatrix:
    """x %*% y, where at least one is an array and the other an array, a vector or a dense matrix."""
    if isinstance(x, CoordArray) and isinstance(y, CoordArray):
        return _product(x, y)
    if isinstance(x, CoordArray):
        return matvec(x, y) if _is_vector(y) else _product(x, _from_dense(x, y, sides(x)[1], "__col__", False))
    return vecmat(x, y) if _is_vector(x) else _product(_from_dense(y, x, sides(y)[0], "__row__", True).T, y)


def crossprod(x: Any, y: Any = None, **options) -> CoordMatrix:
    """t(x) %*% y, or t(x) %*% x."""
    if y is None:
        return gram(x, "row", **options)
    if isinstance(x, CoordArray):
        return vecmat(y, x).T if _is_vector(y) else matmul(x.T, y)
    return vecmat(x, y) if _is_vector(x) else matmul(np.asarray(x).T, y)


def tcrossprod(x: Any, y: Any = None, **options) -> CoordMatrix:
    """x %*% t(y), or x %*% t(x). A vector y counts as the row that fits x; a vector x as a column."""
    if y is None:
        return gram(x, "col", **options)
    if isinstance(x, CoordArray):
        return matvec(x, y) if _is_vector(y) else matmul(x, y.T if isinstance(y, CoordArray) else np.asarray(y).T)
    if _is_vector(x):
        return outer(x, y)
    return matmul(x, y.T)


def outer(x: Any, y: CoordArray) -> CoordMatrix:
    """x %*% t(y) for a vector x and a matrix y of one column: every pair of their cells, which is the result."""
    row, col = sides(y)
    if len(col) != 1:
        raise ValueError("non-conformable arguments")
    x = np.asarray(x, dtype=np.float64)
    values = F.broadcast(y.spark.createDataFrame([(1, x.tolist())], "__one int, __v array<double>"))  # one row, as long as the local vector
    cells = _cells(y, row.name, "__c", "__y").withColumn("__one", F.lit(1)).join(values, "__one").select(row.name, "__y", F.posexplode("__v").alias("__i", "__x"))
    got = cells.select((F.col("__i") + 1).cast("long").alias("__row__"), row.name, (F.col("__x") * F.col("__y")).alias("value"))
    return _made(got, Dim("__row__", range(1, len(x) + 1)), row)


def gram(x: CoordArray, contract: str = "row", strategy: str = "auto", limit: int | None = None, side: int = tiles.SIDE) -> CoordMatrix:
    """t(x) %*% x (contracting rows) or x %*% t(x) (contracting columns), keyed <name>_a and <name>_b.

    strategy "tiled" (also called "blocked") multiplies tile by tile, for kept sides of any length; "join" joins
    the cells with themselves; "auto" prefers the first where the join would make many pairs for each cell of a tile.
    Joins estimated above a limit that was given or set (PAIR_CONF) are refused; above GRAM_PAIRS the product goes by tiles.
    """
    if strategy not in ("auto", "join", "tiled", "blocked"):
        raise ValueError("'strategy' must be auto, join, tiled or blocked")
    row, col = sides(x)
    kept, gone = (col, row) if contract == "row" else (row, col)
    cells = _cells(x, row.name, col.name, "__x")
    a, b = kept.name + "_a", kept.name + "_b"
    # What the join makes: the squares of the contracted keys' numbers of cells, so that a hot key counts.
    squares = F.coalesce(F.sum(F.col("count").cast("double") * F.col("count")), F.lit(0.0))
    by_kept, stored, pairs = x if contract == "col" else x.T, None, 0.0
    if strategy in ("auto", "join") and _side((len(kept), len(kept)), side)[1]:
        stored = tiles.stretches(*_factors(by_kept, None, kept, gone, kept))
        pairs = tiles.pairs(stored)
    elif strategy in ("auto", "join"):
        pairs = cells.groupBy(gone.name).count().agg(squares).first()[0]
    asked = limit if limit is not None else x.spark.conf.get(PAIR_CONF, None)
    if strategy in ("tiled", "blocked") or (strategy == "auto" and pairs > 4 * min(len(kept), side) ** 2) or (asked is None and pairs > GRAM_PAIRS):
        return _tiled(by_kept, None, kept, gone, kept, (a, b), side, stored)
    if asked is not None and pairs > int(asked):
        raise ValueError(f"a self-join of about {pairs:.3g} pairs does not scale; raise {PAIR_CONF} or 'limit' to run it")
    one = cells.select(F.col(gone.name).alias("__k"), F.col(kept.name).alias(a), F.col("__x"))
    two = cells.select(F.col(gone.name).alias("__k"), F.col(kept.name).alias(b), F.col("__x").alias("__y"))
    # half the pairs, as the product is symmetric; the other half is a copy
    half = one.join(two, (one["__k"] == two["__k"]) & (F.col(a) <= F.col(b))).groupBy(a, b).agg(F.sum(F.col("__x") * F.col("__y")).alias("value"))
    same, turned = F.struct(a, b, "value"), F.struct(F.col(b).alias(a), F.col(a).alias(b), "value")
    got = half.select(F.inline(F.when(F.col(a) == F.col(b), F.array(same)).otherwise(F.array(same, turned))))
    return _made(got, replace(kept, name=a), replace(kept, name=b))
