"""Lazy N-dimensional arrays over coordinate tables.

An array is a DataFrame with a row for each stored cell, an ordered list of dimensions, and
two expressions: the value of a stored cell and the value of every cell that is not stored.
Element-wise work applies the same function to both, so no cell is ever made up. Nothing
runs until rows, a margin or a local array are asked for.
"""

from __future__ import annotations

import numbers
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field, replace
from functools import cached_property
from typing import Any

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import numeric as N
from ..plans.dims import Dim, LevelTable, as_levels, discover, grid, small

#: Element types by Spark type, with the value of a cell that is not stored.
TYPES = {
    "boolean": ("logical", False),
    "tinyint": ("integer", 0),
    "smallint": ("integer", 0),
    "int": ("integer", 0),
    "bigint": ("integer64", 0),
    "float": ("double", 0.0),
    "double": ("double", 0.0),
    "string": ("character", ""),
}
CASTS = {"logical": "boolean", "integer": "int", "integer64": "bigint", "double": "double", "character": "string"}


def kind_of(dtype: T.DataType) -> str:
    name = dtype.simpleString()
    return "double" if name.startswith("decimal") else name


@dataclass(frozen=True, eq=False)
class CoordArray:
    df: DataFrame
    dims: tuple[Dim, ...]
    value: Column
    fill: Column
    drop: bool = False
    tables: dict[str, tuple[str, Any]] = field(default_factory=dict)  # dimension -> (group column, key -> group, as a mapping or a table)

    def __post_init__(self) -> None:
        if not self.dims:
            raise ValueError("an array needs a dimension")

    # construction and metadata

    @classmethod
    def from_coo(cls, df: DataFrame, value: str | Column, dims: Sequence[str] | dict[str, Any], type: str | None = None, dim_tables: dict[str, Any] | None = None, suffix: str = "_group", fill: Any = None) -> CoordArray:
        """An array of a table's rows; coordinates must be unique.

        value: a column's name, or an expression. dims: key columns' names, whose keys are then
        taken from the data in ascending order, or a mapping to their keys (a sequence, or a
        mapping of labels to keys, or a Dim). type: an element type to cast to. dim_tables: for
        partitioned tables, the group of every key of a dimension, for pruning: a mapping, or a table
        of the key and its group.
        """
        value = F.col(value) if isinstance(value, str) else value
        if not isinstance(value, Column):
            raise TypeError("exactly one value column is needed")
        made = []
        for name in dims:
            levels = dims[name] if isinstance(dims, dict) else None
            kind = df.schema[name].dataType
            if levels is None:
                made.append(discover(df, name))
            elif isinstance(levels, Dim):
                made.append(replace(levels, name=name, type=kind))
            elif isinstance(levels, dict):
                made.append(Dim(name, as_levels(list(levels.values())), kind, tuple(map(str, levels))))
            else:
                made.append(Dim(name, as_levels(levels), kind))
        if type is not None:
            value = value.cast(cls._cast(type))
        out = cls(df, tuple(made), value, F.lit(None))
        if kind_of(out.schema_type) not in TYPES:
            raise TypeError(f"cells cannot be of type {out.schema_type.simpleString()}")
        out = replace(out, fill=F.lit(out.zero if fill is None else fill).cast(out.schema_type))
        out = out.as_matrix() if len(made) == 2 else out
        return out.with_dim_tables(dim_tables, suffix) if dim_tables else out

    @staticmethod
    def _cast(type: str) -> str:
        if type not in CASTS:
            raise ValueError(f"type must be one of {sorted(CASTS)}")
        return CASTS[type]

    @property
    def spark(self) -> SparkSession:
        return self.df.sparkSession

    @cached_property
    def schema_type(self) -> T.DataType:
        return self.df.select(self.value.alias("v")).schema[0].dataType

    @property
    def type(self) -> str:
        return TYPES[kind_of(self.schema_type)][0]

    @property
    def zero(self) -> Any:
        return TYPES[kind_of(self.schema_type)][1]

    @cached_property
    def fill_value(self) -> Any:
        """The value of cells that are not stored, worked out by Spark as for stored ones."""
        return self.spark.range(1).select(self.fill.alias("f")).first()["f"]

    @property
    def zero_filled(self) -> bool:
        return self.fill_value == self.zero

    @property
    def shown(self) -> tuple[Dim, ...]:
        """The dimensions that count: without those of extent 1 once they are dropped."""
        return tuple(d for d in self.dims if len(d) != 1) if self.drop else self.dims

    @property
    def shape(self) -> tuple[int, ...]:
        return tuple(len(d) for d in self.shown) or (1,)

    @property
    def ndim(self) -> int:
        return len(self.shape)

    @property
    def size(self) -> int:
        out = 1
        for d in self.dims:
            out *= len(d)
        return out

    @property
    def dimnames(self) -> list[list] | None:
        return [d.names() for d in self.shown] or None

    def __len__(self) -> int:
        return self.size

    def __repr__(self) -> str:
        return f"<{' x '.join(map(str, self.shape))}> sparse {type(self).__name__} object of type \"{self.type}\""

    def with_dimnames(self, names: dict[str, Sequence[str] | None]) -> CoordArray:
        """Other labels; stored keys stay."""
        for name, labels in names.items():
            if labels is not None and len(labels) != len(self.dim(name)):
                raise ValueError(f"'{name}' has {len(self.dim(name))} levels, not {len(labels)}")
        return replace(self, dims=tuple(replace(d, labels=None if names[d.name] is None else tuple(map(str, names[d.name]))) if d.name in names else d for d in self.dims))

    @property
    def dim_tables(self) -> dict[str, tuple[str, Any]]:
        return dict(self.tables)

    def with_dim_tables(self, tables: dict[str, dict[Any, int] | DataFrame | None], suffix: str = "_group") -> CoordArray:
        made = {}
        for name, table in tables.items():
            self.dim(name)
            if isinstance(table, DataFrame):
                other = [c for c in table.columns if c != name]
                if name not in table.columns or len(other) != 1:
                    raise ValueError(f"a dimension table needs the key '{name}' and one more column, its group")
                made[name] = (name + suffix, table.select(name, F.col(other[0]).alias(name + suffix)))
            elif table is not None:
                made[name] = (name + suffix, dict(table))
        return replace(self, tables=made)

    def dim(self, name: str) -> Dim:
        for d in self.dims:
            if d.name == name:
                return d
        raise KeyError(f"no dimension '{name}'")

    def astype(self, type: str) -> CoordArray:
        to = self._cast(type)
        kind = kind_of(self.schema_type)
        change = (lambda c: c.try_cast(to)) if kind == "string" or to in ("int", "bigint") else lambda c: c.cast(to)
        return self._mapped(change)

    def as_matrix(self) -> CoordArray:
        """The array as a matrix. Of more than two dimensions at most two may have another extent than 1; the others' cells are chosen and their keys dropped."""
        from .matrix import CoordMatrix

        if len(self.dims) <= 2:
            return CoordMatrix(self.df, self.dims, self.value, self.fill, self.drop, self.tables)
        kept = [d for d in self.dims if len(d) != 1]
        if len(kept) > 2:
            raise ValueError("a matrix needs two key columns: choose one level of the other dimensions")
        kept += [d for d in self.dims if len(d) == 1][: 2 - len(kept)]
        kept = [d for d in self.dims if any(d is k for k in kept)]
        cells = self.rows("__value").select(*[d.name for d in kept], "__value")
        return CoordMatrix(cells, tuple(replace(d, restricted=False) for d in kept), F.col("__value"), self.fill, self.drop, {})

    # order and subsets

    def aperm(self, order: Sequence[int]) -> CoordArray:
        """Dimensions in another order; order holds places from 0."""
        if sorted(order) != list(range(len(self.dims))):
            raise ValueError("'perm' must be a permutation of the dimensions")
        return replace(self, dims=tuple(self.dims[i] for i in order))

    @property
    def T(self) -> CoordArray:
        if len(self.dims) == 2:
            return self.aperm((1, 0))
        if len(self.shown) != 2:
            raise ValueError("only arrays of two dimensions can be transposed")
        return self.as_matrix().aperm((1, 0))

    def __matmul__(self, other: Any):
        from .matrix import matmul

        return matmul(self, other)

    def __rmatmul__(self, other: Any):
        from .matrix import matmul

        return matmul(other, self)

    __array_ufunc__ = None  # numpy arrays leave @ to __rmatmul__

    def __getitem__(self, index: Any) -> CoordArray:
        """Cells by place from 0 (numbers, slices, logicals) or by label, in the order asked for."""
        return self.subset(*(index if isinstance(index, tuple) else (index,)))

    def subset(self, *index: Any, drop: bool = True) -> CoordArray:
        shown = self.dims if len(index) == len(self.dims) else self.shown
        if len(index) != len(shown):
            raise IndexError(f"{len(shown)} subscripts are needed, not {len(index)}")
        picked = {d.name: self._places(d, i) for d, i in zip(shown, index, strict=True)}
        out: CoordArray = self
        for name, places in picked.items():
            if places is not None and not isinstance(places, range) and len(set(places)) < len(places):
                out = out._repeated(name, places)
            elif places is not None:
                out = replace(out, dims=tuple(d.take(places) if d.name == name else d for d in out.dims))
        if drop:
            out = replace(out, drop=True)
        return CoordArray(out.df, out.dims, out.value, out.fill, out.drop, out.tables) if sum(len(d) != 1 for d in out.dims) < 2 and drop else out

    @staticmethod
    def _places(d: Dim, index: Any) -> Sequence[int] | None:
        if index is None or index is Ellipsis or (isinstance(index, slice) and index == slice(None)):
            return None
        if isinstance(index, slice):
            return range(len(d))[index]
        index = [index] if isinstance(index, (str, numbers.Integral, np.bool_)) else list(index)
        if index and all(isinstance(i, (bool, np.bool_)) for i in index):
            if len(index) != len(d):
                raise IndexError(f"'{d.name}' has {len(d)} levels, not {len(index)}")
            return [i for i, use in enumerate(index) if use]
        if any(isinstance(i, str) for i in index):
            by_table = d.labels is None and isinstance(d.levels, LevelTable)
            names = d.levels.find(index) if by_table else {str(n): i for i, n in enumerate(d.names())}
            missing = [i for i in index if i not in names]
            if missing:
                raise IndexError(f"'{d.name}' has no level {missing[0]!r}")
            return [names[i] for i in index]
        places = [int(i) + len(d) if i < 0 else int(i) for i in index]
        if any(not 0 <= p < len(d) for p in places):
            raise IndexError(f"a subscript is out of the bounds of '{d.name}'")
        return places

    def _repeated(self, name: str, places: list[int]) -> CoordArray:
        """A subset that holds levels more than once: keyed anew, by place."""
        d = self.dim(name)
        keys = d.keys_at(places)
        table = self.spark.createDataFrame([(k, i) for i, k in enumerate(keys)], T.StructType([T.StructField(name, d.type), T.StructField("__new", T.LongType())]))
        cells = self.rows("__value").join(small(table, len(keys)), name).drop(name).withColumnRenamed("__new", name)
        names = keys if d.labels is None else [d.labels[p] for p in places]
        new = Dim(name, range(len(keys)), T.LongType(), tuple(map(str, names)), False)
        dims = tuple(new if x.name == name else replace(x, restricted=False) for x in self.dims)
        return replace(self, df=cells, dims=dims, value=F.col("__value"), tables={})

    # element-wise operations

    def _mapped(self, fn: Callable[[Column], Column]) -> CoordArray:
        return replace(self, value=fn(self.value), fill=fn(self.fill))

    def _kind(self, other: Any = None) -> str:
        if other is None:
            return kind_of(self.schema_type)
        if isinstance(other, CoordArray):
            return kind_of(other.schema_type)
        if isinstance(other, (bool, np.bool_)):
            return "boolean"
        return "string" if isinstance(other, str) else "bigint" if isinstance(other, numbers.Integral) else "double"

    def _binary(self, other: Any, fn: Callable[[Column, Column], Column], swap: bool = False) -> CoordArray:
        if isinstance(other, CoordArray):
            if self.df is not other.df or self.dims != other.dims or self.drop != other.drop:
                raise ValueError("can only perform binary operations with compatible objects")
            value, fill = other.value, other.fill
        elif isinstance(other, (numbers.Number, str, bool, np.generic)) or other is None:
            value = fill = F.lit(other.item() if isinstance(other, np.generic) else other)
        else:
            return NotImplemented
        if swap:
            return replace(self, value=fn(value, self.value), fill=fn(fill, self.fill))
        return replace(self, value=fn(self.value, value), fill=fn(self.fill, fill))

    def _arithmetic(self, other: Any, fn: Callable, swap: bool = False, double: bool = False) -> CoordArray:
        kinds = (self._kind(), self._kind(other))
        if "string" in kinds:
            raise TypeError("arithmetic needs numbers")
        cast = N.number if double or any(k in ("double", "float") for k in kinds) else N.whole
        return self._binary(other, lambda a, b: fn(cast(a), cast(b)), swap)

    def __add__(self, o): return self._arithmetic(o, N.add)  # noqa: E704
    def __radd__(self, o): return self._arithmetic(o, N.add, True)  # noqa: E704
    def __sub__(self, o): return self._arithmetic(o, N.subtract)  # noqa: E704
    def __rsub__(self, o): return self._arithmetic(o, N.subtract, True)  # noqa: E704
    def __mul__(self, o): return self._arithmetic(o, N.multiply)  # noqa: E704
    def __rmul__(self, o): return self._arithmetic(o, N.multiply, True)  # noqa: E704
    def __truediv__(self, o): return self._arithmetic(o, N.divide, double=True)  # noqa: E704
    def __rtruediv__(self, o): return self._arithmetic(o, N.divide, True, True)  # noqa: E704
    def __mod__(self, o): return self._arithmetic(o, N.floor_mod, double=True)  # noqa: E704
    def __rmod__(self, o): return self._arithmetic(o, N.floor_mod, True, True)  # noqa: E704
    def __floordiv__(self, o): return self._arithmetic(o, N.floor_divide, double=True)  # noqa: E704
    def __rfloordiv__(self, o): return self._arithmetic(o, N.floor_divide, True, True)  # noqa: E704
    def __pow__(self, o): return self._arithmetic(o, N.power, double=True)  # noqa: E704
    def __rpow__(self, o): return self._arithmetic(o, N.power, True, True)  # noqa: E704
    def __neg__(self): return self._arithmetic(0, N.subtract, True)  # noqa: E704
    def __pos__(self): return self._arithmetic(0, N.add)  # noqa: E704

    def _compared(self, other: Any, name: str) -> CoordArray:
        kinds = (self._kind(), self._kind(other))
        floats = "string" not in kinds and any(k in ("double", "float") for k in kinds)

        def fn(a: Column, b: Column) -> Column:
            if "boolean" in kinds and set(kinds) != {"boolean"}:
                a, b = (N.number(c) for c in (a, b))
            return N.compare(name, a, b, floats)

        return self._binary(other, fn)

    def __eq__(self, o): return self._compared(o, "eq")  # noqa: E704
    def __ne__(self, o): return self._compared(o, "ne")  # noqa: E704
    def __lt__(self, o): return self._compared(o, "lt")  # noqa: E704
    def __le__(self, o): return self._compared(o, "le")  # noqa: E704
    def __gt__(self, o): return self._compared(o, "gt")  # noqa: E704
    def __ge__(self, o): return self._compared(o, "ge")  # noqa: E704

    __hash__ = object.__hash__

    def _logic(self, other: Any, fn: Callable) -> CoordArray:
        mine, theirs = self._kind(), self._kind(other)
        return self._binary(other, lambda a, b: fn(N.truth(a, mine), N.truth(b, theirs)))

    def __and__(self, o): return self._logic(o, lambda a, b: a & b)  # noqa: E704
    def __or__(self, o): return self._logic(o, lambda a, b: a | b)  # noqa: E704
    __rand__, __ror__ = __and__, __or__

    def __invert__(self) -> CoordArray:
        kind = self._kind()
        return self._mapped(lambda c: ~N.truth(c, kind))

    def math(self, name: str) -> CoordArray:
        """A mathematical function of every cell, by name."""
        if name in N.UNSUPPORTED or name not in N.MATH:
            raise NotImplementedError(f"'{name}' is not supported for sparse arrays")
        if self.type == "character":
            raise TypeError("mathematics needs numbers")
        boolean = self._kind() == "boolean"
        return self._mapped(lambda c: N.MATH[name](N.whole(c) if boolean else c))

    def __getattr__(self, name: str) -> Callable[[], CoordArray]:
        if name in N.MATH or name in N.UNSUPPORTED:
            return lambda: self.math(name)
        raise AttributeError(name)

    def __abs__(self) -> CoordArray:
        return self.math("abs")

    def is_nan(self) -> CoordArray:
        return self._mapped(N.is_nan)

    def is_finite(self) -> CoordArray:
        return self._mapped(N.is_finite)

    def is_infinite(self) -> CoordArray:
        return self._mapped(N.is_infinite)

    # sparsity

    def is_nonzero(self) -> CoordArray:
        zero = self.zero
        return self._mapped(lambda c: c != F.lit(zero))

    @property
    def is_sparse(self) -> bool:
        return True

    def nzcount(self) -> int:
        """Cells that are not zero, stored or not."""
        row = self.rows("v").agg(F.count_if(F.col("v") != F.lit(self.zero)).alias("nz"), F.count(F.lit(1)).alias("n")).first()
        return row["nz"] + (0 if self.zero_filled else self.size - row["n"])

    def nzvals(self) -> DataFrame:
        """The values that are not zero, with their places, the first dimension's fastest; for arrays filled with zero."""
        if not self.zero_filled:
            raise ValueError("only arrays filled with zero keep their other values stored")
        from .realize import placed

        order = [F.col(f"__place_{d.name}") for d in reversed(self.dims)]
        return placed(self.where_stored(F.col("value") != F.lit(self.zero)), self.dims).orderBy(*order)

    # rows

    def _filtered(self) -> DataFrame:
        df = self.df
        for name, (column, groups) in self.tables.items():
            d = self.dim(name)
            if not d.restricted or column not in df.columns:
                continue
            if isinstance(groups, DataFrame):
                # a broadcast of the wanted groups, whose filter prunes partitions at run time
                df = df.join(small(d.within(groups).select(column).distinct(), len(d)), column, "left_semi")
            elif not isinstance(d.levels, LevelTable):
                wanted = sorted({groups[k] for k in d.levels if k in groups})
                if len(wanted) < len(set(groups.values())):
                    df = df.where(F.col(column).isin(wanted))
        for d in self.dims:
            df = d.within(df)
        return df

    def rows(self, value: str = "value") -> DataFrame:
        """Stored cells: key columns in the array's order, and the value."""
        return self._filtered().select(*[d.name for d in self.dims], self.value.alias(value))

    def where_stored(self, condition: Column) -> DataFrame:
        return self.rows().where(condition)

    def to_df(self, select: bool = True, filter: bool = True) -> DataFrame:
        """The table behind the array, with or without its choice of columns and rows."""
        if select:
            return self.rows() if filter else self.df.select(*[d.name for d in self.dims], self.value.alias("value"))
        return self._filtered() if filter else self.df

    def dense_df(self, value: str = "value") -> DataFrame:
        """Every cell as a row: stored ones with their values, the others with the fill."""
        names = [d.name for d in self.dims]
        cells = self.rows(value).withColumn("__stored", F.lit(True))
        full = grid(self.spark, self.dims).join(cells, names, "left")
        return full.select(*names, F.when(F.col("__stored"), F.col(value)).otherwise(self.fill).alias(value))

    # what other modules do

    def margin(self, what: str, side: str = "row", dims: int = 1, **options) -> DataFrame:
        from .margins import margin

        return margin(self, what, side, dims, **options)

    def summary(self, what: str, na_rm: bool = False) -> Any:
        from .margins import summary

        return summary(self, what, na_rm)

    def sweep(self, margin: int | Sequence[int], stats: Any, fun: str = "*") -> CoordArray:
        from .sweep import sweep

        return sweep(self, margin, stats, fun)

    def to_numpy(self) -> np.ndarray:
        from .realize import to_numpy

        return to_numpy(self)

    def to_coo(self) -> tuple[np.ndarray, np.ndarray]:
        from .realize import to_coo

        return to_coo(self)


def _margins() -> None:
    from .margins import STATISTICS

    for what in STATISTICS:
        for side in ("row", "col"):

            def method(self, dims: int = 1, what=what, side=side, **options):
                return self.margin(what, side, dims, **options)

            setattr(CoordArray, f"{side}_{what}", method)


_margins()
