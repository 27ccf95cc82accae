"""Dimensions of arrays.

A dimension is a key column with the ordered keys that make up its extent, and optional
labels. Keys that count up by one are a range and take no space, so an axis of a billion
cells is as cheap as one of ten; other keys are a tuple on the driver if they are few, and a
table of keys and places, which never leaves the executors, if they are many.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field, replace
from functools import cached_property
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import stored_table

#: Up to so many keys a restriction is a list in the filter, which reaches the Parquet reader.
INLINE = 100
#: Up to so many rows a level table may be broadcast.
BROADCAST_ROWS = 1_000_000
#: Keys of data up to so many are gathered; of more, a table is made.
DRIVER_LEVELS = 100_000
LEVELS_CONF = "spark.tessera.driverLevels"
#: Keys of which a join tells whether they are hot, and into how many parts their rows are dealt.
HOT_KEYS, SALTS = 100, 64


class LevelTable(Sequence):
    """Ordered keys as a table: key, and place from 0. A slice is a view; single keys are looked up."""

    def __init__(self, df: DataFrame, start: int, stop: int):
        self.df, self.start, self.stop = df, start, stop

    def __len__(self) -> int:
        return max(0, self.stop - self.start)

    def rows(self) -> DataFrame:
        """key and place, of the keys of this view."""
        return self.df.where((F.col("place") >= self.start) & (F.col("place") < self.stop)).select("key", (F.col("place") - self.start).alias("place"))

    def __getitem__(self, index: Any) -> Any:
        if isinstance(index, slice):
            part = range(len(self))[index]
            return LevelTable(self.df, self.start + part.start, self.start + max(part.start, part.stop)) if part.step == 1 else self.pick(part)
        return self.pick([range(len(self))[index]])[0]

    def pick(self, places: Sequence[int]) -> tuple:
        """The keys of places that the driver has in hand."""
        wanted = self.df.sparkSession.createDataFrame([(int(p),) for p in dict.fromkeys(places)], "place long")
        found = {r["place"]: r["key"] for r in self.rows().join(small(wanted, len(places)), "place", "left_semi").collect()}
        return tuple(found[p] for p in places)

    def find(self, keys: Sequence) -> dict[str, int]:
        """The places of keys that the driver has in hand, by their text."""
        wanted = self.df.sparkSession.createDataFrame([(str(k),) for k in dict.fromkeys(keys)], "text string")
        rows = self.rows().withColumn("text", F.col("key").cast("string")).join(small(wanted, len(keys)), "text", "left_semi")
        return {r["text"]: r["place"] for r in rows.collect()}

    def __iter__(self):
        raise ValueError(f"{len(self)} levels are kept as a table and not gathered: choose some, or see Dim.table()")

    def __eq__(self, other: object) -> bool:
        return isinstance(other, LevelTable) and self.df is other.df and (self.start, self.stop) == (other.start, other.stop)

    __hash__ = None


def ranked(keys: DataFrame) -> LevelTable:
    """Distinct keys (one column) in ascending order, with their places: ranks within ranges, and what came in the ranges before."""
    name = keys.columns[0]
    low = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))  # the row's number in its partition
    parts = keys.select(F.col(name).alias("key")).repartitionByRange("key").sortWithinPartitions("key")
    parts = stored_table(parts.select("key", F.spark_partition_id().alias("part"), low.alias("at")), "levels")
    before, offsets = 0, []
    for part, n in sorted(tuple(r) for r in parts.groupBy("part").count().collect()):  # a row a partition
        offsets.append((part, before))
        before += n
    offsets = F.broadcast(keys.sparkSession.createDataFrame(offsets, "part int, before long"))
    return LevelTable(parts.join(offsets, "part").select("key", (F.col("at") + F.col("before")).alias("place")), 0, before)


def as_levels(keys: Sequence) -> Sequence:
    """Keys as a range if they count up by one, else as a tuple."""
    if isinstance(keys, LevelTable) or (isinstance(keys, range) and keys.step == 1):
        return keys
    keys = tuple(k.item() if hasattr(k, "item") else k for k in keys)
    if len(keys) > 1 and all(type(k) is int for k in keys) and all(b - a == 1 for a, b in zip(keys, keys[1:])):
        return range(keys[0], keys[-1] + 1)
    return keys


@dataclass(frozen=True, eq=False)
class Dim:
    name: str
    levels: Sequence
    type: T.DataType = field(default_factory=T.LongType)
    labels: tuple[str, ...] | None = None
    restricted: bool = True  # whether the table may hold keys outside the levels

    def __len__(self) -> int:
        return len(self.levels)

    def __eq__(self, other: object) -> bool:
        return isinstance(other, Dim) and (self.name, self.labels) == (other.name, other.labels) and as_levels(self.levels) == as_levels(other.levels)

    __hash__ = None

    @cached_property
    def places(self) -> dict[Any, int]:
        return {k: i for i, k in enumerate(self.levels)}

    def keys_at(self, positions: Sequence[int]) -> Sequence:
        return self.levels.pick(positions) if isinstance(self.levels, LevelTable) else [self.levels[p] for p in positions]

    def places_of(self, keys: Sequence) -> list[int]:
        """The places of some keys."""
        if isinstance(self.levels, LevelTable):
            found = self.levels.find(keys)
            return [found[str(k)] for k in keys]
        return [self.levels.index(k) for k in keys] if isinstance(self.levels, range) else [self.places[k] for k in keys]

    def names(self) -> list:
        return list(self.labels) if self.labels is not None else list(self.levels)

    def take(self, positions: Sequence[int]) -> Dim:
        whole = len(positions) == len(self) and (positions == range(len(self)) if isinstance(positions, range) else all(i == p for i, p in enumerate(positions)))
        if whole:
            return self
        if isinstance(positions, range) and positions.step == 1:  # a slice, which takes no space of a range
            part = slice(positions.start, positions.stop)
            return replace(self, levels=self.levels[part], labels=None if self.labels is None else self.labels[part], restricted=True)
        return replace(self, levels=as_levels(self.keys_at(positions)), labels=None if self.labels is None else tuple(self.labels[p] for p in positions), restricted=True)

    def table(self, spark: SparkSession, place: str = "__place") -> DataFrame:
        """One row for each level: its key under the dimension's name, and its place from 0."""
        if isinstance(self.levels, range):
            ids = spark.range(len(self.levels)).withColumnRenamed("id", place)
            return ids.select((F.col(place) + self.levels.start).cast(self.type).alias(self.name), place)
        if isinstance(self.levels, LevelTable):
            return self.levels.rows().select(F.col("key").alias(self.name), F.col("place").alias(place))
        schema = T.StructType([T.StructField(self.name, self.type), T.StructField(place, T.LongType())])
        return spark.createDataFrame([(k, i) for i, k in enumerate(self.levels)], schema)

    def valued(self, spark: SparkSession, values: Sequence, name: str) -> DataFrame:
        """A local vector in the order of the levels, as a table of keys and values."""
        if isinstance(self.levels, LevelTable):
            local = spark.createDataFrame(list(enumerate(values)), f"__place long, `{name}` double")
            return self.table(spark).join(small(local, len(values)), "__place").select(self.name, name)
        schema = T.StructType([T.StructField(self.name, self.type), T.StructField(name, T.DoubleType())])
        return spark.createDataFrame(list(zip(self.levels, values, strict=True)), schema)

    def within(self, df: DataFrame) -> DataFrame:
        """The rows of df whose key is a level."""
        if not self.restricted:
            return df
        key = F.col(self.name)
        if isinstance(self.levels, range):
            if not len(self.levels):
                return df.where(F.lit(False))
            return df.where((key >= self.levels[0]) & (key <= self.levels[-1]))
        if len(self.levels) <= INLINE and not isinstance(self.levels, LevelTable):
            return df.where(key.isin(list(self.levels)))
        keys = self.table(df.sparkSession).select(self.name)
        return df.join(small(keys, len(self.levels)), self.name, "left_semi")

    def place_of(self, key: Column) -> Column | None:
        """The place of a key by arithmetic, where that is possible."""
        return (key - self.levels.start).cast("long") if isinstance(self.levels, range) else None


def small(df: DataFrame, rows: int) -> DataFrame:
    """df, with a broadcast hint if its known number of rows allows it."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def spread_join(cells: DataFrame, table: DataFrame, keys: Sequence[str], rows: int, how: str = "left") -> DataFrame:
    """cells joined with a table of so many rows at most, one for each key: by broadcast if they are few.

    Else by a shuffle, in which the rows of hot keys, found by a sketch of all rows' keys, are dealt to
    many tasks: they get a number as well, and the table's row of such a key is there once for each number.
    """
    if rows <= BROADCAST_ROWS:
        return cells.join(F.broadcast(table), list(keys), how)
    spark, parts = cells.sparkSession, int(cells.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    mark = F.xxhash64(*keys)
    top, n = cells.select(mark.alias("k")).agg(F.expr(f"approx_top_k(k, {HOT_KEYS}, {100 * HOT_KEYS})").alias("top"), F.count(F.lit(1)).alias("n")).first()
    hot = [r["item"] for r in top or () if r["count"] > n / (2 * parts)]
    if not hot:
        return cells.join(table, list(keys), how)
    salts = min(SALTS, 2 * parts)
    is_hot = mark.isin(hot)
    cells = cells.withColumn("__salt", F.when(is_hot, F.pmod(F.xxhash64(*cells.columns), F.lit(salts))).otherwise(0))
    table = table.withColumn("__salt", F.explode(F.when(is_hot, F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))).otherwise(F.array(F.lit(0).cast("long")))))
    return cells.join(table, [*keys, "__salt"], how).drop("__salt")


def discover(df: DataFrame, name: str) -> Dim:
    """A dimension of all keys that a column holds, ascending. Keys that count up by one are a range, few others a tuple, many a table."""
    kind, spark = df.schema[name].dataType, df.sparkSession
    keys = df.select(name).where(F.col(name).isNotNull()).distinct()
    most = int(spark.conf.get(LEVELS_CONF, str(DRIVER_LEVELS)))
    if isinstance(kind, T.IntegralType):
        low, high, n = keys.agg(F.min(name), F.max(name), F.count(F.lit(1))).first()
        if n and high - low + 1 == n:
            return Dim(name, range(low, high + 1), kind, None, False)
    few = keys.orderBy(name).limit(most + 1).toPandas()[name].tolist()
    return Dim(name, as_levels(few) if len(few) <= most else ranked(keys), kind, None, False)


def grid(spark: SparkSession, dims: Sequence[Dim]) -> DataFrame:
    """All combinations of levels, one row each: numbered, and split into keys by arithmetic."""
    total = 1
    for d in dims:
        total *= len(d)
    out = spark.range(total).withColumnRenamed("id", "__cell")
    stride = total
    for d in dims:
        stride //= max(1, len(d))
        place = F.floor(F.col("__cell") / stride).cast("long") % max(1, len(d)) if stride > 1 else F.col("__cell") % max(1, len(d))
        if isinstance(d.levels, range):
            out = out.withColumn(d.name, (place + d.levels.start).cast(d.type))
        else:
            out = out.withColumn("__place", place).join(small(d.table(spark), len(d)), "__place").drop("__place")
    return out.select(*[d.name for d in dims])


def dim_tables(dims: Sequence[Dim], spacings: Sequence[int] | None, suffix: str = "_group") -> dict[str, dict[Any, int] | None]:
    """For each dimension the grid group of every key; None where the grid has one cell along it."""
    out: dict[str, dict[Any, int] | None] = {}
    for i, d in enumerate(dims):
        step = spacings[i] if spacings is not None else len(d)
        out[d.name] = None if step >= len(d) else {k: p // step + 1 for p, k in enumerate(d.levels)}
    return out


def group_table(spark: SparkSession, d: Dim, spacing: int, suffix: str = "_group") -> DataFrame:
    """The grid group of every key of a dimension, as a stored table: for with_dim_tables(), whose filters then prune partitions at run time."""
    return stored_table(d.table(spark).select(d.name, (F.floor(F.col("__place") / spacing) + 1).cast("int").alias(d.name + suffix)), "groups")
