"""Margin statistics: one grouped aggregation, corrected for the cells that are not stored.

For a margin over k cells of which n are stored, the other k - n hold the fill f. Every
statistic is one pass: variances combine the stored cells' with the distance of their mean
from f. Groups without stored cells are added from the levels, by a left join.
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import numeric as N
from ..plans.dims import grid

STATISTICS = ("sums", "means", "mins", "maxs", "vars", "sds", "counts", "nnzs")


def margin(x, what: str, side: str = "row", dims: int = 1, na_rm: bool = False, value: Any = True, complete: bool = True, name: str = "value") -> DataFrame:
    """The kept keys and the statistic, for every combination of kept levels.

    side "row" keeps the first `dims` dimensions, "col" the others. na_rm leaves missing values
    out of the statistic and of its number of cells; otherwise one makes the result missing.
    value: what counts counts. complete=False gives only groups with stored cells.
    """
    if what not in STATISTICS:
        raise ValueError(f"statistic must be one of {STATISTICS}")
    shown = x.shown
    if len(shown) < 2 or not 1 <= dims < len(shown):
        raise ValueError("'dims' must leave a dimension on either side")
    kept = shown[:dims] if side == "row" else shown[dims:]
    k = 1
    for d in x.dims:
        k *= len(d) if d not in kept else 1
    keys = [d.name for d in kept]
    result = _statistic(x, what, k, na_rm, value)
    rows = x.rows("__v")
    grouped = rows.groupBy(*keys).agg(*_partials(x, what, value))
    if complete:
        grouped = grid(x.spark, kept).join(grouped, keys, "left").na.fill(0, ["__n", "__na"])
    return grouped.select(*keys, result.alias(name))


def _value_of(x, v: Column, what: str) -> Column:
    return v if what in ("counts", "nnzs") else N.number(v) if what in ("means", "vars", "sds") or x.type == "double" else N.whole(v) if what == "sums" or x.type == "logical" else v


def _target(x, what: str, value: Any) -> Column:
    if what == "nnzs":
        return F.lit(x.zero if value is True else value)
    if value is True and x.type != "logical":
        value = x.zero + 1 if x.type != "character" else "TRUE"
    return F.lit(value)


def _partials(x, what: str, value: Any) -> list[Column]:
    v = _value_of(x, F.col("__v"), what)
    out = [F.count(F.lit(1)).alias("__n"), F.count_if(F.col("__v").isNull()).alias("__na")]
    if what in ("sums", "means"):
        out.append(F.sum(v).alias("__a"))
    elif what == "mins":
        out.append(F.min(v).alias("__a"))
    elif what == "maxs":
        out.append(F.max(v).alias("__a"))
    elif what in ("vars", "sds"):
        out += [F.var_pop(v).alias("__a"), F.avg(v).alias("__b")]
    else:
        out.append(F.count_if(v == _target(x, what, value)).alias("__a"))
    return out


def _statistic(x, what: str, k: int, na_rm: bool, value: Any) -> Column:
    n, na, a = F.col("__n"), F.col("__na"), F.col("__a")
    f = _value_of(x, x.fill, what)
    absent = F.lit(k).cast("long") - n
    cells = F.lit(k).cast("long") - (na if na_rm else F.lit(0))
    filled = F.when(absent == 0, f * 0 if what in ("sums", "means") else None).otherwise(f * absent if what in ("sums", "means") else f)
    if what == "sums":
        out = F.coalesce(a, F.lit(0)) + F.when(absent == 0, F.lit(0)).otherwise(filled)
    elif what == "means":
        out = N.divide(F.coalesce(a, F.lit(0.0)) + F.when(absent == 0, F.lit(0.0)).otherwise(filled), cells)
    elif what == "mins":
        out = F.least(a, filled)
    elif what == "maxs":
        out = F.greatest(a, filled)
    elif what in ("vars", "sds"):
        seen = n - na
        apart = F.when((absent == 0) | (seen == 0), 0.0).otherwise(seen * absent / cells * (F.col("__b") - f) * (F.col("__b") - f))
        out = F.when(cells > 1, (F.coalesce(a, F.lit(0.0)) * seen + apart) / F.when(cells > 1, cells - 1))
        out = F.sqrt(out) if what == "sds" else out
    else:
        counted = F.coalesce(a, F.lit(0)) + F.when(F.coalesce(f == _target(x, what, value), F.lit(False)), absent).otherwise(F.lit(0))
        out = (cells if what == "nnzs" else F.lit(0)) + counted * (-1 if what == "nnzs" else 1)
        out = out.cast("long")
    return out if na_rm else F.when(na > 0, None).otherwise(out)


def summary(x, what: str, na_rm: bool = False) -> Any:
    """sum, prod, min, max, range, any or all of a whole array, in one aggregation."""
    if what not in ("sum", "prod", "min", "max", "range", "any", "all"):
        raise ValueError("no such summary")
    return tuple(summary_df(x, na_rm).select(*(["min", "max"] if what == "range" else [what])).first())[slice(None) if what == "range" else 0]


def summary_df(x, na_rm: bool = False) -> DataFrame:
    """All summaries of an array in one row: sum, prod, min, max, any, all."""
    if x.type == "character":
        raise TypeError("summaries need numbers")
    v, f = N.number(F.col("__v")), N.number(x.fill)
    truth, missing = F.col("__v").cast("boolean") if x.type == "logical" else v != 0, F.count_if(F.col("__v").isNull())
    got = x.rows("__v").agg(
        F.count(F.lit(1)).alias("n"), missing.alias("na"), F.sum(v).alias("s"), F.min(v).alias("lo"), F.max(v).alias("hi"), F.bool_or(truth).alias("some"), F.bool_and(truth).alias("every"),
        F.count_if(v == 0).alias("zeros"), F.count_if(v < 0).alias("minus"), F.sum(F.when(v != 0, F.ln(F.abs(v)))).alias("logs"), F.product(v).alias("p"),
    )
    absent = F.lit(x.size).cast("long") - F.col("n")
    more = absent > 0
    guard = lambda c: c if na_rm else F.when(F.col("na") > 0, None).otherwise(c)
    return got.select(
        guard(F.coalesce(F.col("s"), F.lit(0.0)) + F.when(more, f * absent).otherwise(0.0)).alias("sum"),
        guard(F.coalesce(F.col("p"), F.lit(1.0)) * F.when(more, F.pow(f, absent.cast("double"))).otherwise(1.0)).alias("prod"),
        guard(F.least("lo", F.when(more, f))).alias("min"),
        guard(F.greatest("hi", F.when(more, f))).alias("max"),
        guard(F.coalesce(F.col("some"), F.lit(False)) | (more & (f != 0))).alias("any"),
        guard(F.coalesce(F.col("every"), F.lit(True)) & (~more | (f != 0))).alias("all"),
    )
