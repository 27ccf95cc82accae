"""Sweeping a margin's statistics through an array."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import replace
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import numeric as N
from ..plans.dims import spread_join

FUNCTIONS = {"*": N.multiply, "/": N.divide, "%/%": N.floor_divide, "%%": N.floor_mod}


def sweep(x, margin: int | Sequence[int], stats: Any, fun: str = "*"):
    """x with fun(cell, statistic of its margin) in every stored cell; cells not stored stay 0.

    margin: the place (from 0) of the dimension, or of several. stats: a sequence in the order of
    its levels, or a table of its keys and one more column, such as a margin's result.
    """
    if fun not in FUNCTIONS:
        raise ValueError(f"FUN must be one of {sorted(FUNCTIONS)}")
    if not x.zero_filled:
        raise ValueError("only arrays filled with zero can be swept")
    dims = [x.shown[m] for m in ([margin] if isinstance(margin, int) else margin)]
    keys, taken = [d.name for d in dims], set(x.df.columns)
    name = next(n for i in range(len(taken) + 1) if (n := f"__stat{i}") not in taken)
    rows = 1
    for d in dims:
        rows *= len(d)
    if isinstance(stats, DataFrame):
        other = [c for c in stats.columns if c not in keys]
        if len(other) != 1:
            raise ValueError("the statistics need one column beside the keys")
        table = stats.select(*keys, F.col(other[0]).cast("double").alias(name))
    else:
        stats = [None if s is None else float(s) for s in stats]
        if len(dims) != 1 or len(stats) != len(dims[0]):
            raise ValueError("the length of STATS must equal the extent of MARGIN")
        table = dims[0].valued(x.spark, stats, name)
    joined = spread_join(x.df, table, keys, rows)
    out = replace(x, df=joined, value=FUNCTIONS[fun](N.number(x.value), F.col(name)), fill=F.lit(0.0))
    return out
