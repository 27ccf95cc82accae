"""Composite work: normalisation of a count matrix and its principal components."""

from __future__ import annotations

from dataclasses import replace

import numpy as np
from pyspark.sql import functions as F

from ..session import stored_table
from .matrix import CoordMatrix, gram, sides
from .svd import svd

#: Up to so many rows a square of them is decomposed on the driver.
SQUARE_ROWS = 1024


def top_rows(x: CoordMatrix, n: int) -> list:
    """The keys of the n rows of largest variance, ties by key."""
    row = x.shown[0].name
    best = x.row_vars(complete=False).orderBy(F.desc("value"), row).limit(n)
    return [r[row] for r in best.collect()]


def stored(x: CoordMatrix) -> CoordMatrix:
    """x with its cells written to the shared folder once and read from there: work that follows does not repeat what made them."""
    dims = tuple(replace(d, restricted=False) for d in x.dims)
    return replace(x, df=stored_table(x.rows("value"), "cells"), dims=dims, value=F.col("value"), tables={})


def normalize(x: CoordMatrix, n_top: int) -> CoordMatrix:
    """Cells over their column's sum; the n_top rows of largest variance; log1p; over the row's deviation.

    The chosen rows' cells are written to the shared folder, as their deviations and the result both read them.
    """
    scaled = x.sweep(1, x.col_sums(complete=False), "/")
    row = scaled.dims[0]
    chosen = stored(scaled.subset(sorted(row.places_of(top_rows(scaled, n_top))), None, drop=False).math("log1p"))
    return chosen.sweep(0, chosen.row_sds(complete=False), "/")


def pca(x: CoordMatrix, k: int = 25, square_rows: int = SQUARE_ROWS) -> tuple[np.ndarray, np.ndarray]:
    """Standard deviations and loadings (rows of x by k) of the columns' principal components.

    Of few rows the covariances come from one Gram product and the row means, and are decomposed on
    the driver; of more than square_rows, svd() finds them without a square.
    """
    row, col = sides(x)
    n = len(col)
    if len(row) > square_rows:
        found = svd(x, k)
        return found.d / np.sqrt(max(1, n - 1)), found.u
    product, places = np.zeros((len(row), len(row))), row.places
    table = gram(x, "col", strategy="tiled").rows().toPandas()
    product[[places[a] for a in table.iloc[:, 0]], [places[b] for b in table.iloc[:, 1]]] = table["value"]
    means = np.zeros(len(row))
    for r in x.row_means(complete=False).collect():
        means[places[r[0]]] = r[1]
    values, vectors = np.linalg.eigh((product - n * np.outer(means, means)) / max(1, n - 1))
    order = np.argsort(-values)[:k]
    vectors = vectors[:, order]
    vectors *= np.where(vectors[np.abs(vectors).argmax(axis=0), np.arange(vectors.shape[1])] < 0, -1, 1)
    return np.sqrt(np.maximum(values[order], 0)), vectors
