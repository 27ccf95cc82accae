"""Slabs of coordinates from a stream, appended to a dataset batch by batch."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql.streaming import DataStreamWriter

from ..operators.array import CoordArray
from ..plans.dims import Dim
from ..sources.writer import _exists, write_coo


def append_slabs(stream: DataFrame, path: str, index: Sequence[str], value: str, along: str, extent: int, sizes: Sequence[int], name: str = "slabs", **options) -> DataStreamWriter:
    """A writer whose every batch becomes one slab of `extent` places along a dimension.

    index: key columns, with places from 1 (along: within the slab). A batch's slab follows from
    its number, which the dataset keeps under the stream's name: a batch that is run again after a failure is passed
    over if its slab was committed, and written again if it was not, whatever it left on disk.
    """
    axis = list(index).index(along)

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        shape = [extent if i == axis else n for i, n in enumerate(sizes)]
        x = CoordArray.from_coo(batch, value, {n: Dim(n, range(1, s + 1), batch.schema[n].dataType) for n, s in zip(index, shape, strict=True)})
        there = _exists(spark, path)
        grid = [extent if i == axis else n for i, n in enumerate(sizes)]
        top = [2**31 - 1 if i == axis else n for i, n in enumerate(sizes)]
        # with a group offset the first slab is partitioned as the later ones are
        write_coo(x, path, index, value, grid=grid, append=there, along=along, offset=number * extent, group_offset=number + 1, max_dim=top, batch=(name, number), **options)

    return stream.writeStream.foreachBatch(write)
