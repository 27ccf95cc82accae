"""Connected components of a graph given as edges, by alternating large-star and small-star steps.

First each task replaces the edges that it holds, a bounded number at a time, by those from
their components' nodes to the least one, so that few steps are left. Every step is a
grouped minimum and a join; nothing is gathered on the driver but a count and a checksum,
which come with the writing. Each round is written to the shared folder, so lineage stays short.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from .common import dropped, stored

HELD = 1 << 18  # edges that a task replaces at once


def _stars(limit: int):
    """a, b: each node and the least of its component among the edges at hand, limit or a batch more at a time."""

    def made(held: list[np.ndarray]) -> pa.RecordBatch:
        nodes, at = np.unique(np.concatenate(held, axis=1), return_inverse=True)
        x, y = at.reshape(2, -1)
        root = np.arange(len(nodes))
        while (root[x] != root[y]).any():
            low, high = np.minimum(root[x], root[y]), np.maximum(root[x], root[y])
            np.minimum.at(root, high, low)
            while (root[root] != root).any():
                root = root[root]
        use = root != np.arange(len(nodes))
        return pa.RecordBatch.from_arrays([pa.array(nodes[use]), pa.array(nodes[root[use]])], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for batch in batches:
            held.append(np.stack([np.asarray(c, np.int64) for c in batch.columns]))
            if sum(h.shape[1] for h in held) >= limit:
                yield made(held)
                held = []
        if held:
            yield made(held)

    return run


def connected(edges: DataFrame) -> DataFrame:
    """node and root (the least node of its component) for nodes with edges other than loops.

    edges: two long columns, in any order, repeats and loops allowed.
    """
    first, second = edges.columns

    def written(df: DataFrame) -> tuple[DataFrame, tuple]:
        told = Observation()
        out = stored(df.observe(told, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("sum")), "edges")
        return out, (told.get["n"], told.get["sum"])

    now, mark = written(edges.select(F.col(first).alias("a"), F.col(second).alias("b")).where("a <> b").distinct().mapInArrow(_stars(HELD), "a long, b long"))
    while True:  # each round at least shortens paths, and the steps settle in about log(n) of them
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b")))
        new, seen = written(small.where("a <> b").distinct())
        dropped(now)
        now = new
        if seen == mark:
            break
        mark = seen
    roots = now.select("b").distinct().select(F.col("b").alias("node"), F.col("b").alias("root"))
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)
