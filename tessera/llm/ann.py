"""Approximate nearest neighbours by inner product, over robust-pruned graphs.

Rows with the same vector are one node that keeps the smallest ids, as many as an answer
can need. Nodes are dealt to shards by hash. In each shard a directed graph is grown in
batches: a greedy beam search on the graph so far proposes neighbours, and a candidate is
kept unless a kept one is nearer to it, by the factor alpha, than the node is. Graphs are a
table. Each block of queries beam-searches every shard; the shards' best are merged.

Inner products become distances by one more coordinate that brings all vectors of a shard
to one length, so any lengths will do. Scores are inner products in double precision of
the vectors as given.

Vectors that are null, empty, zero, or hold null or non-finite components take no part, nor
do rows without an id; a query meets only vectors of its own dimension. Rows that repeat
both id and vector count once. Ties go to the smaller id. An empty table gives an empty
result. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import stored

BATCH = 256


def _picked(x: np.ndarray, ids: np.ndarray) -> np.ndarray:
    return x[np.maximum(ids, 0)]


def beam_search(x: np.ndarray, links: np.ndarray, start: int, queries: np.ndarray, beam: int, width: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """The beam's nodes and inner products for each query, best first; -1 where there is none."""
    n, b = len(x), len(queries)
    ids = np.full((b, beam), -1, np.int64)
    score = np.full((b, beam), -np.inf, np.float32)
    open_ = np.zeros((b, beam), bool)
    ids[:, 0], score[:, 0], open_[:, 0] = start, queries @ x[start], True
    seen = np.zeros((b, n), bool)
    seen[:, start] = True
    row = np.arange(b)
    while len(row):
        best = np.where(open_[row], score[row], -np.inf)
        take = np.argpartition(-best, min(width, beam - 1), axis=1)[:, :width]
        ok = np.take_along_axis(best, take, 1) > -np.inf
        go = ok.any(axis=1)
        row, take, ok = row[go], take[go], ok[go]
        if not len(row):
            break
        nodes = np.where(ok, ids[row[:, None], take], -1)
        open_[row[:, None], take] = False
        near = np.where(nodes[:, :, None] >= 0, _picked(links, nodes), -1).reshape(len(row), -1)
        fresh = (near >= 0) & ~seen[row[:, None], np.maximum(near, 0)]
        order = np.argsort(near, axis=1)
        ordered = np.take_along_axis(near, order, 1)
        again = np.zeros_like(fresh)
        again[:, 1:] = ordered[:, 1:] == ordered[:, :-1]
        twice = np.zeros_like(fresh)
        np.put_along_axis(twice, order, again, 1)
        fresh &= ~twice
        at = np.nonzero(fresh)
        seen[row[at[0]], near[at]] = True
        new = np.full(near.shape, -np.inf, np.float32)
        new[at] = np.einsum("ij,ij->i", queries[row[at[0]]], x[near[at]])
        all_score = np.concatenate([score[row], new], axis=1)
        keep = np.argpartition(-all_score, beam - 1, axis=1)[:, :beam]
        score[row] = np.take_along_axis(all_score, keep, 1)
        ids[row] = np.take_along_axis(np.concatenate([ids[row], np.where(fresh, near, -1)], axis=1), keep, 1)
        open_[row] = np.take_along_axis(np.concatenate([open_[row], fresh], axis=1), keep, 1)
    order = np.argsort(-score, axis=1, kind="stable")
    return np.take_along_axis(ids, order, 1), np.take_along_axis(score, order, 1)


def robust_prune(x: np.ndarray, nodes: np.ndarray, pools: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """Up to degree diverse neighbours of each node from its pool (-1 pads); all vectors have one length."""
    square = float(x[0] @ x[0]) if len(x) else 0.0
    vectors = _picked(x, pools)
    away = 2 * (square - np.einsum("bd,bcd->bc", x[nodes], vectors))
    alive = (pools >= 0) & (pools != nodes[:, None])
    order = np.argsort(np.where(alive, away, np.inf), axis=1, kind="stable")
    pools, away, alive = (np.take_along_axis(v, order, 1) for v in (pools, away, alive))
    alive[:, 1:] &= pools[:, 1:] != pools[:, :-1]
    vectors = np.take_along_axis(vectors, order[:, :, None], 1)
    between = 2 * (square - vectors @ vectors.transpose(0, 2, 1))
    out = np.full((len(nodes), degree), -1, np.int64)
    rows = np.arange(len(nodes))
    for i in range(degree):
        first = alive.argmax(axis=1)
        has = alive[rows, first]
        if not has.any():
            break
        out[has, i] = pools[has, first[has]]
        alive &= ~(has[:, None] & (alpha * alpha * between[rows, first] <= away))
        alive[rows, first] = False
    return out


def grow(x: np.ndarray, degree: int = 40, beam: int = 80, alpha: float = 1.2) -> tuple[np.ndarray, int]:
    """Links (node by degree, -1 pads) and the start node of a graph over vectors of one length."""
    n = len(x)
    links = np.full((n, degree), -1, np.int64)
    start = int(np.argmax(x @ x.mean(axis=0))) if n else 0
    order = np.random.default_rng(7).permutation(n)
    order = np.concatenate([[start], order[order != start]]).astype(np.int64) if n else order
    done = min(n, 64)
    first = order[:done]
    links[first] = robust_prune(x, first, np.tile(first, (done, 1)), degree, alpha)
    while done < n:
        batch = order[done : done + max(16, min(done, n // 20, BATCH))]
        near, _ = beam_search(x, links, start, x[batch], beam)
        links[batch] = robust_prune(x, batch, near, degree, alpha)
        to, of = links[batch].ravel(), np.repeat(batch, degree)
        of, to = of[to >= 0], to[to >= 0]
        by = np.argsort(to, kind="stable")
        to, of = to[by], of[by]
        targets, at, count = np.unique(to, return_index=True, return_counts=True)
        held = (links[targets] >= 0).sum(axis=1)
        room = held + count <= degree
        spot = np.arange(len(to)) - np.repeat(at, count)
        easy = np.repeat(room, count)
        links[to[easy], np.repeat(held, count)[easy] + spot[easy]] = of[easy]
        full = np.flatnonzero(~room)
        for part in np.array_split(full[np.argsort(count[full])], max(1, len(full) // 128)) if len(full) else []:
            pool = np.full((len(part), degree + count[part].max()), -1, np.int64)
            pool[:, :degree] = links[targets[part]]
            for k, i in enumerate(part):
                pool[k, degree : degree + count[i]] = of[at[i] : at[i] + count[i]]
            links[targets[part]] = robust_prune(x, targets[part], pool, degree, alpha)
        done += len(batch)
    return links, start


def _level(x: np.ndarray) -> np.ndarray:
    """x with a coordinate that brings every row to the longest row's length."""
    square = (x * x).sum(axis=1)
    rest = np.sqrt(np.maximum(square.max(initial=0.0) - square, 0.0))
    return np.concatenate([x, rest[:, None]], axis=1).astype(np.float32)


def _graph(degree: int, beam: int, alpha: float):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.reset_index(drop=True)
        links, start = grow(_level(np.array(pdf["v"].tolist(), np.float64)), degree, beam, alpha)
        return pdf.assign(node=np.arange(len(pdf), dtype=np.int64), start=np.int64(start), links=list(links))[["dim", "shard", "node", "start", "v", "ids", "links"]]

    return run


def _answers(beam: int, k: int):
    def run(graph: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(graph) and len(queries):
            graph = graph.sort_values("node")
            raw = np.array(graph["v"].tolist(), np.float64)
            x, links, start, ids = _level(raw), np.array(graph["links"].tolist()), int(graph["start"].iloc[0]), graph["ids"].tolist()
            asked = np.array(queries["v"].tolist(), np.float64)
            padded = np.concatenate([asked, np.zeros((len(asked), 1))], axis=1).astype(np.float32)
            keys = queries["q"].to_numpy()
            for at in range(0, len(asked), BATCH):
                found, _ = beam_search(x, links, start, padded[at : at + BATCH], beam)
                for i, nodes in enumerate(found):
                    nodes = nodes[nodes >= 0]
                    exact = raw[nodes] @ asked[at + i]
                    best = np.argsort(-exact, kind="stable")[: 2 * k]
                    rows = sorted((-exact[j], vec) for j in best for vec in ids[nodes[j]])[:k]
                    out += [(keys[at + i], vec, -s) for s, vec in rows]
        return pd.DataFrame(out, columns=["q", "vec_id", "score"]).astype({"q": "int64", "vec_id": "int64", "score": "float64"})

    return run


def usable(v: Column) -> Column:
    fine = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return v.isNotNull() & fine & F.exists(v, lambda c: c != 0)


def _smallest(k: int):
    """Of rows sorted by h, v and vec_id, the first k ids of each h and v, once each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, seen, count = None, None, 0
        for batch in batches:
            keep = []
            for h, v, vec in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                new = (h, v) != last
                count = 1 if new else count + (vec != seen)
                keep.append(new or (vec != seen and count <= k))
                last, seen = (h, v), vec
            yield batch.filter(pa.array(keep, pa.bool_()))

    return run


def nearest(vectors: DataFrame, queries: DataFrame | None = None, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", shard_rows: int = 8192, query_rows: int = 4096, degree: int = 40, build_beam: int = 80, beam: int = 160, alpha: float = 1.2) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found among all rows of vectors but the query's own.

    queries: rows of the same form; all of vectors if None. shard_rows and query_rows: about how
    many nodes and queries a task holds.
    """

    def plain(df: DataFrame) -> DataFrame:
        df = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
        return df.where(F.col("vec_id").isNotNull() & usable(F.col("v"))).withColumn("h", F.xxhash64("v"))

    rows = plain(vectors).select("h", "v", "vec_id")
    # Within each input partition first, so that a vector that fills the table moves few rows.
    few = _smallest(k + 1)
    sorted_ = rows.sortWithinPartitions("h", "v", "vec_id").mapInArrow(few, rows.schema)
    sorted_ = sorted_.repartition("h").sortWithinPartitions("h", "v", "vec_id").mapInArrow(few, rows.schema)
    nodes = sorted_.groupBy("h", "v").agg(F.slice(F.array_sort(F.collect_set("vec_id")), 1, k + 1).alias("ids"))
    nodes = stored(nodes.withColumn("dim", F.size("v")), "nodes")
    shards = max(1, round(nodes.count() / shard_rows))
    nodes = nodes.withColumn("shard", F.pmod(F.xxhash64("h", F.lit(5)), F.lit(shards)).cast("int")).select("dim", "shard", "v", "ids")
    schema = "dim int, shard int, node long, start long, v array<double>, ids array<long>, links array<long>"
    graph = stored(nodes.groupBy("dim", "shard").applyInPandas(_graph(degree, build_beam, alpha), schema), "graph")
    asked = stored(plain(vectors if queries is None else queries).select(F.col("vec_id").alias("query_id"), "h", "v"), "asked")
    distinct = asked.groupBy("h", "v").agg(F.min("query_id").alias("q"))
    distinct = stored(distinct.withColumn("dim", F.size("v")), "queries")
    blocks = max(1, round(distinct.count() / query_rows))
    block = F.pmod(F.xxhash64("q"), F.lit(blocks)).cast("int")
    all_shards = F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))
    each = distinct.select("dim", all_shards.alias("shard"), block.alias("block"), "q", "v")
    held = graph.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    on = ["dim", "shard", "block"]
    answers = held.groupBy(*on).cogroup(each.groupBy(*on)).applyInPandas(_answers(beam, k + 1), "q long, vec_id long, score double")
    best = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id")
    answers = answers.withColumn("nth", F.row_number().over(best)).where(F.col("nth") <= k + 1)
    named = asked.distinct().join(distinct.select("h", "v", "q"), ["h", "v"]).select("query_id", "q")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    out = named.join(answers, "q").where("vec_id <> query_id").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return out.select("query_id", "rank", "vec_id", "score")
