"""Near-duplicate vectors by cosine, found by a forest of random-projection trees.

Equal vectors are one node. A tree parts the nodes again and again at the median of their
projections on a random direction; nodes near the cut go to both sides (spill), so that a pair
seldom parts. Medians come from samples of bounded size, first of all nodes, then of each leaf
that is still too large; every node is routed. Nodes that share a leaf of any tree are
compared in double precision, a pair in the first leaf that it shares only, so each link
counts once and no pair is ever written: a task gives a node's number of links and one edge to
a local root. Edges are united over the whole table.

Large tight groups would fill leaves that no cut can part. They are found in the sample as
balls: a pivot, and all nodes within half of the threshold's angle, which link with each other
without being compared. A ball's nodes are compared with the few nodes outside that lie within
one and a half of the angle, all of them, and leave the forest. A leaf that stays large all the same
is compared in blocks, a pair of blocks a task.

A pair below the threshold is never linked. One above it is missed only if every tree parts
it; at the defaults a cut does so with a probability of about half a percent at the threshold
itself, and by less nearer.

Defined results: vectors that are null, empty, zero, or hold null or non-finite components
link with nothing, nor do vectors of different dimensions. Every row is a vector of its own, also
where ids or whole rows repeat: equal vectors link. Ids may be null; a component's id is its
smallest one, null if it has none, and kept compares null as a value. An empty table gives an
empty result. Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ann import usable
from .common import dropped, lists, stored
from .components import connected

#: Of a leaf's nodes, so many are sampled for its cuts.
LEAF_SAMPLE = 1024
SAMPLE_BYTES = 16 << 20
#: Of so many sampled nodes, a ball holds this many at least.
BALL_SAMPLE, BALL_LEAST = 4096, 16
#: Leaves that are split in one round; the rest wait for the next one.
ROUND_LEAVES = 1 << 16
#: A broadcast of a row a leaf is asked for up to so many.
BROADCAST_ROWS = 1_000_000
DEEPEST = 50


def units(v: pa.Array, dim: int) -> np.ndarray:
    """A list column's vectors, brought to length one."""
    x = np.asarray(v.flatten(), dtype=np.float64).reshape(len(v), dim)
    return _unit(x)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True, initial=1e-300)  # no square overflows
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def direction(tree: int, depth: int, dim: int) -> np.ndarray:
    """The random direction of a tree's cuts at a depth."""
    g = np.random.default_rng((tree, depth, dim)).standard_normal(dim)
    return g / np.sqrt(g @ g)


def grow(u: np.ndarray, leaf: int, count: float, leaf_rows: int, margin: float, least: int = 32) -> list[tuple[int, float]]:
    """Cuts below a leaf that holds about count nodes, from a sample of them: (code, threshold).

    A code is the tree in the top byte and the place in the tree as in a heap (1 is the root).
    A threshold of infinity passes all nodes to the first side: that direction parts nothing.
    """
    tree, cuts = leaf >> 56, []
    open_ = [(leaf & ((1 << 56) - 1), np.arange(len(u)), 0)]
    while open_:
        at, rows, passed = open_.pop()
        depth = at.bit_length() - 1
        if len(rows) * count <= leaf_rows * len(u) or len(rows) < 2 * least or depth >= DEEPEST:
            continue
        p = u[rows] @ direction(tree, depth, u.shape[1])
        cut = float(np.median(p))
        left, right = rows[p <= cut + margin], rows[p > cut - margin]
        if len(left) + len(right) > 1.7 * len(rows):
            if passed < 3:
                open_.append((2 * at, rows, passed + 1))
                cuts.append((tree << 56 | at, math.inf))
            continue
        cuts.append((tree << 56 | at, cut))
        open_ += [(2 * at, left, 0), (2 * at + 1, right, 0)]
    return cuts


def route(u: np.ndarray, row: np.ndarray, leaf: np.ndarray, codes: np.ndarray, cuts: np.ndarray, margin: float) -> tuple[np.ndarray, np.ndarray]:
    """Rows and leaves below the given ones, by cuts in ascending order of codes; sorted by row and leaf."""
    done: list[tuple[np.ndarray, np.ndarray]] = []
    projections: dict[tuple[int, int], np.ndarray] = {}
    while len(row):
        at = np.minimum(np.searchsorted(codes, leaf), max(0, len(codes) - 1))
        on = codes[at] == leaf if len(codes) else np.zeros(len(leaf), bool)
        done.append((row[~on], leaf[~on]))
        row, leaf, cut = row[on], leaf[on], cuts[at[on]] if len(codes) else cuts
        tree, heap = leaf >> 56, leaf & ((1 << 56) - 1)
        depth = np.frexp(heap.astype(np.float64))[1] - 1
        p = np.zeros(len(row))
        for key in np.unique(tree * 64 + depth):
            t, d = int(key) // 64, int(key) % 64
            if (t, d) not in projections:
                projections[t, d] = u @ direction(t, d, u.shape[1])
            mine = tree * 64 + depth == key
            p[mine] = projections[t, d][row[mine]]
        left, right = p <= cut + margin, p > cut - margin
        below = tree << 56 | 2 * heap
        row, leaf = np.concatenate([row[left], row[right]]), np.concatenate([below[left], below[right] + 1])
    row, leaf = (np.concatenate([d[i] for d in done]) if done else x for i, x in enumerate((row, leaf)))
    order = np.lexsort((leaf, row))
    return row[order], leaf[order]


def pivots(u: np.ndarray, half: float, least: int) -> list[int]:
    """Sampled vectors that have least others or more of the sample, not in an earlier ball, within half the angle."""
    near = u @ u.T >= half
    left = np.ones(len(u), bool)
    out: list[int] = []
    while len(u):
        counts = near[:, left].sum(axis=1)
        best = int(counts.argmax())
        if counts[best] < least:
            break
        out.append(best)
        left &= ~near[best]
    return out


def merge(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Joins the groups of linked pairs; a label is the least place of its group."""
    while True:
        x, y = label[a], label[b]
        apart = x != y
        if not apart.any():
            return
        np.minimum.at(label, np.maximum(x, y)[apart], np.minimum(x, y)[apart])
        while (label[label] != label).any():
            label[:] = label[label]


def _shared_before(places: np.ndarray, a: np.ndarray, b: np.ndarray, leaf: int) -> np.ndarray:
    """Which pairs meet in a leaf before this one; places has a row of leaves each, -1 at the end."""
    out = np.zeros(len(a), bool)
    each = max(1, (1 << 22) // places.shape[1] ** 2)
    for at in range(0, len(a), each):
        x, y = places[a[at : at + each]], places[b[at : at + each]]
        x = np.where((x >= 0) & (x < leaf), x, -2)
        out[at : at + each] = (x[:, :, None] == y[:, None, :]).any(axis=(1, 2))
    return out


RESULT = "node long, links long, rep long, root long"


def _result(node: np.ndarray, links: np.ndarray, rep: np.ndarray, root: np.ndarray) -> pd.DataFrame:
    return pd.DataFrame({"node": node, "links": links, "rep": rep, "root": root})


def _compare(threshold: float):
    """Links within a leaf, or between two blocks of one."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        leaf, i, j = int(pdf["leaf"].iloc[0]), int(pdf["i"].iloc[0]), int(pdf["j"].iloc[0])
        pdf = pdf.sort_values(["block", "node"], ignore_index=True)
        u, copies, node = _unit(np.array(pdf["v"].tolist(), np.float64)), pdf["copies"].to_numpy(), pdf["node"].to_numpy()
        held = pdf["leaves"].to_numpy()
        places = np.full((len(pdf), max(map(len, held))), -1, np.int64)
        for r, leaves in enumerate(held):
            places[r, : len(leaves)] = leaves
        edge = int(np.searchsorted(pdf["block"].to_numpy(), j)) if i < j else len(pdf)
        links, label, touched = np.zeros(len(pdf), np.int64), np.arange(len(pdf)), np.zeros(len(pdf), bool)
        for at in range(0, edge, 512):
            rows = np.arange(at, min(edge, at + 512))
            first = edge if i < j else at
            near = u[rows] @ u[first:].T >= threshold
            a, b = np.nonzero(near)
            a, b = rows[a], b + first
            keep = a < b
            a, b = a[keep], b[keep]
            touched[a] = touched[b] = True
            merge(label, a, b)
            new = ~_shared_before(places, a, b, leaf)
            np.add.at(links, a[new], copies[b[new]])
            np.add.at(links, b[new], copies[a[new]])
        return _result(node[touched], links[touched], node[touched], node[label[touched]])

    return run


def _across(threshold: float):
    """Links between members of a ball and nodes outside of it."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        inner = pdf["inner"].to_numpy()
        u, copies = _unit(np.array(pdf["v"].tolist(), np.float64)), pdf["copies"].to_numpy()
        a, b = np.flatnonzero(inner), np.flatnonzero(~inner)
        links = np.zeros(len(pdf), np.int64)
        for at in range(0, len(a), 512):
            near = u[a[at : at + 512]] @ u[b].T >= threshold
            links[a[at : at + 512]] = near @ copies[b]
            links[b] += near.T @ copies[a[at : at + 512]]
        use = links > 0
        root = pdf["pivot"].to_numpy()
        return _result(pdf["node"].to_numpy()[use], links[use], pdf["rep"].to_numpy()[use], root[use])

    return run


def _placed(dim: int, trees: int, balls, half: float, far: float):
    """Each node's ball (-1: none), the balls it is to be compared with, and where it enters each tree."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nodes, vectors = balls.value
        for b in batches:
            u = units(b.column(b.schema.get_field_index("v")), dim)
            cos = u @ vectors.T
            inside = cos >= half
            ball = np.where(inside.any(axis=1), inside.argmax(axis=1), -1) if len(nodes) else np.full(len(u), -1)
            near = (cos >= far) & ((ball < 0)[:, None] | (np.arange(len(nodes)) < ball[:, None]))
            row, which = np.nonzero(near)
            free = (ball < 0).astype(np.int64) * trees
            roots = np.tile((np.arange(trees, dtype=np.int64) << 56) | 1, int((ball < 0).sum()))
            bounds = np.concatenate([[0], np.cumsum(free)])
            own = np.asarray(b.column(b.schema.get_field_index("node")))
            rep = np.where(ball >= 0, nodes[np.maximum(ball, 0)], own) if len(nodes) else own
            more = [pa.array(ball.astype(np.int32)), pa.array(rep), lists(which.astype(np.int32), np.searchsorted(row, np.arange(len(u) + 1))), lists(roots, bounds)]
            yield pa.RecordBatch.from_arrays([*b.columns, *more], names=[*b.schema.names, "ball", "rep", "near", "leaves"])

    return run


def _routed(dim: int, cuts, margin: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, at = cuts.value
        for b in batches:
            place = b.schema.get_field_index("leaves")
            column = b.column(place)
            row = np.repeat(np.arange(b.num_rows), np.diff(np.asarray(column.offsets)))
            row, leaf = route(units(b.column(b.schema.get_field_index("v")), dim), row, np.asarray(column.flatten()), codes, at, margin)
            yield b.set_column(place, "leaves", lists(leaf, np.searchsorted(row, np.arange(b.num_rows + 1))))

    return run


def _grown(leaf_rows: int, margin: float):
    """Cuts of a leaf from a sample of its rows; a leaf that cannot be parted says so."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        leaf, count = int(pdf["leaf"].iloc[0]), float(pdf["count"].iloc[0])
        cuts = grow(_unit(np.array(pdf["v"].tolist(), np.float64)), leaf, count, leaf_rows, margin)
        if not any(math.isfinite(c) for _, c in cuts):
            return pd.DataFrame({"code": [leaf], "cut": [0.0], "stuck": [True]})
        return pd.DataFrame(cuts, columns=["code", "cut"]).assign(stuck=False)

    return run


def _forest(nodes: DataFrame, dim: int, n: int, threshold: float, trees: int, leaf_rows: int, spill: float) -> tuple[DataFrame, DataFrame, list[int]]:
    """For the nodes of one dimension: links found (as RESULT), each node's rep and links within its ball, and pivots."""
    spark, sc = nodes.sparkSession, nodes.sparkSession.sparkContext
    angle = math.acos(threshold)
    half, far = math.cos(angle / 2) + 1e-9, math.cos(min(math.pi, 1.5 * angle)) - 1e-9
    margin = spill * math.sqrt(2 - 2 * threshold) / math.sqrt(dim)
    most = max(1024, min(16384, SAMPLE_BYTES // (8 * dim)))
    drawn = nodes.where(F.pmod(F.xxhash64("node", F.lit(3)), F.lit(n)) < most).select("node", "v").toArrow().combine_chunks()
    mixed = np.random.default_rng(1).permutation(len(drawn))
    own, u = np.asarray(drawn["node"].combine_chunks())[mixed], units(drawn["v"].combine_chunks(), dim)[mixed]
    first = u[:BALL_SAMPLE]
    centres = pivots(first, half, BALL_LEAST) if len(u) >= 4 * BALL_LEAST else []
    balls = own[centres], u[centres].reshape(len(centres), dim)
    free = u[~((u @ balls[1].T) >= half).any(axis=1)] if centres else u
    n_free = n * len(free) / max(1, len(u))
    cuts = [c for t in range(trees) for c in grow(free, t << 56 | 1, n_free, leaf_rows, margin)] if len(free) else []
    schema = "node long, v array<double>, copies long, ball int, rep long, near array<int>, leaves array<long>"
    placed = nodes.select("node", "v", "copies").mapInArrow(_placed(dim, trees, sc.broadcast(balls), half, far), schema)
    stuck: list[int] = []
    while True:
        codes = np.array(sorted(c for c, _ in cuts), np.int64)
        at = np.array([c for _, c in sorted(cuts)], np.float64)
        before, placed = placed, stored(placed.mapInArrow(_routed(dim, sc.broadcast((codes, at)), margin), schema), "placed")
        if hasattr(before, "_tessera_path"):
            dropped(before)
        sizes = placed.select(F.explode("leaves").alias("leaf")).groupBy("leaf").count().where(F.col("count") > 2 * leaf_rows)
        known = spark.createDataFrame([(c,) for c in stuck], "leaf long")
        heavy = sizes.join(known, "leaf", "left_anti").orderBy(F.desc("count"), "leaf").limit(ROUND_LEAVES).collect()
        if not heavy:
            break
        large = spark.createDataFrame([(r["leaf"], r["count"]) for r in heavy], "leaf long, count long")
        rows = placed.select("node", "v", F.explode("leaves").alias("leaf")).join(F.broadcast(large), "leaf")
        rows = rows.where(F.pmod(F.xxhash64("node", "leaf"), F.col("count")) < LEAF_SAMPLE)
        made = rows.groupBy("leaf").applyInPandas(_grown(leaf_rows, margin), "code long, cut double, stuck boolean").collect()
        cuts = [(r["code"], r["cut"]) for r in made if not r["stuck"]]
        told = {r["code"] for r in made}
        stuck += [r["code"] for r in made if r["stuck"]] + [r["leaf"] for r in heavy if r["leaf"] not in told]

    blocks = F.ceil(F.col("count") / leaf_rows).cast("int")
    many = sizes.select("leaf", blocks.alias("blocks"))
    if len(stuck) <= BROADCAST_ROWS:
        many = F.broadcast(many)
    rows = placed.where("ball < 0").select("node", "v", "copies", "leaves", F.explode("leaves").alias("leaf")).join(many, "leaf", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("node", F.lit(9)), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("leaf", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "node", "v", "copies", "leaves")
    found = rows.groupBy("leaf", "i", "j").applyInPandas(_compare(threshold), RESULT)
    inner = placed.select("node", "rep", F.lit(0).cast("long").alias("inside"))
    if centres:
        weights = {r["ball"]: (r["weight"], r["n"]) for r in placed.where("ball >= 0").groupBy("ball").agg(F.sum("copies").alias("weight"), F.count(F.lit(1)).alias("n")).collect()}
        outside = {r["p"]: r["count"] for r in placed.select(F.explode("near").alias("p")).groupBy("p").count().collect()}
        table = [(p, int(balls[0][p]), w, -(-c // leaf_rows), -(-outside.get(p, 0) // leaf_rows)) for p, (w, c) in weights.items()]
        table = F.broadcast(spark.createDataFrame(table, "p int, pivot long, weight long, inner_blocks int, outer_blocks int"))
        inner = placed.join(table, placed["ball"] == table["p"], "left").select("node", "rep", F.coalesce(F.col("weight") - F.col("copies"), F.lit(0)).alias("inside"))
        members = placed.where("ball >= 0").withColumn("p", F.col("ball")).join(table, "p").where("outer_blocks > 0")
        members = members.select("p", "pivot", F.lit(True).alias("inner"), F.pmod(F.xxhash64("node"), F.col("inner_blocks")).cast("int").alias("i"), F.explode(F.expr("sequence(0, outer_blocks - 1)")).alias("j"), "node", "rep", "v", "copies")
        others = placed.withColumn("p", F.explode("near")).join(table, "p")
        others = others.select("p", "pivot", F.lit(False).alias("inner"), F.explode(F.expr("sequence(0, inner_blocks - 1)")).alias("i"), F.pmod(F.xxhash64("node"), F.col("outer_blocks")).cast("int").alias("j"), "node", "rep", "v", "copies")
        found = found.unionByName(members.unionByName(others).groupBy("p", "i", "j").applyInPandas(_across(threshold), RESULT))
    return found, inner, [int(x) for x in balls[0]]


def near_vectors(vectors: DataFrame, threshold: float = 0.95, trees: int = 6, leaf_rows: int = 1024, spill: float = 0.75, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """For each row: id, n_links (rows whose vector's cosine with it is threshold or more, as found), component_id and kept.

    spill: the margin on either side of a cut, in deviations of what a linked pair's projections
    are apart. leaf_rows: about how many nodes a task compares.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    rows = stored(rows.select(F.monotonically_increasing_id().alias("row"), "id", F.when(usable(F.col("v")), F.col("v")).alias("v")).withColumn("h", F.xxhash64("v")), "vectors")
    nodes = rows.where("v IS NOT NULL").groupBy("h", "v").agg(F.count(F.lit(1)).alias("copies"), F.min("row").alias("node"), F.min("id").alias("least"))
    nodes = stored(nodes, "nodes")
    found, inner, centres = spark.createDataFrame([], RESULT), spark.createDataFrame([], "node long, rep long, inside long"), []
    for dim, n in sorted(tuple(r) for r in nodes.groupBy(F.size("v").alias("dim")).count().collect()):
        more = _forest(nodes.where(F.size("v") == dim), dim, n, threshold, trees, leaf_rows, spill)
        found, inner, centres = found.unionByName(more[0]), inner.unionByName(more[1]), centres + more[2]
    found = stored(found, "links")
    roots = connected(found.select("rep", "root"))
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    each = nodes.join(inner, "node").join(links, "node", "left")
    each = each.withColumn("n_links", F.col("copies") - 1 + F.col("inside") + F.coalesce("links", F.lit(0)))
    each = stored(each.select("node", "h", "copies", "least", "rep", "n_links"), "each")
    # a ball's nodes have one rep, so the components' least ids go by reps, and pivots are few enough to broadcast
    reps = each.groupBy("rep").agg(F.min("least").alias("least")).join(roots.withColumnRenamed("node", "rep"), "rep", "left").withColumn("root", F.coalesce("root", "rep"))
    least = reps.groupBy("root").agg(F.min("least").alias("component_id"))
    named = stored(reps.join(least, "root").select("rep", "component_id"), "named")
    pivot = spark.createDataFrame([(c,) for c in centres], "rep long")
    few = F.broadcast(named.join(F.broadcast(pivot), "rep"))
    each = each.join(few, "rep").unionByName(each.join(F.broadcast(pivot), "rep", "left_anti").join(named, "rep")).drop("rep")
    # a vector of one row is that row; vectors of many rows meet them by value, the most frequent ones by broadcast
    hot = F.col("copies") > F.greatest(F.lit(1000), F.lit(rows.count() // 1000))
    values = nodes.where("copies > 1").select("node", "v").join(each, "node").select("h", "v", "copies", "n_links", "component_id")
    copies = rows.where("v IS NOT NULL").select("row", "h", "v")
    told = each.where("copies = 1").select(F.col("node").alias("row"), "n_links", "component_id")
    for part in (F.broadcast(values.where(hot)), values.where(~hot)):
        told = told.unionByName(copies.join(part, ["h", "v"]).select("row", "n_links", "component_id"))
    told = told.withColumn("told", F.lit(True))
    out = rows.select("row", "id").join(told, "row", "left")
    component = F.when(F.col("told"), F.col("component_id")).otherwise(F.col("id"))
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).alias("n_links"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))
