"""Products by tiles: cells meet in the tiles of the result that they have a part in.

The result's rows and columns are cut into tiles of a fixed side. A cell of the left side goes to
the tiles of its row, one of the right side to those of its column; a tile's task multiplies
what it gets, contracted key by contracted key, as dense blocks or pair by pair, whichever is
cheaper, into one dense tile. So a task holds a tile and a stretch of cells whatever the
input's size; a heavy contracted key is spread over all tiles; no row is made for a pair of
cells. If there are fewer tiles than tasks, contracted keys are dealt into shares as well, and a second
stage adds a tile's partial sums row by row.

Where there are many tiles, cells are first dealt by contracted key. A task takes stretches of whole keys, and
for each tile in which a key has cells of both sides it sends one compressed row with these cells of all keys of
the stretch, so that what is shuffled is a few bytes a cell and tile. A key of very many cells is sent piece by piece to
all tiles of its cells' rows and columns, and meets itself there.

A result is a table of tile rows: the row's place, and the places and values of its non-zero
cells in that tile. It is opened to cells only when they are asked for.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import narrow_rows, stored_table

SIDE = 2048
#: Cells of the contracted blocks that a task multiplies at once.
BLOCK = 2_000_000
#: Pairs that are added up one by one at once.
PAIRS = 4_000_000
SCHEMA = "i long, j long, a long, bs array<long>, vs array<double>"
#: Cells of a stretch of whole keys; cells from which on a key is sent in pieces; pairs of runs that are sorted by tile at once.
STRETCH, HOT, RUN_PAIRS = 1 << 20, 1 << 21, 1 << 24
#: A stretch: its key, if it is a piece of one; its pairs and numbers of cells; keys, places and values of the cells of either side.
STRETCHES = "key long, pairs double, n long, m long, k binary, p binary, v binary, k2 binary, p2 binary, v2 binary"
#: What a stretch sends to a tile: numbers of cells of each run of a key on the left and on the right, the cells' places in the tile and values.
PACKED = "i long, j long, share int, key long, runs int, cells int, n binary, p binary, v binary"
_TYPES = {"int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "binary": pa.binary()}
#: Bytes of such rows that are handed on at once.
OUT_BYTES = 4 << 20


def _row_lists(i: int, j: int, a: np.ndarray, b: np.ndarray, v: np.ndarray) -> pa.RecordBatch:
    """Cells, sorted by row, as tile rows."""
    at = np.flatnonzero(np.r_[True, np.diff(a) != 0])
    offsets = pa.array(np.r_[at, len(a)].astype(np.int32))
    columns = [pa.array(np.full(len(at), i)), pa.array(np.full(len(at), j)), pa.array(a[at]), pa.ListArray.from_arrays(offsets, pa.array(b)), pa.ListArray.from_arrays(offsets, pa.array(v))]
    return pa.RecordBatch.from_arrays(columns, names=["i", "j", "a", "bs", "vs"])


def _lists(tile: np.ndarray, row: int, col: int, i: int, j: int, turned: bool = False, step: int = 256) -> Iterator[pa.RecordBatch]:
    """A dense tile, or its transpose, as tile rows, a few at a time; all at once if they hold few cells."""
    if 8 * np.count_nonzero(tile) < tile.size:
        flat = np.flatnonzero(tile != 0)
        r, c = np.divmod(flat, tile.shape[1])
        v = tile.reshape(-1)[flat]
        if turned:
            order = np.argsort(c.astype(np.uint16) if tile.shape[1] <= 1 << 16 else c, kind="stable")
            r, c, v = c[order], r[order], v[order]
        if len(r):
            yield _row_lists(i, j, r + row, c + col, v)
        return
    tile = tile.T if turned else tile
    for at in range(0, len(tile), step):
        part = np.ascontiguousarray(tile[at : at + step])
        r, c = np.divmod(np.flatnonzero(part != 0), part.shape[1])
        if len(r):
            yield _row_lists(i, j, r + at + row, c + col, part[r, c])


def _add(tile: np.ndarray, left: tuple, right: tuple) -> None:
    """Adds the products of cells (key, place, value) of whole keys, both sorted by key."""
    if not len(left[0]) or not len(right[0]):
        return
    (la, lb), (ra, rb) = ((at, np.r_[at[1:], len(k)]) for k, at in ((k, np.flatnonzero(np.r_[True, np.diff(k) != 0])) for k in (left[0], right[0])))
    keys, others = left[0][la], right[0][ra]
    if not np.array_equal(keys, others):  # packed cells come with their partners
        keys, one, two = np.intersect1d(keys, others, assume_unique=True, return_indices=True)
        la, lb, ra, rb = la[one], lb[one], ra[two], rb[two]
    if not len(keys):
        return
    pairs = (lb - la) * (rb - ra)
    # A dense block costs a multiplication for each cell of the tile and key, a pair about fifty of them.
    if 50 * pairs.sum() >= len(keys) * tile.size:
        per = max(1, BLOCK // sum(tile.shape))
        for at in range(0, len(keys), per):
            some = keys[at : at + per]
            x, y = (np.zeros((len(some), n)) for n in tile.shape)
            for dense, (k, p, v) in ((x, left), (y, right)):
                a, b = np.searchsorted(k, some[0]), np.searchsorted(k, some[-1], "right")
                row = np.minimum(np.searchsorted(some, k[a:b]), len(some) - 1)
                use = some[row] == k[a:b]
                np.add.at(dense, (row[use], p[a:b][use]), v[a:b][use])
            tile += x.T @ y
        return
    # Each cell on the left meets the stretch of its key on the right.
    key = np.repeat(np.arange(len(keys)), lb - la)
    cell = np.arange(len(key)) - np.repeat(np.cumsum(lb - la) - (lb - la), lb - la) + la[key]
    many = (rb - ra)[key]
    ends = np.cumsum(many)
    at = 0
    while at < len(cell):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PAIRS, "right")))
        n = many[at:to]
        of = np.repeat(np.arange(at, to), n)
        other = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n) + ra[key[of]]
        place = left[1][cell[of]] * tile.shape[1] + right[1][other]
        np.add.at(tile.reshape(-1), place, left[2][cell[of]] * right[2][other])
        at = to


def _squeezed(x: np.ndarray) -> bytes:
    """Numbers, compressed byte by byte: first the lowest bytes of all, then the next ones."""
    apart = np.ascontiguousarray(x).view(np.uint8).reshape(len(x), x.itemsize)
    return pa.compress(b"".join(apart[:, i].tobytes() for i in range(x.itemsize)), codec="zstd", asbytes=True)


def _numbers(squeezed: bytes, kind: type, n: int) -> np.ndarray:
    size = np.dtype(kind).itemsize
    raw = np.frombuffer(pa.decompress(squeezed, decompressed_size=n * size, codec="zstd", asbytes=True), np.uint8)
    out = np.empty((n, size), np.uint8)
    for i in range(size):
        out[:, i] = raw[i * n : (i + 1) * n]
    return out.view(kind).ravel()


def _spans(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ..., n[0] numbers of them, then those of start[1]."""
    return np.repeat(start - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))


Cells = tuple[np.ndarray, np.ndarray, np.ndarray]  # keys, places and values
Stretch = tuple[int | None, Cells, Cells]


def _stretched(batches: Iterator[pa.RecordBatch]) -> Iterator[Stretch]:
    """Cells (k, right, p, v), sorted by the first three, in stretches of whole keys; those of a key with more cells than HOT in pieces, each with its key."""
    held, n, limit, hot = [], 0, STRETCH, None

    def made(key: int | None, a: int, z: int, columns: list[np.ndarray]) -> Stretch:
        k, right, p, v = (c[a:z] for c in columns)
        return key, (k[~right], p[~right], v[~right]), (k[right], p[right], v[right])

    for b in itertools.chain(batches, [None]):
        if b is not None:
            if b.num_rows:
                held.append([np.asarray(c.to_numpy(zero_copy_only=False)) for c in b.columns])
                n += b.num_rows
            if n < limit:
                continue
        if not held:
            continue
        columns = [np.concatenate(c) for c in zip(*held, strict=True)]
        k, at = columns[0], 0
        if hot is not None:
            at = int(np.searchsorted(k, hot, "right"))
            if at:
                yield made(hot, 0, at, columns)
            hot = hot if at == len(k) else None
        cut = len(k) if b is None else max(at, int(np.searchsorted(k, k[-1])))
        if cut > at:
            yield made(None, at, cut, columns)
        elif at < len(k) and len(k) - at >= HOT:
            hot, cut = int(k[-1]), len(k)
            yield made(hot, at, cut, columns)
        held, n = ([[c[cut:] for c in columns]], len(k) - cut) if cut < len(k) else ([], 0)
        limit = n + STRETCH


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    fields = [f.split() for f in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, _TYPES[kind]) for c, (_, kind) in zip(zip(*rows, strict=True), fields, strict=True)], names=[name for name, _ in fields])


def _stored(symmetric: bool):
    """Cells, sorted as for _stretched(), to rows of stretches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, left, right in _stretched(batches):
            n, m = len(left[0]), len(left[0] if symmetric else right[0])
            pairs = None
            if key is None:
                keys, each = np.unique(left[0], return_counts=True)
                there = each if symmetric else np.searchsorted(right[0], keys, "right") - np.searchsorted(right[0], keys)
                pairs = float(each.astype(np.float64) @ there)
            yield _batch([(key, pairs, n, m, *map(_squeezed, (*left, *right)))], STRETCHES)

    return run


def _restored(symmetric: bool):
    """The reverse of _stored()."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[Stretch]:
        for b in batches:
            for row in range(b.num_rows):
                key, _, n, m, *columns = (c[row].as_py() for c in b.columns)
                cells = [_numbers(c, kind, size) for c, kind, size in zip(columns, (np.int64, np.int64, np.float64) * 2, (n,) * 3 + (0 if symmetric else m,) * 3, strict=True)]
                yield key, tuple(cells[:3]), tuple(cells[3:])

    return run


def _packed(side: int, shape: tuple[int, int], shares: int, symmetric: bool):
    """Stretches to what they send to each tile."""
    across, place = -(-shape[1] // side), np.uint16 if side <= 1 << 16 else np.uint32
    down = -(-shape[0] // side)
    number = np.uint16 if down * across <= 1 << 16 else np.int64  # the shorter one is sorted by its digits

    def runs(k: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, ...]:
        """Key, tile, first cell and number of cells of each stretch of one key and tile."""
        if not len(k):
            return (np.zeros(0, np.int64),) * 4
        t = p // side
        at = np.flatnonzero(np.r_[True, (np.diff(k) != 0) | (np.diff(t) != 0)])
        return k[at], t[at], at, np.diff(np.r_[at, len(k)])

    def sent(key: int | None, left: Cells, right: Cells) -> Iterator[tuple]:
        a, b = runs(*left[:2]), runs(*(left if symmetric else right)[:2])
        share = int((left if len(left[0]) else right)[0][0]) % shares
        b_cells = left if symmetric else right

        def row(i: int, j: int, x: np.ndarray, y: np.ndarray, n: np.ndarray, m: np.ndarray) -> tuple:
            one, two = _spans(x, n), _spans(y, m)
            p = np.concatenate([left[1][one] - i * side, b_cells[1][two] - j * side]).astype(place)
            return i, j, share, key, len(n), len(p), *map(_squeezed, (np.concatenate([n, m]).astype(np.uint32), p, np.concatenate([left[2][one], b_cells[2][two]])))

        none = np.zeros(1, np.int64)
        if key is not None:  # a piece of a key goes to all tiles of its cells' rows and columns
            for t, at, n in zip(*a[1:], strict=True):
                for j in range(int(t) if symmetric else 0, across):
                    yield row(int(t), j, np.r_[at], none, np.r_[n], none)
            for t, at, n in zip(*b[1:], strict=True):
                for i in range(int(t) if symmetric else down):
                    yield row(i, int(t), none, np.r_[at], none, np.r_[n])
            return
        # each run on the left meets its key's runs on the right; in a symmetric product, those on and above the diagonal
        first = np.arange(len(a[0])) if symmetric else np.searchsorted(b[0], a[0])
        many = np.searchsorted(b[0], a[0], "right") - first
        ends, at = np.cumsum(many), 0
        while at < len(many):
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + RUN_PAIRS, "right")))
            x = np.repeat(np.arange(at, to, dtype=np.int32), many[at:to])
            y = _spans(first[at:to], many[at:to]).astype(np.int32)
            tile = a[1][x].astype(number) * number(across) + b[1][y].astype(number)
            order = np.argsort(tile, kind="stable")
            x, y, tile = x[order], y[order], tile[order]
            edges = np.flatnonzero(np.r_[True, np.diff(tile) != 0]) if len(tile) else []
            for f, z in zip(edges, [*edges[1:], len(tile)]):
                i, j = divmod(int(tile[f]), across)
                m = b[3][y[f:z]]
                yield row(i, j, a[2][x[f:z]], b[2][y[f:z]], a[3][x[f:z]], np.zeros_like(m) if symmetric and i == j else m)
            at = to

    def run(stretches: Iterator[Stretch]) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for s in stretches:
            for r in sent(*s):
                rows.append(r)
                held += sum(map(len, r[-3:])) + 100
                if held >= OUT_BYTES:
                    yield _batch(rows, PACKED)
                    rows, held = [], 0
        if rows:
            yield _batch(rows, PACKED)

    return run


def _unpacked(side: int):
    """Packed rows, sorted by i, j, share and key, to cells (i, j, share, k, right, p, v); a batch holds whole keys of one tile, numbered anew."""
    place = np.uint16 if side <= 1 << 16 else np.uint32
    names = ["i", "j", "share", "k", "right", "p", "v"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, last, held, n, keys = None, None, [], 0, 0

        def cells() -> pa.RecordBatch:
            columns = [np.concatenate(c) for c in zip(*held, strict=True)]  # each side's cells are in the order of their keys
            return pa.RecordBatch.from_arrays([*[pa.array(np.full(n, x)) for x in now], *map(pa.array, columns)], names=names)

        for b in batches:
            for i, j, share, key, runs, size, counts, p, v in zip(*(c.to_pylist() for c in b.columns), strict=True):
                # pieces of a key stay together, as they meet each other; what else there is may be taken in parts
                if held and ((i, j, share) != now or key != last or (key is None and n >= BLOCK // 4)):
                    yield cells()
                    held, n, keys = [], 0, 0
                now, last = (i, j, share), key
                each = _numbers(counts, np.uint32, 2 * runs).astype(np.int64).reshape(2, runs)
                k = np.concatenate([np.repeat(np.arange(runs), e) for e in each]) + (keys if key is None else 0)
                right = np.arange(size) >= each[0].sum()
                held.append((k, right, _numbers(p, place, size).astype(np.int64) + np.where(right, j, i) * side, _numbers(v, np.float64, size)))
                n, keys = n + size, keys + runs
        if held:
            yield cells()

    return run


def _multiply(side: int, shape: tuple[int, int], symmetric: bool, whole: bool = False):
    """Rows (i, j, share, k, right, p, v), sorted by the first four, to tile rows (of partial sums, a share each). whole: a batch holds whole keys, whatever its place among others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, tile, held = None, None, None

        def opened(i: int, j: int) -> np.ndarray:
            return np.zeros((min(side, shape[0] - i * side), min(side, shape[1] - j * side)))

        def flush(final: bool) -> None:
            nonlocal held
            k, right, p, v = held
            if not len(k):
                return
            cut = len(k) if final else int(np.searchsorted(k, k[-1], "left"))
            if not cut:
                return
            i, j, _ = now
            parts = []
            for is_right, first in ((False, i * side), (True, j * side)):
                use = np.flatnonzero((right[:cut] == is_right) | (symmetric and i == j))
                parts.append((k[use], p[use] - first, v[use]))
            _add(tile, *parts)
            held = [x[cut:] for x in held]

        def closed() -> Iterator[pa.RecordBatch]:
            flush(True)
            i, j, _ = now
            yield from _lists(tile, i * side, j * side, i, j)
            if symmetric and i != j:
                yield from _lists(tile, j * side, i * side, j, i, True)

        for b in batches:
            i, j, share, k, right, p, v = (np.asarray(c.to_numpy(zero_copy_only=False)) for c in b.columns)
            edges = np.flatnonzero((np.diff(i) != 0) | (np.diff(j) != 0) | (np.diff(share) != 0)) + 1
            for a, z in zip([0, *edges], [*edges, len(i)]):
                if a == z:
                    continue
                key = (int(i[a]), int(j[a]), int(share[a]))
                if key != now:
                    if now is not None:
                        yield from closed()
                    now, tile, held = key, opened(*key[:2]), [x[a:z] for x in (k, right, p, v)]
                else:
                    held = [np.concatenate([h, x[a:z]]) for h, x in zip(held, (k, right, p, v))]
                if whole or len(held[0]) > BLOCK // 4:
                    flush(whole)
        if now is not None:
            yield from closed()

    return run


def _added(side: int, shape: tuple[int, int]):
    """Tile rows, sorted by i and j, to those of their sums."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, tile = None, None
        for b in batches:
            for n, (i, j, a) in enumerate(zip(*(b.column(c).to_pylist() for c in range(3)), strict=True)):
                if (i, j) != now:
                    if now is not None:
                        yield from _lists(tile, now[0] * side, now[1] * side, *now)
                    now, tile = (i, j), np.zeros((min(side, shape[0] - i * side), min(side, shape[1] - j * side)))
                tile[a - i * side, np.asarray(b.column(3)[n].values) - j * side] += np.asarray(b.column(4)[n].values)
        if now is not None:
            yield from _lists(tile, now[0] * side, now[1] * side, *now)

    return run


#: From so many tiles along a side on, cells go only to tiles in which their contracted key has a partner.
MANY = 2


def _by_key(left: DataFrame, right: DataFrame | None) -> DataFrame:
    """Cells (k, right, p, v) of both sides, each task's sorted by the first three."""

    def typed(cells: DataFrame, is_right: bool) -> DataFrame:
        return cells.select(F.col("k").cast("long").alias("k"), F.lit(is_right).alias("right"), F.col("p").cast("long").alias("p"), F.col("v").cast("double").alias("v"))

    both = typed(left, False) if right is None else typed(left, False).unionByName(typed(right, True))
    return both.where(F.col("k").isNotNull() & F.col("p").isNotNull()).repartition("k").sortWithinPartitions("k", "right", "p")


def stretches(left: DataFrame, right: DataFrame | None) -> DataFrame:
    """The cells of a product's sides, as stored stretches of whole contracted keys: they tell pairs(), and product() takes them."""
    with narrow_rows(left.sparkSession):
        return stored_table(_by_key(left, right).mapInArrow(_stored(right is None), STRETCHES), "stretches")


def pairs(stored: DataFrame) -> float:
    """How many pairs of cells share a contracted key."""
    each = stored.groupBy("key").agg(F.sum("pairs").alias("pairs"), (F.sum("n").cast("double") * F.sum("m")).alias("of"))
    return each.agg(F.coalesce(F.sum(F.when(F.col("key").isNull(), F.col("pairs")).otherwise(F.col("of"))), F.lit(0.0))).first()[0]


def product(left: DataFrame, right: DataFrame | None, shape: tuple[int, int], side: int = SIDE, shares: int | None = None, partners: bool = False, stored: DataFrame | None = None) -> DataFrame:
    """Tile rows of a product. left, right: cells (k, p, v): contracted place, place in the result, value; right None: left's cells, for a symmetric result.

    shares: into how many parts the contracted keys are dealt; by default, so many that every core has two tiles.
    partners: whether a cell goes only to the tiles in which its key has a cell of the other side, packed with other
    keys' cells; else it goes to all tiles of its row or column, as a row. stored: the cells' stretches(), for partners.
    """
    spark = left.sparkSession
    tiles = [max(1, -(-n // side)) for n in shape]
    count = tiles[0] * (tiles[0] + 1) // 2 if right is None else tiles[0] * tiles[1]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    if shares is None:
        shares = max(1, -(-min(parts, 2 * spark.sparkContext.defaultParallelism) // count))
    multiply = _multiply(side, shape, right is None, partners)
    if partners:
        pack, unpack = _packed(side, shape, shares, right is None), _unpacked(side)
        if stored is None:
            packed = _by_key(left, right).mapInArrow(lambda batches: pack(_stretched(batches)), PACKED)
        else:
            restored = _restored(right is None)
            packed = stored.mapInArrow(lambda batches: pack(restored(batches)), PACKED)
        met = packed.repartition(parts, "i", "j", "share").sortWithinPartitions("i", "j", "share", "key")
        out = met.mapInArrow(lambda batches: multiply(unpack(batches)), SCHEMA)
    else:
        out = _dealt(left, right, tiles, side, shares).mapInArrow(multiply, SCHEMA)
    if shares > 1:
        out = out.repartition("i", "j").sortWithinPartitions("i", "j").mapInArrow(_added(side, shape), SCHEMA)
    return out


def _dealt(left: DataFrame, right: DataFrame | None, tiles: list[int], side: int, shares: int) -> DataFrame:
    """Cells in all tiles of their row or column: rows (i, j, share, k, right, p, v), a tile's sorted by key."""
    share = F.pmod(F.xxhash64("k"), F.lit(shares)).cast("int")

    def dealt(cells: DataFrame, is_right: bool, others: Column) -> DataFrame:
        cells = cells.withColumn("own", F.floor(F.col("p") / side).cast("long"))
        cells = cells.where(F.col("own") > 0) if is_right and right is None else cells
        cells = cells.withColumn("other", F.explode(others))
        i, j = ("other", "own") if is_right else ("own", "other")
        return cells.select(F.col(i).alias("i"), F.col(j).alias("j"), share.alias("share"), "k", F.lit(is_right).alias("right"), "p", "v")

    first = F.lit(0).cast("long")
    last = [F.lit(t - 1).cast("long") for t in tiles]
    if right is None:  # the tiles on and above the diagonal
        both = dealt(left, False, F.sequence(F.col("own"), last[1])).unionByName(dealt(left, True, F.sequence(first, F.col("own") - 1)))
    else:
        both = dealt(left, False, F.sequence(first, last[1])).unionByName(dealt(right, True, F.sequence(first, last[0])))
    return both.repartition("i", "j", "share").sortWithinPartitions("i", "j", "share", "k")


def opened(rows: DataFrame) -> DataFrame:
    """Tile rows as cells a, b, value."""
    return rows.select("a", F.inline(F.arrays_zip(F.col("bs").alias("b"), F.col("vs").alias("value"))))
