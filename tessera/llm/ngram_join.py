"""Exact Jaccard join of word shingles by T-occurrence search.

Documents with the same set of shingles form a class, and only classes are compared.

1. Every class puts its rarest shingles into lists by shingle, so many that a partner at
   the threshold must share some of them: two, and one more for every 64 shingles. Rare means:
   of a low count, and among equals of many letters. Counts are kept by hash in a sketch of a
   fixed number of cells, over every shingle of every text. Any order would do; this one keeps
   lists short, and what stands out from the sketch's noise grows with the root of the input
   only, so there is no size at which it stops working.
2. Pairs that share so many short lists, and neighbours by size in long lists, are joined
   into candidate groups (connected components). Two classes that reach the threshold are
   always in one group, as they share long lists or enough short ones. Pairs of short
   lists go first through a bitmap filter: each set keeps the parities of its shingles by
   hash, and two sets differ in at least as many shingles as bits, which rules out nearly
   all pairs that merely share a passage.
3. Within a group the sets become inverted lists, and each set is searched as DivideSkip
   does: its short lists are merged with counts, what may still reach the required overlap
   is looked up in the long lists by binary search, and the exact overlap decides.
   Classes that are known to be connected already are not looked up again.
4. Groups of many shingles are dealt to blocks. Each block is searched within itself, and
   one set of each block's largest part against those of other blocks, a thousand at a time.
   A link between parts then always has an end outside its group's largest part, so every
   class outside it is looked for in every block: first by bitmaps, which are a hundredth of
   the sets' size, and only in blocks where some bitmap allows a link by the set itself. No
   set is copied to a block without such a hint, and a large group of near copies costs
   about its size.

Null, empty and blank texts have no shingles and are linked with nothing. Texts with
fewer words than a shingle have their whole sequence as one. A null id links nothing. Repeated
rows are documents of their own in one class; so are rows that share an id but not a text. Texts of any length are
read whole. Other columns are ignored, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, bitmap, dropped, has_bit, lists, mix, shingles, sized_shingles, slices, small_batches, stored

COUNTED = 1 << 20  # shingles that a task counts at once
CELLS = 1 << 23  # of the sketch
PART = 1 << 16  # cells of one row of the sketch
SHORT = 32  # a list of at most so many classes gives all its pairs
TOLD = 1 << 18  # classes that a task remembers to have listed
HEADS = 1000  # sets of blocks' largest parts that are compared in one task
WIDE = 4  # blocks whose bitmaps are compared in one task
HOT = 1000
STRONG = 1 << 40  # counts as shared often enough


def _long(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64) if x.dtype == np.uint64 else x.astype(np.int64))


def _class_of(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A fingerprint of each set: the mixed sum of its mixed hashes."""
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(h ^ np.uint64(0x5851F42D4C957F2D)))])
    n = np.diff(first).astype(np.uint64)
    return mix((sums[first[1:]] - sums[first[:-1]]) ^ (n * np.uint64(0x9E3779B97F4A7C15)))


def _parities(h: np.ndarray, first: np.ndarray) -> pa.Array:
    """A bitmap of each set, of 256 bits or about half as many as shingles: the parity of how many shingles a bit has."""
    n = np.diff(first)
    width = 1 << np.maximum(8, np.ceil(np.log2(np.maximum(n, 2))).astype(np.int64) - 1)
    start = np.concatenate([[0], np.cumsum(width)])
    place = mix(h ^ np.uint64(0xD6E8FEB86659FD93)) & np.repeat(width - 1, n).astype(np.uint64)
    bits = np.bincount(np.repeat(start[:-1], n) + place.astype(np.int64), minlength=start[-1]) & 1
    data = np.packbits(bits.astype(np.uint8), bitorder="little")
    return pa.BinaryArray.from_buffers(pa.binary(), len(n), [None, pa.py_buffer((start // 8).astype(np.int32)), pa.py_buffer(data)])


def _folded(bits: bytes, size: int) -> int:
    """The bitmap that size bytes would have given."""
    out = 0
    for at in range(0, len(bits), size):
        out ^= int.from_bytes(bits[at : at + size], "little")
    return out


def _possible(percent: int):
    """Pairs whose bitmaps allow the threshold, and those that long lists gave."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for n, m, x, y, strong in zip(*(batch.column(i).to_pylist() for i in range(2, 7)), strict=True):
                size = min(len(x), len(y))
                spare = n + m - 2 * -(-percent * (n + m) // (100 + percent))
                keep.append(strong or (_folded(x, size) ^ _folded(y, size)).bit_count() <= spare)
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return run


def _signatures(size: int):
    """doc, n, class and bitmap of each document; with n below 0, class is a part of the sketch and bits its cells' counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        sketch = np.zeros(CELLS, np.uint32)

        def count() -> None:
            cell, n = np.unique(np.concatenate([*held, np.zeros(0, np.int32)]), return_counts=True)
            held.clear()
            sketch[cell] += n.astype(np.uint32)

        for batch in batches:
            for part in slices(batch):
                h, first = shingles(Words(part.column(1)), size)
                yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), _long(np.diff(first)), _long(_class_of(h, first)), _parities(h, first)], names=["doc", "n", "class", "bits"])
                held.append(_cells(h))
                if sum(map(len, held)) > COUNTED:
                    count()
        count()
        for k in range(CELLS // PART):
            cells = np.minimum(sketch[k * PART : (k + 1) * PART], 0xFFFF).astype("<u2")
            if cells.any():
                packed = zlib.compress(cells.tobytes(), 1)
                yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.array([-1], pa.int64()), pa.array([k], pa.int64()), pa.array([packed], pa.binary())], names=["doc", "n", "class", "bits"])

    return run


def _cells(h: np.ndarray) -> np.ndarray:
    return (h & np.uint64(CELLS - 1)).astype(np.int32)


def _ranks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Eight times the binary logarithm of the cells' sums, a byte each; rows come by part."""
    now, total = None, np.zeros(PART, np.float64)

    def row() -> pa.RecordBatch:
        ranks = np.minimum(255, 8 * np.log2(1 + total)).astype(np.uint8)
        return pa.RecordBatch.from_arrays([pa.array([now], pa.int64()), pa.array([ranks.tobytes()], pa.binary())], names=["part", "ranks"])

    for batch in batches:
        for part, bits in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if part != now:
                if now is not None:
                    yield row()
                now, total = part, np.zeros(PART, np.float64)
            total += np.frombuffer(zlib.decompress(bits), "<u2")
    if now is not None:
        yield row()


def _shared(n: np.ndarray, percent: int) -> np.ndarray:
    """How many of its listed shingles a set of n must share with any partner."""
    return np.minimum(-(-percent * n // 100), 2 + n // 64)


def _prefixes(size: int, percent: int, ranks: np.ndarray):
    """token, class, n for the rarest n - T + k shingles of each set, k of _shared(). ranks: by cell of the sketch.

    A task lists a class once, or again when it has listed many others since.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        told: set[int] = set()
        for batch in batches:
            for part in slices(batch):
                h, first, letters = sized_shingles(Words(part.column(1)), size)
                n = np.diff(first)
                kind = _class_of(h, first)
                fresh = np.zeros(len(n), bool)
                for i, k in enumerate(kind.tolist()):
                    if k not in told:
                        fresh[i] = True
                        told.add(k)
                if len(told) > TOLD:
                    told.clear()
                use = np.repeat(fresh, n)
                h, letters, doc = h[use], letters[use], np.repeat(np.arange(len(n)), n)[use]
                start = np.concatenate([[0], np.cumsum(np.where(fresh, n, 0))])
                order = np.lexsort((h, -letters, ranks[_cells(h)], doc))
                nth = np.arange(len(h)) - start[doc]
                use = order[nth < (n + (-percent * n) // 100 + _shared(n, percent))[doc]]
                yield pa.RecordBatch.from_arrays([_long(h[use]), _long(kind[doc[use]]), _long(n[doc[use]])], names=["token", "class", "n"])

    return run


def _neighbours(percent: int):
    """a, b, shared, need: pairs of short lists, counted, and neighbours in long lists; rows come by token, n, class."""

    def pairs(rows: np.ndarray, fresh: int) -> np.ndarray:
        """Of whole lists, or with fresh > 0 of a list in progress, whose rows before that one have been paired."""
        token, kind, n = rows
        again = np.zeros(len(token), bool)
        again[1:] = (token[1:] == token[:-1]) & (kind[1:] == kind[:-1])
        token, kind, n = rows[:, ~again]
        size = np.searchsorted(token, token, "right") - np.searchsorted(token, token, "left")
        out = []
        for step in range(1, SHORT):
            a, b = slice(None, -step), slice(step, None)
            use = (token[a] == token[b]) & (100 * n[a] >= percent * n[b])
            use &= (size[a] <= SHORT) if not fresh else False
            if step == 1:
                use |= (token[a] == token[b]) & (100 * n[a] >= percent * n[b]) & ((size[a] > SHORT) | bool(fresh))
            if not use.any() and step > 1 and (fresh or step > size.max(initial=0)):
                break
            x, y, n_x, n_y = kind[a][use], kind[b][use], n[a][use], n[b][use]
            need = np.minimum(_shared(n_x, percent), _shared(n_y, percent))
            got = np.where((size[a][use] > SHORT) | bool(fresh), STRONG, 1)
            out.append(np.stack([np.minimum(x, y), np.maximum(x, y), got, need]))
        return np.concatenate([*out, np.zeros((4, 0), np.int64)], axis=1)

    def counted(found: np.ndarray) -> pa.RecordBatch:
        order = np.lexsort((found[1], found[0]))
        a, b, got, need = found[:, order]
        first = np.ones(len(a), bool)
        first[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        at = np.flatnonzero(first)
        got = np.add.reduceat(got, at) if len(at) else got
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (a[at], b[at], got, need[at])], names=["a", "b", "shared", "need"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, fresh = np.zeros((3, 0), np.int64), 0
        for batch in batches:
            rows = np.concatenate([held, np.stack([np.asarray(c) for c in batch.columns])], axis=1)
            if not rows.shape[1]:
                continue
            rows = rows[:, np.concatenate([[True], (rows[:, 1:] != rows[:, :-1]).any(axis=0)])]  # a class is listed once
            last = int(np.searchsorted(rows[0], rows[0, -1], "left"))  # the last list may go on
            done = rows[:, :last]
            if fresh:  # a long list was in progress: its end is paired by neighbours, the rest as usual
                first = int(np.searchsorted(rows[0], rows[0, 0], "right"))
                yield counted(pairs(rows[:, :first], 1))
                if first == rows.shape[1]:
                    held = rows[:, -1:]
                    continue
                done = rows[:, first:last]
            if done.shape[1]:
                yield counted(pairs(done, 0))
            held, fresh = rows[:, last:], 0
            if held.shape[1] > SHORT:
                yield counted(pairs(held, 1))
                held, fresh = held[:, -1:], 1
        if not fresh and held.shape[1]:
            yield counted(pairs(held, 0))

    return run


def _sets(size: int, bits: np.ndarray):
    """doc, class and set of the documents whose bit is set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pa.array(has_bit(bits, np.asarray(batch.column(2), np.int64))))
            for part in slices(batch):
                h, first = shingles(Words(part.column(1)), size)
                yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), _long(_class_of(h, first)), lists(h.view(np.int64), first)], names=["doc", "class", "set"])

    return run


class Index:
    """Inverted lists of sets, and the search for those that reach a Jaccard similarity."""

    MU = 0.0085  # how much dearer a lookup is than a step of the merge, after the DivideSkip paper

    def __init__(self, sets: list[np.ndarray], percent: int):
        self.percent = percent
        self.sizes = np.array([len(s) for s in sets], dtype=np.int64)
        owner = np.repeat(np.arange(len(sets)), self.sizes)
        flat = np.concatenate(sets) if sets else np.zeros(0, np.int64)
        order = np.lexsort((owner, flat))
        flat, self.owner = flat[order], owner[order]
        self.tokens, self.starts = np.unique(flat, return_index=True)
        self.starts = np.append(self.starts, len(flat))
        self.keys = np.repeat(np.arange(len(self.tokens)), np.diff(self.starts)) * len(sets) + self.owner  # ascending

    def search(self, query: np.ndarray, wanted: np.ndarray) -> np.ndarray:
        """Which of the wanted sets (a mask) reach the similarity with the query."""
        n, m = len(query), len(self.sizes)
        need = -(-self.percent * n // 100)
        if not n or len(self.tokens) == 0:
            return np.zeros(0, np.int64)
        at = np.searchsorted(self.tokens, query)
        at = at[(at < len(self.tokens)) & (self.tokens[np.minimum(at, len(self.tokens) - 1)] == query)]
        if len(at) < need:
            return np.zeros(0, np.int64)
        sizes = self.starts[at + 1] - self.starts[at]
        at = at[np.argsort(sizes, kind="stable")]
        n_long = min(need - 1, int(need / (self.MU * np.log2(max(2, sizes.max())) + 1)))
        short, long = at[: len(at) - n_long], at[len(at) - n_long :]
        begin, size = self.starts[short], self.starts[short + 1] - self.starts[short]
        spots = np.repeat(begin - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
        counts = np.bincount(self.owner[spots], minlength=m)
        found = np.flatnonzero((counts >= need - n_long) & wanted)
        found = found[(100 * self.sizes[found] >= self.percent * n) & (self.percent * self.sizes[found] <= 100 * n)]
        overlap = counts[found]
        step = max(1, (1 << 20) // max(1, len(found)))
        for i in range(0, len(long) if len(found) else 0, step):
            keys = long[i : i + step, None] * m + found[None, :]
            spot = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
            overlap = overlap + (self.keys[spot] == keys).sum(axis=0)
        return found[100 * overlap >= self.percent * (n + self.sizes[found] - overlap)]


def _within(percent: int):
    """Links that connect all that is connected within one block."""

    def run(block: pd.DataFrame) -> pd.DataFrame:
        block = block.drop_duplicates("class")
        kinds = block["class"].to_numpy()
        sets = [np.asarray(s, np.int64) for s in block["set"]]
        part = np.arange(len(sets))  # the part of each set
        out = []
        if len(sets) > 1:
            index = Index(sets, percent)
            for i, query in enumerate(sets):
                for j in index.search(query, part != part[i]):
                    if part[j] != part[i]:
                        out.append((kinds[i], kinds[j]))
                        part[part == part[j]] = part[i]
        return pd.DataFrame(out, columns=["a", "b"], dtype=np.int64)

    return run


def _across(percent: int):
    """Links from the queries of a block to one member of each part that they reach in it."""

    def run(block: pd.DataFrame) -> pd.DataFrame:
        block = block.drop_duplicates(["class", "asked"])
        held, asked = block[~block["asked"]], block[block["asked"]]
        kinds, parts = held["class"].to_numpy(), held["part"].to_numpy()
        index = Index([np.asarray(s, np.int64) for s in held["set"]], percent)
        out = []
        for kind, part, query in zip(asked["class"], asked["part"], asked["set"], strict=True):
            found = index.search(np.asarray(query, np.int64), parts != part)
            _, one = np.unique(parts[found], return_index=True)
            out += [(kind, kinds[j]) for j in found[one]]
        return pd.DataFrame(out, columns=["a", "b"], dtype=np.int64)

    return run


def _words(bits: list[bytes], size: int) -> np.ndarray:
    """Bitmaps of one length as rows of 64-bit words, folded to size bytes."""
    rows = np.frombuffer(b"".join(bits), np.uint64).reshape(len(bits), -1, size // 8)
    return np.bitwise_xor.reduce(rows, axis=1)


def _hints(percent: int):
    """class (of a query) and block where some set's bitmap allows a link that is not known yet."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        held, asked = (rows[rows["asked"] == flag].drop_duplicates("class").sort_values("n") for flag in (False, True))
        held, asked = ({w: g for w, g in x.groupby(x["bits"].str.len())} for x in (held, asked))
        found: set[tuple[int, int]] = set()
        for wide, q in asked.items():
            for width, h in held.items():
                x, y = (_words(list(g["bits"]), min(wide, width)) for g in (q, h))
                n, part, block = (h[c].to_numpy() for c in ("n", "part", "block"))
                low = np.searchsorted(n, -(-percent * q["n"].to_numpy() // 100), "left")
                high = np.searchsorted(n, 100 * q["n"].to_numpy() // percent, "right")
                for i, (kind, size, own) in enumerate(zip(q["class"], q["n"], q["part"], strict=True)):
                    a, b = low[i], high[i]
                    if a == b:
                        continue
                    both = size + n[a:b]
                    near = np.bitwise_count(y[a:b] ^ x[i]).sum(axis=1) <= both - 2 * -(-percent * both // (100 + percent))
                    found.update((kind, int(k)) for k in np.unique(block[a:b][near & (part[a:b] != own)]))
        return pd.DataFrame(sorted(found), columns=["class", "block"], dtype=np.int64)

    return run


def _links(sets: DataFrame, maps: DataFrame, percent: int, blocks: int, block: int) -> DataFrame:
    """Links (a, b) between classes that connect all that the threshold connects, in each group.

    sets: grp, blocks, block, class, n, set, stored; maps: class, bits. blocks: the most that a group has, of block shingles each.
    """
    from .components import connected

    schema = "a long, b long"
    links = stored(sets.select("grp", "block", "class", "set").groupBy("grp", "block").applyInPandas(_within(percent), schema), "links")
    if blocks <= 1:
        return links
    info, bytes_of = sets.where("blocks > 1").drop("set"), sets.where("blocks > 1").select("class", "set")

    def parts() -> DataFrame:
        found = connected(links).withColumnRenamed("node", "class").withColumnRenamed("root", "part")
        return stored(info.join(found, "class", "left").withColumn("part", F.coalesce("part", "class")), "parts")

    def largest(rows: DataFrame, *by: str) -> DataFrame:
        count = rows.groupBy(*by, "part").count()
        return count.groupBy(*by).agg(F.max_by("part", F.struct("count", "part")).alias("main"))

    # One class of each block's largest part meets those of HEADS blocks, then one of each such lot, and so on.
    now, width = parts(), 1
    while width < blocks:
        lot = now.withColumn("block", F.floor(F.col("block") / width))
        heads = lot.join(largest(lot, "grp", "block"), ["grp", "block"]).where("part = main").groupBy("grp", "block").agg(F.min("class").alias("class"))
        heads = heads.withColumn("lot", F.floor(F.col("block") / HEADS))
        more = heads.join(bytes_of, "class").select("grp", "lot", "class", "set").groupBy("grp", "lot").applyInPandas(_within(percent), schema)
        links, width = stored(links.unionByName(more), "links"), width * HEADS
        now = parts()
    now = now.join(largest(now, "grp"), "grp").withColumn("outside", F.col("part") != F.col("main")).drop("main")
    # Bitmaps first: those outside the largest part, as queries, against every block.
    wide = F.floor(F.col("block") / WIDE).cast("int").alias("wide")
    seen = stored(now.join(maps.select("class", "bits"), "class").select("grp", "block", wide, (F.ceil(F.col("blocks") / WIDE) - 1).cast("int").alias("last"), "class", "n", "part", "outside", "bits"), "seen")
    asked = seen.where("outside").withColumnRenamed("wide", "by")
    held = seen.join(asked.select("grp", "by").distinct(), "grp")
    columns = ["grp", "wide", "by", "block", "class", "n", "part", "bits"]
    both = asked.withColumn("wide", F.explode(F.sequence(F.lit(0), "last"))).select(*columns, F.lit(True).alias("asked"))
    # Of two that are both outside, one asks the other.
    both = both.unionByName(held.where("NOT outside OR wide >= by").select(*columns, F.lit(False).alias("asked")))
    hints = stored(both.groupBy("grp", "wide", "by").applyInPandas(_hints(percent), "class long, block int").distinct(), "hints")
    # Then the sets: queries meet the blocks that their hints name, so many at a time as make up a block.
    asks = hints.join(now.select("grp", "class", "n", "part"), "class")
    loads = asks.groupBy("grp", "block").agg(F.ceil(F.sum("n") / block).cast("int").alias("lots"))
    asks = asks.join(loads, ["grp", "block"]).withColumn("lot", F.pmod(F.xxhash64("class", F.lit(3)), "lots").cast("int"))
    each = asks.join(bytes_of, "class").select("grp", "block", "lot", "class", "set", "part", F.lit(True).alias("asked"))
    held = now.join(loads, ["grp", "block"]).withColumn("lot", F.explode(F.sequence(F.lit(0), F.col("lots") - 1)))
    held = held.join(bytes_of, "class").select("grp", "block", "lot", "class", "set", "part", F.lit(False).alias("asked"))
    more = each.unionByName(held).groupBy("grp", "block", "lot").applyInPandas(_across(percent), schema)
    return stored(links.unionByName(more), "links")


def near_components(docs: DataFrame, size: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", block: int = 1_000_000) -> DataFrame:
    """doc_id, n_shingles and component_id (the smallest doc_id reachable by links) of every document.

    Two documents link when 100 * intersection >= percent * union of their shingles of size words.
    block: shingles in one block of a large group.
    """
    from .components import connected

    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    seen = stored(docs.mapInArrow(_signatures(size), "doc long, n long, class long, bits binary"), "signatures")
    rows = seen.where("n >= 0")
    # One byte for each cell of the sketch, whatever the input's size.
    sums = seen.where("n < 0").select("class", "bits").repartition("class").sortWithinPartitions("class").mapInArrow(_ranks, "part long, ranks binary")
    ranks = np.zeros(CELLS, np.uint8)
    for r in sums.collect():
        ranks[r["part"] * PART : (r["part"] + 1) * PART] = np.frombuffer(r["ranks"], np.uint8)
    tokens = docs.mapInArrow(_prefixes(size, percent, ranks), "token long, class long, n long")
    tokens = tokens.repartition("token").sortWithinPartitions("token", "n", "class")
    pairs = tokens.mapInArrow(_neighbours(percent), "a long, b long, shared long, need long")
    pairs = pairs.groupBy("a", "b").agg(F.sum("shared").alias("shared"), F.min("need").alias("need")).where("shared >= need")
    classes = rows.where("n > 0").groupBy("class").agg(F.min("doc").alias("least"), F.max("n").alias("n"))
    maps = rows.where("n > 0").groupBy("class").agg(F.max("n").alias("n"), F.max("bits").alias("bits"))
    one, two = maps.toDF("a", "n", "x"), maps.toDF("b", "m", "y")
    pairs = pairs.join(one, "a").join(two, "b").select("a", "b", "n", "m", "x", "y", F.col("shared") >= STRONG)
    groups = connected(pairs.mapInArrow(_possible(percent), "a long, b long"))
    chosen = stored(classes.join(groups.select(F.col("node").alias("class"), F.col("root").alias("grp")), "class"), "chosen")
    blocks = chosen.groupBy("grp").agg(F.ceil(F.sum("n") / block).cast("int").alias("blocks"))
    chosen = stored(chosen.join(blocks, "grp").withColumn("block", F.pmod(F.xxhash64("class"), F.col("blocks")).cast("int")), "chosen")
    # A bitmap says which documents may be chosen; the join after it is exact.
    most, n = chosen.agg(F.coalesce(F.max("blocks"), F.lit(0)), F.count(F.lit(1))).first()
    bits = bitmap(chosen.select(F.xxhash64("least").alias("h")), "h", n)
    marked = docs.select("doc_id", "text", F.xxhash64("doc_id").alias("h"))
    sets = marked.mapInArrow(_sets(size, bits), "least long, class long, set array<long>").dropDuplicates(["least", "class"])
    sets = stored(sets.join(chosen, ["least", "class"]).select("grp", "blocks", "block", "class", "n", "set"), "sets")
    links = _links(sets, maps, percent, most, block)
    parts = connected(links)
    for x in (sets, links, chosen):
        dropped(x)
    linked = parts.withColumnRenamed("node", "class").join(classes, "class")
    least = linked.groupBy("root").agg(F.min("least").alias("component_id"))
    named = linked.select("class", "root").join(least, "root").select("class", "component_id")
    alone = classes.join(named, "class", "left").select("class", F.coalesce("component_id", "least").alias("component_id"))
    # Classes of more than a HOT-th of the documents are fewer than HOT, and go by broadcast.
    counts = rows.where("n > 0").groupBy("class").count()
    total = counts.agg(F.coalesce(F.sum("count"), F.lit(0))).first()[0]
    hot = stored(counts.where(F.col("count") * HOT > total).join(alone, "class").select("class", "component_id"), "hot")
    kept = rows.where("n > 0").select("class", "doc", "n")
    named = kept.join(F.broadcast(hot), "class").unionByName(kept.join(F.broadcast(hot.select("class")), "class", "left_anti").join(alone, "class"))
    empty = rows.where("n = 0").select("class", "doc", "n", F.col("doc").alias("component_id"))
    out = named.select("class", "doc", "n", "component_id").unionByName(empty)
    return out.select(F.col("doc").alias("doc_id"), F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc").alias("component_id"))
