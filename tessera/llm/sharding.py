"""Best-fit-decreasing sharding: indivisible groups of equal texts into a fixed number of shards.

The sizes of all groups form a histogram, and the driver packs that: sizes come in
descending order, and each group enters the shard with the least room that holds it, found
in a balanced tree. A shard that takes one group of a size is the tightest for the next one
too, so it takes as many as fit in one step, and the work follows the number of distinct
sizes, not of groups. Distinct sizes add up to no more than all bytes, so there are at most
sqrt(2 * bytes) of them. Within a size the groups are numbered by Spark, and runs of numbers
go to the shards. The capacity is the least at which best fit needs no further shard, to
within 1/16384 of a shard, so the shards' bytes are near equal, unless one group alone is
larger than a shard: that one gets a shard to itself and the others share what is left.

Null texts hold no bytes and form one group; empty tables give empty results; repeated rows
are rows of their own and lie in one shard; texts of any length are read whole. Slots follow
the ids within parts of a shard; rows that tie in id, text and size may swap their slots.
Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import dropped, stored


class Tree:
    """A balanced (AA) search tree of distinct keys, for the least key not below a bound."""

    def __init__(self):
        self.root = None  # a node is [key, level, left, right]

    @staticmethod
    def _skew(t):
        if t[2] is not None and t[2][1] == t[1]:
            left = t[2]
            t[2], left[3] = left[3], t
            return left
        return t

    @staticmethod
    def _split(t):
        if t[3] is not None and t[3][3] is not None and t[3][3][1] == t[1]:
            right = t[3]
            t[3], right[2] = right[2], t
            right[1] += 1
            return right
        return t

    def add(self, key) -> None:
        def put(t):
            if t is None:
                return [key, 1, None, None]
            side = 2 if key < t[0] else 3
            t[side] = put(t[side])
            return self._split(self._skew(t))

        self.root = put(self.root)

    def remove(self, key) -> None:
        def level(t):
            return 0 if t is None else t[1]

        def take(t, key):
            if t is None:
                return None
            if key == t[0]:
                if t[2] is None:
                    return t[3]
                nearest = t[2]
                while nearest[3] is not None:
                    nearest = nearest[3]
                t[0] = nearest[0]
                t[2] = take(t[2], nearest[0])
            else:
                side = 2 if key < t[0] else 3
                t[side] = take(t[side], key)
            low = min(level(t[2]), level(t[3])) + 1
            if low < t[1]:
                t[1] = low
                if t[3] is not None and low < t[3][1]:
                    t[3][1] = low
            t = self._skew(t)
            if t[3] is not None:
                t[3] = self._skew(t[3])
                if t[3][3] is not None:
                    t[3][3] = self._skew(t[3][3])
            t = self._split(t)
            if t[3] is not None:
                t[3] = self._split(t[3])
            return t

        self.root = take(self.root, key)

    def least_from(self, bound):
        t, best = self.root, None
        while t is not None:
            if t[0] >= bound:
                best, t = t[0], t[2]
            else:
                t = t[3]
        return best


def fill(histogram: list[tuple[int, int]], n_bins: int, capacity: int) -> list[list[tuple[int, int]]] | None:
    """Best fit decreasing of (size, number of groups) pairs, sizes descending: for each size, bins and how many they get.

    None if n_bins bins of the capacity do not hold all.
    """
    room, bins, out = Tree(), 0, []
    for size, left in histogram:
        given = []
        while left:
            spot = room.least_from((size, -1))
            if spot is None:
                if bins == n_bins or size > capacity:
                    return None
                spot, bins = (capacity, bins), bins + 1
            else:
                room.remove(spot)
            many = min(left, spot[0] // size)
            given.append((spot[1], many))
            left -= many
            if spot[0] > many * size:
                room.add((spot[0] - many * size, spot[1]))
        out.append(given)
    return out


def pack(histogram: list[tuple[int, int]], n_bins: int) -> list[list[tuple[int, int]]]:
    """fill() into bins 0 to n_bins - 1 at about the least capacity that does; sizes descending and positive.

    Groups larger than an even share of what is left have a bin of their own, ahead of the others.
    """
    left, alone = sum(size * n for size, n in histogram), 0
    out: list[list[tuple[int, int]]] = [[] for _ in histogram]
    rest = [list(x) for x in histogram]
    for i, (size, n) in enumerate(histogram):
        while rest[i][1] and alone < n_bins - 1 and size * (n_bins - alone) > left:
            out[i].append((alone, 1))
            rest[i][1] -= 1
            left -= size
            alone += 1
        if rest[i][1]:
            break
    todo = [(size, n) for size, n in rest if n]
    if not todo:
        return out
    bins, largest = n_bins - alone, todo[0][0]
    low = max(-(-left // bins), largest)
    high = low + largest  # with so much room, every bin but one is filled to its share
    fit = fill(todo, bins, low)
    if fit is None:
        fit = fill(todo, bins, high)
        while high - low > max(1, left // bins >> 14):
            middle = (low + high) // 2
            if (tried := fill(todo, bins, middle)) is not None:
                high, fit = middle, tried
            else:
                low = middle
    found = iter(fit)
    for i, (_, n) in enumerate(rest):
        if n:
            out[i] += [(alone + b, many) for b, many in next(found)]
    return out


def _numbered(rows: DataFrame, key: str, parts: int, spread: list[str], order: list[str], name: str) -> DataFrame:
    """rows with a gapless number from 0 among those that share the key, given in parts so that no task numbers them all."""
    rows = rows.withColumn("part", F.pmod(F.xxhash64(*spread), F.lit(parts)).cast("int"))
    before = Window.partitionBy(key).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy(key, "part").count().withColumn("base", F.coalesce(F.sum("count").over(before), F.lit(0))).drop("count")
    within = Window.partitionBy(key, "part").orderBy(*order)
    out = rows.withColumn("nth", F.row_number().over(within) - 1).join(starts, [key, "part"])
    return out.withColumn(name, (F.col("base") + F.col("nth")).cast("long")).drop("part", "nth", "base")


HOT = 1000


def shards(docs: DataFrame, n_shards: int = 24, id_col: str = "doc_id", text_col: str = "text", slot_rows: int = 100_000) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every row.

    slot_rows: about how many rows are numbered by one task.
    """
    spark = docs.sparkSession
    text = F.col(text_col)
    rows = stored(
        docs.select(
            F.col(id_col).alias("doc_id"),
            (F.coalesce(F.octet_length(text), F.lit(0)) + 8).cast("long").alias("size"),
            F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
            F.when(text.isNull(), F.lit(-1)).otherwise(F.xxhash64(text)).alias("grp"),
        ),
        "rows",
    )
    groups = stored(rows.groupBy("grp").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows")), "groups")
    n, most = groups.agg(F.coalesce(F.sum("rows"), F.lit(0)), F.count(F.lit(1))).first()
    histogram = sorted(((r["bytes"], r["n"]) for r in groups.groupBy("bytes").agg(F.count(F.lit(1)).alias("n")).collect()), reverse=True)
    runs = []
    for (size, _), given in zip(histogram, pack(histogram, n_shards), strict=True):
        at = 0
        for shard, many in given:
            runs.append((size, at, at + many, shard))
            at += many
    # Few rows as a rule; whether they are broadcast is left to Spark, which knows their size.
    where = spark.createDataFrame(pd.DataFrame(runs, columns=["bytes", "low", "high", "shard"]), "bytes long, low long, high long, shard int") if runs else spark.createDataFrame([], "bytes long, low long, high long, shard int")
    placed = _numbered(groups, "bytes", max(4, -(-most // slot_rows)), ["grp"], ["grp"], "rank").join(where, "bytes").where("rank >= low AND rank < high")
    placed = stored(placed.select("grp", "rows", "shard"), "placed")
    # Groups of more than a HOT-th of the rows are fewer than HOT, and go by broadcast.
    hot = placed.where(F.col("rows") * HOT > n).select("grp", "shard")
    cold = rows.join(F.broadcast(hot.select("grp")), "grp", "left_anti").join(placed.select("grp", "shard"), "grp")
    dealt = stored(rows.join(F.broadcast(hot), "grp").unionByName(cold), "dealt")
    for x in (rows, groups, placed):
        dropped(x)
    out = _numbered(dealt, "shard", max(4, -(-n // (n_shards * slot_rows))), ["doc_id", "grp"], ["doc_id", "text_crc32", "size"], "slot")
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
