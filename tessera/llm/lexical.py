"""Ranked lexical search over a tiered index, exact in integers.

Documents become one row each of an index: for every tier, a list of the query set's terms in
that document and their impacts (the term's share of a score). A posting's tier follows from
its impact, highest first; a tier is a pair of columns, so a search reads the first tiers only
and nothing is shuffled to add up a document's score. What a term can still give in the tiers
below is its residual bound, known from its largest impact.

A search goes down the tiers. After each one, an item's k-th best sum so far (a lower bound of
its k-th best score) is held against the sum of its terms' residual bounds. Where that sum is
smaller, no document unseen so far can be among the best: documents whose upper bound reaches
the k-th sum are scored in full by a join with the lower tiers, and the item is done. Items
without this proof fall through to the next tier; in the last one, bounds are zero.

Terms are the maximal runs of digits, A-Z, a-z and characters beyond ASCII, A-Z lower-cased;
words are found by hash and compared byte by byte. Scores follow from the counts as in
impacts(); weights are doubles, rounded down, all else is integers.

Defined results: null and empty texts, and texts without terms, are no documents. Every other
row is a document of its own, whatever its id; equal scores go by ascending id (null last).
Rows of items that repeat both id and text count once; items that share an id but not a text
are ranked apart under that id. Items without terms, or with terms that no document has, have
no rows; empty tables give none. Other columns are ignored. Texts of any length are read whole.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import Words, dropped, lists, slices, small_batches, stored

#: What parts terms, as a pattern and as a table of bytes.
PARTS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
PARTING = np.array([not chr(b).isalnum() for b in range(128)] + [False] * 128)
_LOW = np.arange(256, dtype=np.uint8)
_LOW[65:91] += 32
#: Lowest impacts of the tiers but the last, as shares of the largest impact.
TIERS = (1 / 4, 1 / 8, 1 / 16, 1 / 32)
#: Sums (documents by items) that a task holds at a time.
CELLS = 1 << 21


class Vocabulary:
    """Terms found in texts: by hash, then byte by byte."""

    def __init__(self, terms: list[str]):
        words = Words(pa.array(terms, pa.string()), space=np.zeros(256, bool))
        hashes = words.hashes if len(terms) else np.zeros(0, np.uint64)
        self.order = np.argsort(hashes, kind="stable")
        self.hashes, self.data = hashes[self.order], words.data
        self.starts, self.sizes = words.starts[self.order], (words.ends - words.starts)[self.order]
        runs = np.diff(np.flatnonzero(np.concatenate([[True], self.hashes[1:] != self.hashes[:-1], [True]]))) if len(terms) else [0]
        self.longest = int(max(runs))  # terms that share a hash: 1, but for freaks

    def find(self, words: Words) -> np.ndarray:
        """For each word the place of its term, or -1."""
        out = np.full(len(words.starts), -1, np.int64)
        first = np.searchsorted(self.hashes, words.hashes)
        low = _LOW[words.data]
        sizes = words.ends - words.starts
        for step in range(self.longest):
            at = np.minimum(first + step, len(self.hashes) - 1)
            use = np.flatnonzero((out < 0) & (self.hashes[at] == words.hashes) & (self.sizes[at] == sizes))
            if not len(use):
                continue
            term, size = at[use], sizes[use]
            begin = np.cumsum(size) - size
            within = np.arange(size.sum()) - np.repeat(begin, size)
            same = low[np.repeat(words.starts[use], size) + within] == self.data[np.repeat(self.starts[term], size) + within]
            good = np.logical_and.reduceat(same, begin)
            out[use[good]] = self.order[term[good]]
        return out


def _postings(terms, id_type: pa.DataType):
    """Rows (row, id, text) to (row, id, n, terms, tfs): the query set's terms of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = Vocabulary(terms.value)
        size = max(1, len(terms.value))
        for whole in batches:
            for batch in slices(whole):
                words = Words(batch.column(2), space=PARTING)
                n = np.diff(words.first)
                found = vocabulary.find(words)
                use = found >= 0
                keys, tf = np.unique(words.texts()[use] * size + found[use], return_counts=True)
                bounds = np.searchsorted(keys, np.arange(batch.num_rows + 1) * size)
                out = [batch.column(0), batch.column(1).cast(id_type), pa.array(n.astype(np.int64)), lists((keys % size).astype(np.int32), bounds), lists(tf.astype(np.int64), bounds)]
                made = pa.RecordBatch.from_arrays(out, names=["row", "id", "n", "terms", "tfs"])
                yield made.filter(pa.array(n > 0))

    return run


def _tiered(weights, cuts: list[int], id_type: pa.DataType):
    """Rows (row, id, m, terms, tfs) to (row, id, t0, i0, t1, ...): terms and impacts of each tier."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            terms, bounds = _flat(b.column(3))
            tf, m = _flat(b.column(4))[0].astype(np.int64), np.asarray(b.column(2), dtype=np.int64)
            doc = np.repeat(np.arange(b.num_rows), np.diff(bounds))
            impact = weights.value[terms] * (1_000_000_000 * tf // (1000 * tf + 8 * m[doc]))
            tier = np.searchsorted(-np.array(cuts, np.int64), -impact, "left")
            out = [b.column(0), b.column(1).cast(id_type)]
            for j in range(len(cuts) + 1):
                use = (tier == j) & (impact > 0)
                ends = np.searchsorted(doc[use], np.arange(b.num_rows + 1))
                out += [lists(terms[use].astype(np.int32), ends), lists(impact[use], ends)]
            yield pa.RecordBatch.from_arrays(out, names=["row", "id", *[f"{c}{j}" for j in range(len(cuts) + 1) for c in "ti"]])

    return run


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A list column's values, and where each row's begin, and the end."""
    offsets = np.asarray(column.offsets, dtype=np.int64)
    return np.asarray(column.values)[offsets[0] : offsets[-1]], offsets - offsets[0]


class Items:
    """The items of a search by term: who asks for each term, and residual bounds after a tier."""

    def __init__(self, pairs: np.ndarray, n_terms: int, n_items: int, bounds: np.ndarray):
        order = np.argsort(pairs[:, 1], kind="stable")
        self.items, self.n_items = pairs[order, 0], n_items
        self.first = np.searchsorted(pairs[order, 1], np.arange(n_terms + 1))
        self.bounds = bounds
        self.total = np.zeros(n_items, np.int64)
        np.add.at(self.total, pairs[:, 0], bounds[pairs[:, 1]])

    def spread(self, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For postings, the index of each and the items that ask for its term."""
        n = self.first[terms + 1] - self.first[terms]
        of = np.repeat(np.arange(len(terms)), n)
        return of, self.items[np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n) + self.first[terms][of]]


def _sums(batches: Iterator[pa.RecordBatch], tiers: int, items: Items) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """For slices of documents, the sums of impacts so far and the upper bounds, by document and item."""
    each = max(1, CELLS // max(1, items.n_items))
    for whole in batches:
        for at in range(0, whole.num_rows, each):
            batch = whole.slice(at, each)
            low = np.zeros((batch.num_rows, items.n_items), np.int64)
            seen = np.zeros_like(low)
            for j in range(tiers):
                terms, ends = _flat(batch.column(2 + 2 * j))
                impact = _flat(batch.column(3 + 2 * j))[0]
                of, item = items.spread(terms)
                cell = np.repeat(np.arange(batch.num_rows), np.diff(ends))[of] * items.n_items + item
                np.add.at(low.reshape(-1), cell, impact[of])
                np.add.at(seen.reshape(-1), cell, items.bounds[terms[of]])
            yield batch, low, low + items.total - seen


def _best(tiers: int, k: int, items):
    """The k largest sums so far of each item among a task's documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top = np.zeros((k, items.value.n_items), np.int64)
        for _, low, _ in _sums(batches, tiers, items.value):
            top = np.partition(np.concatenate([top, low]), len(low), axis=0)[len(low) :]
        at = np.argwhere(top > 0)
        yield pa.RecordBatch.from_arrays([pa.array(at[:, 1].astype(np.int32)), pa.array(top[tuple(at.T)])], names=["item", "low"])

    return run


def _candidates(tiers: int, items, least):
    """Documents whose upper bound reaches the item's k-th sum, and their sums so far."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, low, high in _sums(batches, tiers, items.value):
            doc, item = np.nonzero((low > 0) & (high >= least.value))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(doc)), pa.array(item.astype(np.int32)), pa.array(low[doc, item])], names=["row", "item", "low"])

    return run


def _finished(first: int, last: int, items, id_type: pa.DataType):
    """Rows (item, low, id, t, i, ...) of the tiers from first on to full scores."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = items.value
        owner = np.repeat(np.arange(len(asked.first) - 1), np.diff(asked.first))
        known = np.sort(asked.items * (len(asked.first) - 1) + owner)
        for b in batches:
            item, score = np.asarray(b.column(0), dtype=np.int64), np.array(b.column(1), dtype=np.int64)
            for j in range(last - first):
                terms, ends = _flat(b.column(3 + 2 * j))
                row = np.repeat(np.arange(b.num_rows), np.diff(ends))
                key = item[row] * (len(asked.first) - 1) + terms
                at = np.minimum(np.searchsorted(known, key), len(known) - 1)
                use = known[at] == key
                np.add.at(score, row[use], _flat(b.column(4 + 2 * j))[0][use])
            yield pa.RecordBatch.from_arrays([pa.array(item.astype(np.int32)), b.column(2).cast(id_type), pa.array(score)], names=["item", "id", "score"])

    return run


def item_terms(items: DataFrame, item_col: str, text_col: str) -> DataFrame:
    """item (its number), id and one of its terms, once each; items that repeat in full are one."""
    upper = "".join(map(chr, range(65, 91)))
    rows = items.select(F.col(item_col).alias("id"), F.col(text_col).alias("text")).where(F.col("text").isNotNull()).distinct()
    terms = F.array_distinct(F.filter(F.split(F.translate("text", upper, upper.lower()), PARTS), lambda t: t != ""))
    rows = stored(rows.select(F.monotonically_increasing_id().alias("item"), "id", terms.alias("terms")), "items")
    return rows.select("item", "id", F.explode("terms").alias("term"))


def index(docs: DataFrame, terms: list[str], id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, np.ndarray, list[int]]:
    """The tiered index of a set of terms over whole documents, each term's largest impact, and the tiers' lowest impacts.

    terms, their weights and bounds are broadcast; search() bounds how many there are.
    """
    spark = docs.sparkSession
    small_batches(spark)
    sc = spark.sparkContext
    id_field = docs.schema[id_col]
    id_type = pa.string() if isinstance(id_field.dataType, T.StringType) else pa.from_numpy_dtype(np.dtype({"integer": "int32", "short": "int16", "byte": "int8"}.get(id_field.dataType.typeName(), "int64")))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).select(F.monotonically_increasing_id().alias("row"), "id", "text")
    kind = id_field.dataType.simpleString()
    forward = rows.mapInArrow(_postings(sc.broadcast(terms), id_type), f"row long, id {kind}, n long, terms array<int>, tfs array<long>")
    forward = stored(forward, "postings")
    n_docs, length = forward.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    # in decimals, so that no product overflows however large the corpus is
    m = F.expr(f"100 - 90 + CAST((CAST(90 AS DECIMAL(38,0)) * n * {n_docs}) DIV {max(1, length)} AS BIGINT)")
    found = forward.select(m.alias("m"), F.inline(F.arrays_zip("terms", "tfs")))
    share = F.expr("(1000000000 * tfs) DIV (1000 * tfs + 8 * m)")
    stats = found.groupBy("terms").agg(F.count(F.lit(1)).alias("df"), F.max(share).alias("top")).collect()  # a row a term of the query set
    weights, top = np.zeros(len(terms), np.int64), np.zeros(len(terms), np.int64)
    for term, df, most in stats:
        weights[term] = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))
        top[term] = weights[term] * most
    cuts = [max(1, int(top.max(initial=0) * share)) for share in TIERS]
    schema = f"row long, id {kind}, " + ", ".join(f"t{j} array<int>, i{j} array<long>" for j in range(len(cuts) + 1))
    tiers = stored(forward.select("row", "id", m.alias("m"), "terms", "tfs").mapInArrow(_tiered(sc.broadcast(weights), cuts, id_type), schema), "tiers")
    dropped(forward)
    return tiers, top, cuts


def search(docs: DataFrame, items: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block_terms: int = 1_000_000) -> DataFrame:
    """item_id, rank (from 1), doc_id and score of the k highest-scoring documents of each item.

    block_terms: about how many pairs of item and term are broadcast at once; more are searched
    block by block, each over all documents.
    """
    spark = docs.sparkSession
    schema = f"`{item_col}` {items.schema[item_col].dataType.simpleString()}, rank int, `{id_col}` {docs.schema[id_col].dataType.simpleString()}, score long"
    pairs = item_terms(items, item_col, item_text_col)
    blocks = max(1, -(-pairs.count() // block_terms))
    out = spark.createDataFrame([], schema)
    for block in range(blocks):
        part = pairs.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == block).toArrow().to_pydict()
        if part["item"]:
            out = out.unionByName(_searched(docs, part, k, id_col, text_col, item_col, schema))
    return out


def _searched(docs: DataFrame, part: dict[str, list], k: int, id_col: str, text_col: str, item_col: str, schema: str) -> DataFrame:
    spark, sc = docs.sparkSession, docs.sparkSession.sparkContext
    terms = sorted(set(part["term"]))
    place = {t: i for i, t in enumerate(terms)}
    names = dict(zip(part["item"], part["id"], strict=True))
    number = {item: i for i, item in enumerate(names)}
    pairs = np.array([(number[i], place[t]) for i, t in zip(part["item"], part["term"], strict=True)], np.int64)
    tiers, top, cuts = index(docs, terms, id_col, text_col)
    pairs = pairs[top[pairs[:, 1]] > 0]
    id_type = tiers.schema["id"].dataType.simpleString()
    id_arrow = pa.string() if id_type == "string" else {"int": pa.int32(), "smallint": pa.int16(), "tinyint": pa.int8()}.get(id_type, pa.int64())
    found = spark.createDataFrame([], f"item int, id {id_type}, score long")
    open_items, least = np.unique(pairs[:, 0]), np.zeros(len(number), np.int64)
    columns = [f"{c}{j}" for j in range(len(cuts) + 1) for c in "ti"]
    for j in range(len(cuts) + 1):
        if not len(open_items):
            break
        bounds = np.minimum(top, cuts[j] - 1) if j < len(cuts) else np.zeros_like(top)
        asked = Items(pairs[np.isin(pairs[:, 0], open_items)], len(terms), len(number), bounds)
        shared = sc.broadcast(asked)
        read = tiers.select("row", "id", *columns[: 2 * j + 2])
        sums = read.mapInArrow(_best(j + 1, k, shared), "item int, low long")
        kth = sums.withColumn("nth", F.row_number().over(Window.partitionBy("item").orderBy(F.desc("low")))).where(F.col("nth") == k)
        for r in kth.collect():  # a row an item
            least[r["item"]] = max(least[r["item"]], r["low"])
        proven = open_items if j == len(cuts) else open_items[asked.total[open_items] < least[open_items]]
        if not len(proven):
            continue
        now = sc.broadcast(Items(pairs[np.isin(pairs[:, 0], proven)], len(terms), len(number), bounds))
        near = read.mapInArrow(_candidates(j + 1, now, sc.broadcast(least)), "row long, item int, low long")
        rest = tiers.select("row", "id", *columns[2 * j + 2 :])
        whole = rest.join(near, "row").select("item", "low", "id", *columns[2 * j + 2 :])
        found = found.unionByName(stored(whole.mapInArrow(_finished(j + 1, len(cuts) + 1, now, id_arrow), found.schema), "scores"))
        open_items = np.setdiff1d(open_items, proven)
    dropped(tiers)
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.col("id").asc_nulls_last())
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    item_type = T._parse_datatype_string(schema)[item_col].dataType
    ids = spark.createDataFrame(list(enumerate(names.values())), T.StructType([T.StructField("item", T.IntegerType()), T.StructField("label", item_type)]))
    out = ranked.join(F.broadcast(ids), "item")
    return out.select(F.col("label").alias(item_col), "rank", F.col("id").alias(id_col), "score")
