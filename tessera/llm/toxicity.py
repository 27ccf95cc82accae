"""A toxicity classifier whose score does not follow which group a sentence names.

Logistic regression on the presence of words and word beginnings. Features are counted
over the training rows in Spark; which of them carry weight is settled by a penalty on
the weights' absolute values, without a fixed number. Every training sentence that names
a group is also read with the group's term swapped for another of its set; the squared
change of the score between the two is penalised too, so the terms themselves carry no
score.

Training reads a bounded sample: at most `sample` labelled rows, the first by a hash of
their id. Scoring reads every whole text: words are hashed in numpy and looked up in one
table of the kept features, so its cost is one pass over the bytes.

Null and blank texts score the model's base rate. A repeated id is scored row by row; of
several labels for an id the largest counts, and of several texts the least is learned from.
Without any usable label every score is the prior 0.0, and an empty table gives an empty
result. Very long texts are read whole. Other columns are ignored or kept, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Words, slices, small_batches, stored

#: Sets of terms that may stand for each other in a sentence.
IDENTITIES = (
    ("women", "men"),
    ("woman", "man"),
    ("girl", "boy"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("gay", "straight", "lesbian", "bisexual", "transgender"),
    ("black", "white", "asian", "latino", "arab"),
    ("african", "european", "american", "mexican", "chinese", "indian"),
    ("immigrants", "citizens", "refugees"),
    ("deaf", "blind", "disabled"),
    ("frauen", "männer"),
    ("femmes", "hommes"),
    ("mujeres", "hombres"),
)
BEGINNINGS = (4, 5, 6, 7, 8)


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words (without outer punctuation) and word beginnings of texts, and the text of each."""
    w = Words(texts)
    starts, ends = w.trimmed()
    doc = w.texts()
    hashes, docs = [w.spans(starts, ends)], [doc]
    for n in BEGINNINGS:
        use = ends - starts > n
        hashes.append(w.spans(starts[use], starts[use] + n) ^ np.uint64(n))
        docs.append(doc[use])
    return np.concatenate(hashes), np.concatenate(docs)


def swapped(text: str) -> str | None:
    """The text with every identity term replaced by the next of its set; None if it names none."""
    following = {t: s[(i + 1) % len(s)] for s in IDENTITIES for i, t in enumerate(s)}
    out, n = re.subn(r"\b(" + "|".join(sorted(following, key=len, reverse=True)) + r")\b", lambda m: following[m[0].lower()], text, flags=re.IGNORECASE)
    return out if n else None


def _readings(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[tuple], np.ndarray, np.ndarray]]:
    """Runs of (row, label, twin), and the distinct (run index, feature) pairs: each training text, and as a twin its swapped text."""
    for batch in batches:
        ids, texts, labels = (batch.column(i).to_pylist() for i in range(3))
        rows = [(i, t or "", y, False) for i, t, y in zip(ids, texts, labels, strict=True)]
        rows += [(i, s, y, True) for i, t, y, _ in rows if (s := swapped(t)) is not None]
        table = pa.RecordBatch.from_arrays([pa.array([r[1] for r in rows], pa.string()), pa.array(range(len(rows)), pa.int64())], names=["text", "at"])
        for part in slices(table):
            hashes, doc = features(part.column(0))
            pairs = np.unique(np.stack([doc.astype(np.uint64), hashes], axis=1), axis=0)
            yield [(rows[i][0], rows[i][2], rows[i][3]) for i in np.asarray(part.column(1))], pairs[:, 0].astype(np.int64), pairs[:, 1]


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """feature, n1, n0, twin: in how many toxic and other texts of a run a feature is, or that swapped texts have it."""
    for rows, doc, hashes in _readings(batches):
        toxic = np.array([y > 0 for _, y, _ in rows])[doc]
        twin = np.array([t for _, _, t in rows])[doc]
        keys, at = np.unique(hashes, return_inverse=True)
        n1 = np.bincount(at, toxic & ~twin, len(keys)).astype(np.int64)
        n0 = np.bincount(at, ~toxic & ~twin, len(keys)).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n1), pa.array(n0), pa.array(np.bincount(at, twin, len(keys)) > 0)], names=["feature", "n1", "n0", "twin"])


def _held(keys: np.ndarray):
    """row, label, twin and the indices of the kept features of each training text and its twin."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, doc, hashes in _readings(batches):
            at = np.minimum(np.searchsorted(keys, hashes), len(keys) - 1)
            hit = keys[at] == hashes
            ats = pa.ListArray.from_arrays(pa.array(np.searchsorted(doc[hit], np.arange(len(rows) + 1)).astype(np.int32)), pa.array(at[hit].astype(np.int32)))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.bool_()), ats], names=["row", "label", "twin", "ats"])

    return run


class Model:
    """Kept features, ascending by hash, with their weights, and the bias."""

    def __init__(self, keys: np.ndarray, weights: np.ndarray, bias: float):
        self.keys, self.weights, self.bias = keys, weights, bias
        self.near = np.zeros(1 << 16, bool)
        self.near[(keys & np.uint64(0xFFFF)).astype(np.int64)] = True

    def __call__(self, texts: pa.Array) -> np.ndarray:
        hashes, doc = features(texts)
        use = self.near[(hashes & np.uint64(0xFFFF)).astype(np.int64)]
        hashes, doc = hashes[use], doc[use]
        total = np.full(len(texts), self.bias)
        if len(self.keys) and len(hashes):
            at = np.minimum(np.searchsorted(self.keys, hashes), len(self.keys) - 1)
            hit = self.keys[at] == hashes
            pairs = np.unique(doc[hit] * np.int64(len(self.keys)) + at[hit])
            np.add.at(total, pairs // len(self.keys), self.weights[pairs % len(self.keys)])
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


class _Cells:
    """Rows of feature indices, whose products are made in stretches of about a million cells."""

    def __init__(self, rows: pa.ListArray, n_features: int):
        self.ends = np.asarray(rows.offsets).astype(np.int64) - rows.offsets[0].as_py()
        self.cols, self.n_features = np.asarray(rows.flatten()), n_features

    def _stretches(self) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        a, n = 0, len(self.ends) - 1
        while a < n:
            b = max(a + 1, int(np.searchsorted(self.ends, self.ends[a] + 1_000_000, "right")) - 1)
            yield a, b, np.repeat(np.arange(b - a), np.diff(self.ends[a : b + 1])), self.cols[self.ends[a] : self.ends[b]]
            a = b

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.concatenate([np.zeros(0), *(np.bincount(row, w[cols], b - a) for a, b, row, cols in self._stretches())])

    def tdot(self, v: np.ndarray) -> np.ndarray:
        out = np.zeros(self.n_features)
        for a, b, row, cols in self._stretches():
            out += np.bincount(cols, v[a:b][row], self.n_features)
        return out


def fit(rows: pa.Table, n_features: int, swap_penalty: float, l1: float, steps: int = 300) -> tuple[np.ndarray, float]:
    """Weights and bias by accelerated proximal steps; rows: row, label, twin and ats, the feature indices.

    What is least: the mean log loss, swap_penalty / 2 times the mean squared change of a
    sentence's sum under a swap, and l1 times the sum of the weights' absolute values.
    """
    rows = rows.sort_by("row").combine_chunks()
    parts = [rows.filter(pa.compute.equal(rows["twin"], twin)).combine_chunks() for twin in (False, True)]
    # No chunks are left where a table has no rows.
    lists = [t["ats"].chunk(0) if t.num_rows else pa.array([], pa.list_(pa.int32())) for t in parts]
    x, other = (_Cells(v, n_features) for v in lists)
    y = (np.asarray(parts[0]["label"]) > 0).astype(float)
    at = np.searchsorted(np.asarray(parts[0]["row"]), np.asarray(parts[1]["row"]))
    n, pull = len(y), swap_penalty / max(1, len(at))

    def back(error: np.ndarray, change: np.ndarray) -> np.ndarray:
        whole = error.copy()
        whole[at] += change
        return x.tdot(whole) - other.tdot(change)

    def changes(z: np.ndarray, w: np.ndarray) -> np.ndarray:
        return z[at] - other.dot(w)

    # The largest curvature, by power steps over weights and bias.
    v, v0, bend = np.ones(n_features), 1.0, 1.0
    for _ in range(20):
        size = np.sqrt(v @ v + v0 * v0)
        v, v0 = v / size, v0 / size
        z = x.dot(v)
        flat = (z + v0) / (4 * n)
        v, v0 = back(flat, pull * changes(z, v)), flat.sum()
        bend = np.sqrt(v @ v + v0 * v0)
    rate = 1 / (1.1 * bend)
    w, b, t = np.zeros(n_features), float(np.log(y.mean() / (1 - y.mean()))), 1.0
    u, u0 = w, b
    for _ in range(steps):
        z = x.dot(u)
        error = (1 / (1 + np.exp(-np.clip(z + u0, -30, 30))) - y) / n
        w2 = u - rate * back(error, pull * changes(z, u))
        w2 = np.sign(w2) * np.maximum(np.abs(w2) - rate * l1, 0)
        b2 = u0 - rate * error.sum()
        if (u - w2) @ (w2 - w) > 0:  # the momentum points uphill
            t = 1.0
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        u, u0 = w2 + (t - 1) / t2 * (w2 - w), b2 + (t - 1) / t2 * (b2 - b)
        w, b, t = w2, b2, t2
    return w, float(b)


def _fitted(n_features: int, swap_penalty: float, l1: float):
    """ats, weights and bias of a fit to all rows that the task gets: the features whose weight is not zero."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [b for b in batches if b.num_rows]
        if rows:
            weights, bias = fit(pa.Table.from_batches(rows), n_features, swap_penalty, l1)
            at = np.flatnonzero(weights)
            yield pa.RecordBatch.from_arrays([pa.array([at]), pa.array([weights[at]]), pa.array([bias])], names=["ats", "weights", "bias"])

    return run


def train(docs: DataFrame, labels: DataFrame, sample: int = 20_000, least_rows: int = 2, sparsity: float = 0.03, swap_penalty: float = 10.0) -> Model:
    """A model of labels.toxic from at most sample rows of docs (doc_id, text) with a label (doc_id, toxic).

    sparsity: the weight of the absolute values' penalty is this over the root of the rows'
    number, so that few rows allow few features. A feature is a candidate if at least
    least_rows rows have it, and its gradient at the model without features is over half
    that penalty and over one standard deviation of what chance would give.
    """
    spark = docs.sparkSession
    small_batches(spark)
    known = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("label"))
    # Which ids to read is settled first, on ids alone; the sample is bounded, so it may be broadcast.
    ids = docs.select("doc_id").join(known, "doc_id").distinct().orderBy(F.crc32(F.col("doc_id").cast("string").cast("binary")), "doc_id").limit(sample)
    ids = stored(ids, "labelled")
    rows = stored(docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text")).select("doc_id", "text", "label"), "training")
    total = {bool(r["label"]): r["n"] for r in ids.groupBy((F.col("label") > 0).alias("label")).agg(F.countDistinct("doc_id").alias("n")).collect()}
    if not total.get(True) or not total.get(False):
        return Model(np.zeros(0, np.uint64), np.zeros(0), 30.0 if total.get(True) else -30.0)
    n = total[True] + total[False]
    share, l1 = total[True] / n, sparsity / n**0.5
    counts = rows.mapInArrow(_counts, "feature long, n1 long, n0 long, twin boolean").groupBy("feature")
    counts = counts.agg(F.sum("n1").alias("n1"), F.sum("n0").alias("n0"), F.max("twin").alias("twin")).where(F.col("n1") + F.col("n0") >= least_rows)
    # How far a feature's count among toxic texts is from its share; the gradient is this over n.
    have = F.col("n1") + F.col("n0")
    off = F.abs(F.col("n1") - have * share)
    best = counts.where((off > n * l1 / 2) & (off > F.sqrt(have * share * (1 - share)))).select("feature").toArrow()["feature"]
    named, _ = features(pa.array([t for s in IDENTITIES for t in s]))
    keys = np.unique(np.concatenate([np.asarray(best).astype(np.int64).view(np.uint64), named]))
    # The bounded sample meets in one task, and the driver gets the weights only.
    held = rows.mapInArrow(_held(keys), "row long, label int, twin boolean, ats array<int>").repartition(1)
    got = held.mapInArrow(_fitted(len(keys), swap_penalty, l1), "ats array<long>, weights array<double>, bias double").toArrow()
    at, weights = (np.asarray(got[c].combine_chunks().flatten()) for c in ("ats", "weights"))
    return Model(keys[at], weights, got["bias"][0].as_py())


def scored(docs: DataFrame, model: Model, keep: list[str] | None = None, score_col: str = "score") -> DataFrame:
    """docs, or the columns of keep, with the score in score_col, which replaces one of that name."""
    small_batches(docs.sparkSession)
    docs = docs.select(*[c for c in docs.columns if c != score_col])
    names = docs.columns
    kept = [i for i, c in enumerate(names) if keep is None or c in keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in kept), pa.array(model(part.column(names.index("text"))))], names=[*(names[i] for i in kept), score_col])

    fields = [docs.schema.fields[i] for i in kept]
    return docs.mapInArrow(run, T.StructType([*fields, T.StructField(score_col, T.DoubleType())]))


def held_out(col: str = "doc_id"):
    return F.crc32(F.col(col).cast("string").cast("binary")) % 4 == 2


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted; labels of held-out ids are not read."""
    model = train(docs, labels.where(~held_out()))
    out = scored(docs.select("doc_id", "text").withColumn("held_out", F.coalesce(held_out(), F.lit(False))), model, ["doc_id", "held_out"])
    return out.select("doc_id", "held_out", "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
