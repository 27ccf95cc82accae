"""What the operators of this folder share: stored tables, and words of UTF-8 text as hashes.

Words are found in numpy over whole Arrow buffers, a slice of a quarter of a megabyte at
a time, so that memory in a task does not follow the size of its partition.
"""

from __future__ import annotations

import functools
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SLICE_BYTES = 1 << 18
BATCH_ROWS = 1000


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of few rows, as texts can be long: lowers the session's limit where it is higher or off."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share. On one machine a temporary one will do where none is named; a cluster must name it."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or (
        d.get() if (d := sc._jsc.sc().getCheckpointDir()).isDefined() else None
    )
    if not named:
        if sc.master.split("[")[0] != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="tessera-")
        sc.setCheckpointDir(named)
        named = sc._jsc.sc().getCheckpointDir().get()
    return named.rstrip("/")


def stored(df: DataFrame, name: str = "table") -> DataFrame:
    """df written as a table in the shared folder and read again: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._tessera_path = path
    return out


def dropped(df: DataFrame) -> None:
    """Deletes a table made by stored() that no later result reads."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df._tessera_path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df does not have."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name += "_"
    return name


#: Bits of the smallest and largest bitmap. Beyond the largest, more rows pass and later joins drop them.
LEAST_BITS, MOST_BITS = 1 << 20, 1 << 28


def bitmap(rows: DataFrame, col: str, n: int) -> np.ndarray:
    """A bitmap of the low bits of n hashes (a long column), 16 bits or more for each up to MOST_BITS.

    Its size is bounded, 32 MB at most, so it may go through the driver.
    """
    size = min(MOST_BITS, max(LEAST_BITS, 1 << (16 * max(1, n) - 1).bit_length()))
    # Spark's bucket k holds places 1 to 32768 after 32768 * (k - 1), so zero-based places go in one higher
    at = rows.select((F.col(col).bitwiseAND(F.lit(size - 1)) + 1).alias("at"))
    maps = at.groupBy(F.bitmap_bucket_number("at").alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bits")).collect()
    out = np.zeros(size // 8, np.uint8)
    for r in maps:
        out[4096 * (r["k"] - 1) : 4096 * r["k"]] = np.frombuffer(r["bits"], np.uint8)
    return out


def has_bit(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Which hashes (of 64 bits) a bitmap of bitmap() holds."""
    at = (h.view(np.uint64) & np.uint64(8 * len(bits) - 1)).astype(np.int64)
    return (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (splitmix64's)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_P = np.uint64(0x9E3779B97F4A7C15)  # odd, so it has an inverse modulo 2**64
_P_INV = np.uint64(pow(int(_P), -1, 1 << 64))
_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
_LOWER = _BYTE.copy()
_LOWER[65:91] = _BYTE[97:123]
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_TRIM = np.zeros(256, bool)
_TRIM[[ord(c) for c in ".,;:!?\"'()[]{}|*#$%&-"]] = True
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the hash's base, and of its inverse."""
    if len(_powers[0]) < n:
        size = max(n, SLICE_BYTES + 1)
        for i, base in enumerate((_P, _P_INV)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[i] = np.multiply.accumulate(steps)
    return _powers[0][:n], _powers[1][:n]


class Bytes:
    """Texts as one byte buffer: data, and offs with a start for each text and the end."""

    def __init__(self, texts: pa.Array):
        if isinstance(texts, pa.ChunkedArray):
            texts = texts.combine_chunks()
        binary = texts.cast(pa.large_binary()).fill_null(b"")
        offs = np.frombuffer(binary.buffers()[1], np.int64)[binary.offset : binary.offset + len(binary) + 1]
        raw = binary.buffers()[2]
        self.data = np.frombuffer(raw, np.uint8)[offs[0] : offs[-1]] if raw is not None else np.zeros(0, np.uint8)
        self.offs = offs - offs[0]


def slices(batch: pa.RecordBatch, text: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Runs of rows of at most limit bytes of text, or of one row."""
    if not batch.num_rows:
        return
    col = batch.column(batch.schema.get_field_index(text))
    ends = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(col), 0), np.int64))
    at = 0
    while at < batch.num_rows:
        base = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, base + limit, "right")))
        yield batch.slice(at, to - at)
        at = to


class Words:
    """The words [^\\x20\\x09-\\x0D]+ of texts, A-Z lower-cased: hash, byte range and text of each.

    hashes, starts, ends: one per word; first: the index of each text's first word, and the end.
    space: which of the 256 bytes part words, where others than these do.
    """

    def __init__(self, texts: pa.Array, lower: bool = True, space: np.ndarray = _SPACE):
        b = Bytes(texts)
        self.data, self.offs = data, offs = b.data, b.offs
        n = len(data)
        inner = ~space[data]
        begins = inner.copy()
        begins[1:] &= ~inner[:-1]
        stops = inner.copy()
        stops[:-1] &= ~inner[1:]
        cut = offs[1:-1]
        cut = cut[(cut > 0) & (cut < n)]  # texts that touch without a space
        begins[cut] = inner[cut]
        stops[cut - 1] = inner[cut - 1]
        self.starts = np.flatnonzero(begins)
        self.ends = np.flatnonzero(stops) + 1
        up, self.down = powers(n + 1)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum((_LOWER if lower else _BYTE)[data] * up[:n], out=self.sums[1:])
        self.first = np.searchsorted(self.starts, offs)

    @functools.cached_property
    def hashes(self) -> np.ndarray:
        return self.spans(self.starts, self.ends)

    def trimmed(self) -> tuple[np.ndarray, np.ndarray]:
        """The byte ranges of the words without punctuation at their ends, three signs at most on either side."""
        starts, ends = self.starts.copy(), self.ends.copy()
        some = np.flatnonzero((_TRIM[self.data[ends - 1]] | _TRIM[self.data[starts]]) & (ends - starts > 1)) if len(ends) else starts
        a, b = starts[some], ends[some]
        for _ in range(3):
            b -= (b - a > 1) & _TRIM[self.data[b - 1]]
            a += (b - a > 1) & _TRIM[self.data[a]]
        starts[some], ends[some] = a, b
        return starts, ends

    def spans(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """A hash of the bytes of each range."""
        raw = (self.sums[ends] - self.sums[starts]) * self.down[starts]
        return mix(raw ^ ((ends - starts).astype(np.uint64) * np.uint64(0xA0761D6478BD642F)))

    def texts(self) -> np.ndarray:
        """For each word, the index of its text."""
        return np.repeat(np.arange(len(self.offs) - 1), np.diff(self.first))


_STEP = [np.uint64(x) for x in (0x9FB21C651E98DF25, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA24BAED4963EE407)]


def shingles(w: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashed shingles of each text: hashes, ascending within a text, and the first index of each text."""
    return sized_shingles(w, size)[:2]


def sized_shingles(w: Words, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As shingles(), and the bytes in the words of each shingle.

    A text with fewer words than size has its whole sequence as one shingle; one without words, none.
    """
    counts = np.diff(w.first)
    each = np.where(counts >= size, counts - size + 1, np.minimum(counts, 1))
    doc = np.repeat(np.arange(len(counts)), each)
    bounds = np.concatenate([[0], np.cumsum(each)])
    at = np.arange(len(doc)) - bounds[doc] + w.first[doc]
    h = np.zeros(len(doc), np.uint64)
    padded = np.concatenate([w.hashes, np.zeros(size, np.uint64)])
    long = (counts >= size)[doc]
    letters = np.zeros(len(doc), np.int64)
    sizes = np.concatenate([w.ends - w.starts, np.zeros(size, np.int64)])
    for i in range(size):
        use = long | (i < counts[doc])
        letters += np.where(use, sizes[at + i], 0)
        h = np.where(use, mix(h * _STEP[i % 5] + padded[at + i] + np.uint64(i)), h)
    order = np.lexsort((h, doc))
    h = h[order]
    keep = np.ones(len(h), bool)
    keep[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    h, doc = h[keep], doc[keep]
    return h, np.searchsorted(doc, np.arange(len(counts) + 1)), letters[order][keep]


def lists(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(values))
