"""Packing token sequences by minimum bin slack.

Each text becomes ids by the given tokenizer and an end id; texts are cut into
pieces of the capacity and a remainder. Windows are filled from the multiset of
remaining piece lengths: the longest that is left goes first, and a subset-sum
dynamic programme on bitsets picks the lengths that fill the rest most closely,
with their counts found by walking back. A pattern is used as often as its counts
allow, so the programme runs at most about twice per length. Its input is a
histogram of at most capacity rows; placing the pieces is a join.

Null texts count as empty: one piece with the end id alone. Repeated rows are
packed each for itself, whatever their ids (null ones too); texts of any length are
cut, never shortened; empty tables give empty results. Only doc_id and text are read,
so other columns may have any name.
"""

from __future__ import annotations

import functools
import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import small_batches, stored

CACHED = 800_000
CACHED_CHARS = 48
#: Fixed value: how the known form splits words.
WORD_FORM = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def known_form(spec: dict) -> bool:
    """Whether a tokenizer's settings let chunks between spaces be encoded alone, whatever their case, and a last full stop or comma apart."""
    steps = (spec.get("normalizer") or {}).get("normalizers", [])
    split = ((spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}])[0]
    model = spec.get("model", {})
    return (
        [s.get("type") for s in steps] == ["NFC", "Replace", "Lowercase"]
        and (split.get("type"), split.get("behavior"), split.get("invert")) == ("Split", "Removed", True)
        and split.get("pattern", {}).get("Regex") == WORD_FORM
        and (model.get("type"), model.get("end_of_word_suffix"), model.get("dropout")) == ("BPE", "</w>", None)
        and not any(any(c.isspace() for c in t["content"]) or t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec.get("added_tokens", []))
    )


class Encoder:
    """Ids of texts as bytes (little-endian unsigned 32 bit).

    A tokenizer of the known form (lower-cased words, marks and digits apart, word ends marked)
    drops white space and never joins across it, so a text's ids are those of its chunks in
    turn, and each distinct chunk is encoded once. Any other tokenizer gets whole texts.
    """

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            self.by_chunk = known_form(json.load(f))
        self.known: dict[str, bytes] = {"": b""}
        if not self.by_chunk:
            return
        entries = self.tokenizer.get_vocab()
        self.final = np.zeros(max(entries.values()) + 1, bool)
        self.final[[i for t, i in entries.items() if t.endswith("</w>")]] = True
        self.marks = dict(zip(".,", self._encode_each([".", ","]), strict=True))

    def _encode(self, chunks: list[str]) -> list[bytes]:
        """Ids of each chunk. Chunks of letters alone end with the one token that ends a word, so they go together."""
        words = [c for c in chunks if c.isalpha()]
        if len(words) < 2:
            return self._encode_each(chunks)
        ids = np.asarray(self.tokenizer.encode(" ".join(words), add_special_tokens=False).ids, "<u4")
        ends = np.flatnonzero(self.final[ids]) + 1
        if len(ends) != len(words):
            return self._encode_each(chunks)
        raw, cuts = ids.tobytes(), (4 * ends).tolist()
        known = dict(zip(words, [raw[a:b] for a, b in zip([0, *cuts[:-1]], cuts, strict=True)], strict=True))
        rest = [c for c in chunks if c not in known]
        known.update(zip(rest, self._encode_each(rest), strict=True))
        return [known[c] for c in chunks]

    def _encode_each(self, chunks: list[str]) -> list[bytes]:
        return [np.asarray(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(chunks, add_special_tokens=False)]

    def __call__(self, texts: list[str | None]) -> Iterator[bytes]:
        if not self.by_chunk:
            yield from self._encode_each([t or "" for t in texts])
            return
        if len(self.known) > CACHED:
            self.known = {"": b""}
        split = [(t or "").replace("\n", " ").replace("\t", " ").split(" ") for t in texts]
        new = list(set().union(*split).difference(self.known)) if split else []
        known = self.known
        if new:
            # a full stop or comma after a letter is a token of its own, and case is dropped: most new chunks are known words
            plain = [c[:-1] if len(c) > 1 and c[-1] in ".," and c[-2].isalpha() else c for c in new]
            plain = [c.lower() if c.isascii() else c for c in plain]
            words = list(set(plain).difference(known))
            known.update(zip(words, self._encode(words), strict=True))
            for c, word in zip(new, plain, strict=True):
                if c not in known:
                    known[c] = known[word] if len(c) == len(word) else known[word] + self.marks[c[-1]]
            new += words
        for chunks in split:
            yield b"".join([known[c] for c in chunks])
        for c in new:
            if len(c) > CACHED_CHARS:
                known.pop(c, None)


@functools.cache
def encoder(path: str) -> Encoder:
    """One per worker process, so that tasks share what is known."""
    return Encoder(path)


def pieces(docs: DataFrame, tokenizer_path: str, end_id: int = 2, capacity: int = 4096) -> DataFrame:
    """The pieces of every text: doc_id, start, length, ids_crc32, doc_tokens."""
    small_batches(docs.sparkSession)
    end = np.asarray([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer_path)
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                rows: list[tuple] = []
                for doc, ids in zip(part.column(0).to_pylist(), encode(part.column(1).to_pylist()), strict=True):
                    ids += end
                    n = len(ids) // 4
                    for start in range(0, n, capacity):
                        cut = ids[4 * start : 4 * (start + capacity)]
                        rows.append((doc, start, len(cut) // 4, zlib.crc32(cut), n))
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows, strict=True)], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return docs.select("doc_id", "text").mapInArrow(run, PIECES)


def fullest(lengths: list[int], counts: dict[int, int], room: int) -> dict[int, int]:
    """How many of each length to take for the largest sum up to room; lengths descending.

    Bit s of a bitset says that the sum s can be made. The bitset before each step is
    kept for walking back; steps take 1, 2, 4... of a length, so few steps cover its count.
    """
    made, mask, steps = 1, (1 << (room + 1)) - 1, []
    for n in lengths:
        if n > room:
            continue
        left, take = min(counts[n], room // n), 1
        while left:
            take = min(take, left)
            steps.append((n, take, made))
            made |= (made << (n * take)) & mask
            left -= take
            take *= 2
        if made >> room & 1:
            break
    total, used = made.bit_length() - 1, {}
    for n, take, before in reversed(steps):
        if not before >> total & 1:
            total -= n * take
            used[n] = used.get(n, 0) + take
    return used


def minimum_slack(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, dict[int, int]]]:
    """Patterns (first sequence, how many sequences, count of each length) that use up the histogram."""
    counts = {n: c for n, c in histogram.items() if c}
    lengths = sorted(counts, reverse=True)
    out, sequence = [], 0
    while lengths:
        first = lengths[0]
        counts[first] -= 1
        used = fullest(lengths, counts, capacity - first)
        counts[first] += 1
        used[first] = used.get(first, 0) + 1
        times = min(counts[n] // k for n, k in used.items())
        for n, k in used.items():
            counts[n] -= k * times
        lengths = [n for n in lengths if counts[n]]
        out.append((sequence, times, used))
        sequence += times
    return out


def packed(docs: DataFrame, tokenizer_path: str, end_id: int = 2, capacity: int = 4096, rank_rows: int = 100_000) -> DataFrame:
    """Pieces with their sequence_id and offset there.

    rank_rows: about how many pieces are numbered by one task, also of one length.
    """
    spark = docs.sparkSession
    cut = stored(pieces(docs, tokenizer_path, end_id, capacity), "pieces")
    parts = max(4, -(-cut.count() // rank_rows))
    cut = cut.withColumn("part", F.pmod(F.xxhash64("doc_id", "start"), F.lit(parts)).cast("int"))
    sizes = cut.groupBy("length", "part").count()
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.withColumn("base", F.coalesce(F.sum("count").over(before), F.lit(0))).drop("count")
    histogram = {r["length"]: r["n"] for r in sizes.groupBy("length").agg(F.sum("count").alias("n")).collect()}
    runs, used = [], dict.fromkeys(histogram, 0)
    for sequence, times, pattern in minimum_slack(histogram, capacity):
        offset = 0
        for n in sorted(pattern, reverse=True):
            k = pattern[n]
            runs.append((n, used[n], used[n] + k * times, sequence, k, offset))
            used[n] += k * times
            offset += k * n
    # A pattern uses up at least one length or all but less than itself of it, so runs are bounded by the capacity.
    plan = spark.createDataFrame(runs or [(0, 0, 0, 0, 1, 0)], "length long, low long, high long, sequence long, each long, at long")
    within = Window.partitionBy("length", "part").orderBy("doc_id", "start", "ids_crc32")
    ranked = cut.withColumn("nth", F.row_number().over(within) - 1).join(starts, ["length", "part"]).withColumn("nth", F.col("base") + F.col("nth"))
    k = F.col("nth") - F.col("low")
    return (
        ranked.join(F.broadcast(plan), (ranked["length"] == plan["length"]) & (F.col("nth") >= F.col("low")) & (F.col("nth") < F.col("high")))
        .select(
            "doc_id",
            "start",
            ranked["length"],
            "ids_crc32",
            "doc_tokens",
            (F.col("sequence") + F.floor(k / F.col("each"))).cast("long").alias("sequence_id"),
            (F.col("at") + k % F.col("each") * ranked["length"]).cast("long").alias("offset"),
        )
    )
