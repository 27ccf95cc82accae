"""Removal of long repeated byte strings, over run-length indexes of the texts' repetitive parts.

Every window of `length` bytes has an anchor: the place of the least hash of the strings of
GRAM bytes in it, the last one among equals. Equal windows have equal anchors, so a run of
windows with one anchor (a segment) need only be compared with segments of the same anchor
hash, and each window lies in exactly one segment.

1. All segments' hashes are counted. Bitmaps, whose size follows the number of anchors up to
   a bound, keep which anchors occur more than once, which with different segments, and which
   are hot: more than HOT of their segments, or a thousandth of all.
2. Segments with such anchors meet by anchor hash. Where whole segments are equal, all their
   windows are repeated; those equal within a slice of a task are settled there, and one
   stands for them, so that passages of any frequency move few rows. Of segments that differ,
   one of a kind is kept, with its bytes. Segments of a hot anchor are cut into their
   windows first, each keyed by its own hash: equal ones meet, and no key is hot any more.
3. The kept segments become texts of an index, some megabytes at a time: their suffixes are
   sorted, the Burrows-Wheeler transform is cut into runs, and the length of the match with
   the neighbour in suffix order is worked out at the runs' ends alone. Streaming through the
   text, the match at the next place is one shorter unless the place is at a run's end, which
   gives every place's longest match. Windows whose match reaches `length` are repeated.

Anchors come from cheap hashes, which only bring segments together. Equality is that of
BLAKE2 digests (64 bits of them among the segments of one anchor, 128 for windows and whole
texts), and match lengths in an index are compared byte by byte.

Repeated stretches are merged and cut out of the texts; texts are keyed by digest, as equal
texts lose equal bytes. Null and empty texts have no bytes, an empty table gives an empty
result; very long texts are read in pieces; repeated rows are texts of their own, so both are
emptied if long enough; ids may repeat or be null. Matches never cross texts; other columns
are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _BYTE, Bytes, bitmap, dropped, has_bit, mix, powers, slices, small_batches, stored

GRAM = 128
PIECE = 1 << 22
PLACE_BITS = np.uint64(23)
SLICE = 1 << 20
INDEX_BYTES = 1 << 19
HOT = 8192  # segments of one anchor that go into an index together


class Hashes:
    """Cheap hashes of any stretch of a byte buffer: equal stretches have equal ones, the reverse must be checked."""

    def __init__(self, data: np.ndarray):
        up, self.down = powers(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_BYTE[data] * up[: len(data)], out=self.sums[1:])

    def __call__(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self.sums[ends] - self.sums[starts]) * self.down[starts] ^ (ends - starts).astype(np.uint64))

    def grams(self, size: int) -> np.ndarray:
        n = len(self.sums) - size
        return mix((self.sums[size:] - self.sums[:n]) * self.down[:n])


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """The least of every width values in turn."""
    n = len(x) - width + 1
    pad = -len(x) % width
    blocks = np.concatenate([x, np.full(pad, np.iinfo(x.dtype).max, x.dtype)]).reshape(-1, width)
    before = np.minimum.accumulate(blocks, axis=1).ravel()
    after = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(after[:n], before[width - 1 : width - 1 + n])


def segments(data: np.ndarray, offs: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """text, first window, number of windows and anchor hash of every segment."""
    out = []
    low = (np.uint64(1) << PLACE_BITS) - np.uint64(1)
    gram = min(GRAM, length)
    for base in range(0, max(0, len(data) - length + 1), PIECE):
        part = data[base : base + PIECE + length - 1]
        h = Hashes(part)
        grams = h.grams(gram)
        place = np.arange(len(grams), dtype=np.uint64)
        least = sliding_min((grams & ~low) | (low - place), length - gram + 1)
        anchor = (low - (least & low)).astype(np.int64)
        at = np.arange(len(anchor))
        doc = np.searchsorted(offs, at + base, "right") - 1
        ok = at + base + length <= offs[doc + 1]
        new = np.ones(len(at), bool)
        new[1:] = (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1]) | (ok[1:] != ok[:-1])
        first = np.flatnonzero(new)
        count = np.diff(np.append(first, len(at)))
        first, count = first[ok[first]], count[ok[first]]
        out.append((doc[first], first + base, count, grams[anchor[first]]))
    none = np.zeros(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (none, none, none, none.astype(np.uint64))


def digests(raw: bytes, starts: np.ndarray, ends: np.ndarray, size: int) -> np.ndarray:
    """BLAKE2 digests of stretches, as rows of 64-bit numbers."""
    make = hashlib.blake2b
    found = [make(raw[a:b], digest_size=size).digest() for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
    return np.frombuffer(b"".join(found), np.uint64).reshape(len(found), size // 8)


def _i64(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64) if x.dtype == np.uint64 else x.astype(np.int64))


def _counts(length: int):
    """anchor, least, most, n: of the segments of a slice with one anchor, the least and largest hash and their number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, limit=SLICE):
                b = Bytes(part.column(0))
                _, first, n, anchor = segments(b.data, b.offs, length)
                whole = digests(b.data.tobytes(), first, first + n + length - 1, 8)[:, 0]
                order = np.lexsort((whole.view(np.int64), anchor))
                anchor, whole = anchor[order], whole[order].view(np.int64)
                at = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]])) if len(anchor) else np.zeros(0, np.int64)
                n = np.diff(np.append(at, len(anchor)))
                yield pa.RecordBatch.from_arrays([_i64(anchor[at]), _i64(whole[at]), _i64(whole[at + n - 1]), _i64(n)], names=["anchor", "least", "most", "n"])

    return run


def _text_digests(b: Bytes) -> np.ndarray:
    """Digests of whole texts, as rows of two numbers."""
    return digests(b.data.tobytes(), b.offs[:-1], b.offs[1:], 16)


def _binary(x: np.ndarray) -> pa.Array:
    """Rows of two numbers as byte strings."""
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(16), len(x), [None, pa.py_buffer(np.ascontiguousarray(x))]).cast(pa.binary())


SEGMENTS = "anchor long, whole long, text binary, first long, n long, bytes binary, state int"
_NAMES = ["anchor", "whole", "text", "first", "n", "bytes", "state"]
ONE, SEVERAL, SETTLED = 0, 1, 2  # one segment; one that stands for several; a stretch known to be repeated, with its bytes for n


def _chosen(length: int, repeated: np.ndarray, varied: np.ndarray, hot: np.ndarray):
    """Segments whose anchor may be repeated; with bytes where the anchor's segments may differ, once for equal ones of a slice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, limit=SLICE):
                b = Bytes(part.column(0))
                raw = b.data.tobytes()
                doc, first, n, anchor = segments(b.data, b.offs, length)
                use = has_bit(repeated, anchor)
                doc, first, n, anchor = (x[use] for x in (doc, first, n, anchor))
                show, cut = has_bit(varied, anchor), has_bit(hot, anchor)
                whole = np.zeros(len(anchor), np.uint64)
                whole[~cut] = digests(raw, first[~cut], (first + n)[~cut] + length - 1, 8)[:, 0]
                if cut.any():  # windows of hot anchors, each on its own
                    each = n[cut]
                    at = np.repeat(first[cut] - np.concatenate([[0], np.cumsum(each)[:-1]]), each) + np.arange(each.sum())
                    keys = digests(raw, at, at + length, 16)
                    doc, show = np.concatenate([doc[~cut], np.repeat(doc[cut], each)]), np.concatenate([show[~cut], np.zeros(len(at), bool)])
                    first, n = np.concatenate([first[~cut], at]), np.concatenate([n[~cut], np.ones(len(at), np.int64)])
                    anchor, whole = np.concatenate([anchor[~cut], keys[:, 0]]), np.concatenate([whole[~cut], keys[:, 1]])
                order = np.lexsort((first, whole, anchor))
                new = np.ones(len(order), bool)
                new[1:] = (anchor[order[1:]] != anchor[order[:-1]]) | (whole[order[1:]] != whole[order[:-1]])
                at = order[new]
                kind = np.zeros(len(order), np.int64)
                kind[order] = np.cumsum(new) - 1
                times = np.bincount(kind, minlength=len(at))
                text, start = _text_digests(b), first - b.offs[doc]
                # what is equal here is repeated: stretches are merged text by text
                equal = np.flatnonzero(times[kind] > 1)
                order = equal[np.lexsort((start[equal], doc[equal]))]
                d, low = doc[order], start[order]
                high = np.maximum.accumulate(low + n[order] + length - 1 + d * (len(raw) + length)) - d * (len(raw) + length) if len(order) else low
                fresh = np.ones(len(order), bool)
                fresh[1:] = (d[1:] != d[:-1]) | (low[1:] > high[:-1])
                head = np.flatnonzero(fresh)
                tail = np.append(head, len(order))[1:] - 1
                low, size, own = low[head], high[tail] - low[head], text[d[head]]
                bytes_ = [raw[a : a + k + length - 1] if s else None for a, k, s in zip(first[at].tolist(), n[at].tolist(), show[at].tolist(), strict=True)]
                columns = [
                    np.concatenate([anchor[at], mix(own[:, 0] ^ low.astype(np.uint64))]),  # settled stretches go anywhere
                    np.concatenate([whole[at], np.zeros(len(own), np.uint64)]),
                    np.concatenate([start[at], low]),
                    np.concatenate([n[at], size]),
                ]
                anchors, wholes, starts, sizes = map(_i64, columns)
                state = np.concatenate([np.where(times > 1, SEVERAL, ONE), np.full(len(own), SETTLED)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([anchors, wholes, _binary(np.concatenate([text[doc[at]], own])), starts, sizes, pa.array([*bytes_, *[None] * len(own)], pa.binary()), pa.array(state)], names=_NAMES)

    return run


def suffix_array(text: np.ndarray, limit: int) -> np.ndarray:
    """Suffixes in order, by sorting on ranks of ever longer prefixes.

    text: numbers from 0, distinct at the ends of parts of at most limit. Short texts treble the
    prefix in each round, as three ranks fit one key; long ones double it.
    """
    n, letters = len(text), int(text.max()) + 2
    rank, width, bits = text.astype(np.int64), 1, max(1, (letters - 1).bit_length())

    def sort(symbols: np.ndarray, step: int, times: int, size: int) -> tuple[np.ndarray, np.ndarray]:
        key = symbols + 1
        for k in range(1, times):
            key <<= size
            key[: n - min(n, k * step)] |= symbols[min(n, k * step) :] + 1
        order = np.argsort(key)  # equal keys share a rank, so their order does not matter
        key = key[order]
        new = np.empty(n, np.int64)
        new[order] = np.concatenate([[0], np.cumsum(key[1:] != key[:-1])])
        return order, new

    times = max(1, 62 // bits)
    order, rank = sort(rank, 1, times, bits)
    width *= times
    size = n.bit_length()
    times = 3 if 3 * size <= 63 else 2
    while rank[order[-1]] < n - 1 and width <= limit:
        order, rank = sort(rank, width, times, size)
        width *= times
    return order


class RunIndex:
    """A run-length index of parts: the Burrows-Wheeler transform's runs, sampled at their ends."""

    def __init__(self, parts: list[bytes]):
        sizes = np.array([len(p) for p in parts]) + 1
        self.starts = np.concatenate([[0], np.cumsum(sizes)])
        self.raw = b"\x00".join(parts) + b"\x00"
        text = np.frombuffer(self.raw, np.uint8).astype(np.int64) + len(parts)
        text[self.starts[1:] - 1] = np.arange(len(parts))  # each part's end is a letter of its own
        # letters that occur, numbered in order, so that keys stay small
        self.text = np.unique(text, return_inverse=True)[1]
        order = suffix_array(self.text, int(sizes.max()))
        before = self.text[order - 1]
        change = np.flatnonzero(before[1:] != before[:-1]) + 1
        # the suffixes at both ends of every run, with the neighbour across the boundary
        self.samples = np.concatenate([order[change], order[change - 1], order[:1], order[-1:]])
        self.others = np.concatenate([order[change - 1], order[change], order[:1], order[-1:]])
        self.above = np.concatenate([np.ones(len(change), bool), np.zeros(len(change), bool), [True, False]])

    def matches(self, limit: int) -> np.ndarray:
        """For each place, the length of its longest match with another place, exact up to limit."""
        h = Hashes((self.text % 256).astype(np.uint8))
        n = len(self.text)
        ends = self.starts[np.searchsorted(self.starts, np.arange(n), "right")] - 1  # where each place's part ends
        best = np.zeros(n, np.int64)
        for side in (True, False):
            a, b = self.samples[self.above == side], self.others[self.above == side]
            low, high = np.zeros(len(a), np.int64), np.where(a == b, 0, np.minimum(ends[a] - a, ends[b] - b))
            high = np.minimum(high, 2 * limit)
            while (low < high).any():
                middle = (low + high + 1) // 2
                same = h(a, a + middle) == h(b, b + middle)
                low, high = np.where(same, middle, low), np.where(same, high, middle - 1)
            # equal hashes may deceive; only matches of limit and more matter
            for i in np.flatnonzero(low >= limit).tolist():
                x, y = self.raw[a[i] : a[i] + low[i]], self.raw[b[i] : b[i] + low[i]]
                if x != y:
                    low[i] = np.flatnonzero(np.frombuffer(x, np.uint8) != np.frombuffer(y, np.uint8))[0]
            value = np.full(n, -1, np.int64)
            value[a] = low
            # between samples the match with the same neighbour shortens by one at each step
            last = np.maximum.accumulate(np.where(value >= 0, np.arange(n), 0))
            best = np.maximum(best, value[last] - (np.arange(n) - last))
        return best


def _stretches(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.diff(np.concatenate([[0], flags.astype(np.int8), [0]]))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


SPANS = "text binary, start long, stop long"


def _matched(length: int, index_bytes: int):
    """text, start, stop of repeated stretches. Rows come by anchor, whole."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        kinds: dict[int, list] = {}  # of the anchor in progress: whole -> [text, first, n, bytes, repeated]
        anchor_now: int | None = None
        index: list[list] = []
        size = 0

        def spans() -> pa.RecordBatch:
            rows = [pa.array([r[i] for r in out], t) for i, t in enumerate((pa.binary(), pa.int64(), pa.int64()))]
            out.clear()
            return pa.RecordBatch.from_arrays(rows, names=["text", "start", "stop"])

        def search() -> None:
            nonlocal size
            if len(index) > 1:
                runs = RunIndex([k[3] for k in index])
                long = runs.matches(length) >= length
                for i, (text, first, _, data, repeated) in enumerate(index):
                    if not repeated:
                        for a, b in zip(*_stretches(long[runs.starts[i] : runs.starts[i] + len(data)]), strict=True):
                            out.append((text, first + int(a), first + int(b) + length - 1))
            index.clear()
            size = 0

        def close() -> None:
            nonlocal size
            if len(kinds) > 1:
                more = [k for k in kinds.values() if k[3] is not None]
                index.extend(more)
                size += sum(len(k[3]) for k in more)
            kinds.clear()
            if size > index_bytes:
                search()

        for batch in batches:
            for anchor, whole, text, first, n, data, state in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if state == SETTLED:
                    out.append((text, first, first + n))
                    continue
                if anchor != anchor_now:
                    close()
                    anchor_now = anchor
                kind = kinds.get(whole)
                if kind is None:
                    kinds[whole] = [text, first, n, data, state == SEVERAL]
                else:
                    if not kind[4]:
                        kind[4] = True
                        out.append((kind[0], kind[1], kind[1] + kind[2] + length - 1))
                    if kind[3] is None and data is not None:
                        kind[3] = data
                    if (text, first) != (kind[0], kind[1]):
                        out.append((text, first, first + n + length - 1))
            if len(out) > 50_000:
                yield spans()
        close()
        search()
        yield spans()

    return run


def _merged(starts: list[int], stops: list[int]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(zip(starts, stops, strict=True)):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def _row(doc: int | None, data: bytes, cuts: list[tuple[int, int]]) -> tuple:
    kept, at = hashlib.sha256(), 0
    for a, b in cuts:
        kept.update(data[at:a])
        at = b
    kept.update(data[at:])
    return doc, len(data), sum(b - a for a, b in cuts), len(cuts), kept.hexdigest()


def _results(rows: list[tuple]) -> pa.RecordBatch:
    types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def repeated_spans(docs: DataFrame, length: int = 400, index_bytes: int = INDEX_BYTES, hot: int = HOT) -> DataFrame:
    """text (a digest of the whole text), starts and stops of the repeated stretches of every text that has any."""
    small_batches(docs.sparkSession)
    texts = docs.select("text")
    counts = texts.mapInArrow(_counts(length), "anchor long, least long, most long, n long")
    counts = counts.groupBy("anchor").agg(F.min("least").alias("least"), F.max("most").alias("most"), F.sum("n").alias("n"))
    counts = stored(counts.where("n > 1").select("anchor", "n", (F.col("least") != F.col("most")).alias("varied")), "anchors")
    rows, total = counts.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    crowded = counts.where(F.col("n") > min(hot, max(16, total // 1000)))
    maps = [bitmap(x, "anchor", rows) for x in (counts, counts.where("varied"), crowded)]
    dropped(counts)
    chosen = texts.mapInArrow(_chosen(length, *maps), SEGMENTS)
    chosen = chosen.repartition("anchor").sortWithinPartitions("anchor", "whole")
    found = chosen.mapInArrow(_matched(length, index_bytes), SPANS).distinct()
    return found.groupBy("text").agg(F.collect_list("start").alias("starts"), F.collect_list("stop").alias("stops"))


def removed(docs: DataFrame, length: int = 400, index_bytes: int = INDEX_BYTES, hot: int = HOT) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every document."""
    spans = stored(repeated_spans(docs, length, index_bytes, hot), "spans")
    bits = bitmap(spans.select(_first_number("text").alias("h")), "h", spans.count())
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")

    def without(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, limit=SLICE):
                b = Bytes(part.column(1))
                keep = ~has_bit(bits, _text_digests(b)[:, 0])
                raw, offs, ids = b.data.tobytes(), b.offs.tolist(), part.column(0).to_pylist()
                yield _results([_row(ids[i], raw[offs[i] : offs[i + 1]], []) for i in np.flatnonzero(keep).tolist()])

    def hit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, limit=SLICE):
                h = _text_digests(Bytes(part.column(1)))
                use = np.flatnonzero(has_bit(bits, h[:, 0]))
                # copies that come together are one row, so a text that fills the table moves and is cut few times
                _, first, which = np.unique(h[use], axis=0, return_index=True, return_inverse=True)
                order = np.argsort(which.ravel(), kind="stable")
                ends = np.concatenate([[0], np.cumsum(np.bincount(which.ravel(), minlength=len(first)))]).astype(np.int32)
                ids = pa.ListArray.from_arrays(pa.array(ends), part.column(0).take(pa.array(use[order])))
                yield pa.RecordBatch.from_arrays([ids, part.column(1).take(pa.array(use[first])), _binary(h[use[first]])], names=["doc_ids", "data", "text"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for docs_of, data, starts, stops in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                row = _row(None, (data or "").encode(), _merged(starts or [], stops or []))
                rows += [(doc, *row[1:]) for doc in docs_of]
            yield _results(rows)

    with_spans = docs.mapInArrow(hit, "doc_ids array<long>, data string, text binary").join(spans, "text", "left").select("doc_ids", "data", "starts", "stops")
    return docs.mapInArrow(without, RESULT).unionByName(with_spans.mapInArrow(cut, RESULT))


def _first_number(col: str):
    """The first eight bytes of a byte string as numpy reads them, low byte first; a negative long stands for the upper half."""
    high = F.conv(F.hex(F.concat(*(F.substring(col, i, 1) for i in range(8, 0, -1)))), 16, -10)
    return high.cast("long")
