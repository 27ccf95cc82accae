"""Benchmark decontamination by latent semantic search and longest common subsequences.

Benchmark items are cut into units of at most `window` words, and one more unit lies across
every border of two; the columns of the term matrix are the units' words. Texts are read as passages of `window` words, overlapping by
half. Three passes over all texts:

1. document frequencies of the columns over all passages.
2. a randomised SVD of the TF-IDF passages, texts' and benchmark's together: every task adds
   up its part of A'A times a random matrix, and from the sums (the Nystroem approximation
   of A'A) come the leading right singular vectors and singular values. Benchmark rows are
   weighted to hold as much as all texts do, so that their own directions lead.
3. every passage with a column word is projected and compared with all units by cosine. Units
   near enough are checked on the words themselves: the longest common subsequence with the
   passage and half a window to either side must cover 60 % of the unit's words, or 50 %
   if it covers 80 % of the words of the item's answer (its last sentence, if it has six
   words or more) as well; or, with two windows to either side, 85 % of the unit's words,
   for copies with much put in between. (In yet longer stretches the frequent words of any
   text cover much of a unit.) So
   copies with words changed, left out or put in between are found. Units under eight words
   must be there whole. Besides, any run of 13 words of an item that a text holds word for
   word is a leak, whatever its units.

Words are lower-cased (in all scripts) runs without white space, without punctuation at their ends. Null and
blank texts hold nothing and are clean; null or blank items are no items. Repeated rows are
judged each; ids may be null or repeat; an empty table gives an empty result; very long texts
are read whole. Other columns are ignored or kept, whatever their names. The benchmark is
broadcast, and so is checked: at most max_words words in all items.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, mix, slices, small_batches

ANSWER_WORDS = 6
RUN_WORDS = 13
HEAD = 512  # columns with the most passages, multiplied as a dense matrix
PART_ROWS = 4096
PART_WORDS = 1 << 19
_BASE = np.uint64(0x9E3779B97F4A7C15)


def lowered(texts: pa.Array) -> pa.Array:
    return pc.utf8_lower(texts)


def word_hashes(w: Words) -> np.ndarray:
    """Hashes of the words without punctuation at their ends."""
    return w.spans(*w.trimmed())


def run_hashes(h: np.ndarray) -> np.ndarray:
    """Hashes of the runs of RUN_WORDS words, by first word."""
    out = np.zeros(max(0, len(h) - RUN_WORDS + 1), np.uint64)
    for i in range(RUN_WORDS):
        out *= _BASE
        out += h[i : i + len(out)]
    return mix(out)


def covered(words: list[int], masks: dict[int, int], n: int) -> int:
    """The length of the longest common subsequence with a unit of n words, whose places masks holds by word."""
    v = full = (1 << n) - 1
    for x in words:
        if m := masks.get(x):
            u = v & m
            v = ((v + u) | (v - u)) & full
    return n - v.bit_count()


class Benchmark:
    """Units of the items, their runs, and the columns: words of units, ascending by hash."""

    def __init__(self, items: list[tuple[int, str]], window: int):
        self.window = window
        self.items: list[int] = []
        self.units: list[np.ndarray] = []
        self.answers: list[np.ndarray] = []
        self.units_of: list[range] = []
        runs, half = [], window // 2
        for item, text in items:
            h = word_hashes(Words(lowered(pa.array([text]))))
            last = [s for s in re.split(r"(?<=[.?!])\s+", text.strip()) if s.strip()][-1:]
            answer = word_hashes(Words(lowered(pa.array(last or [""]))))
            begins, before = range(0, max(1, len(h) - window // 4), window), len(self.units)
            spans = [(at, len(h) if len(h) - at <= window + window // 4 else at + window) for at in begins]
            spans += [(at - half, min(len(h), at + window - half)) for at in begins[1:] if half]
            for at, end in spans:
                unit = h[at:end]
                if len(unit):
                    self.items.append(item)
                    self.units.append(unit)
                    self.answers.append(answer if len(answer) >= ANSWER_WORDS and len(unit) > len(answer) and at + len(unit) == len(h) else unit[:0])
            runs.append(np.unique(run_hashes(h)))
            self.units_of.append(range(before, len(self.units)))
        self.columns = np.unique(np.concatenate([*self.units, np.zeros(0, np.uint64)]))
        self.near = np.zeros(1 << 16, bool)
        self.near[(self.columns & np.uint64(0xFFFF)).astype(np.int64)] = True
        of = np.repeat(np.arange(len(runs)), [len(r) for r in runs])
        self.runs = np.concatenate([*runs, np.zeros(0, np.uint64)])
        order = np.argsort(self.runs, kind="stable")
        self.runs, self.run_of = self.runs[order], of[order].astype(np.int32)
        self.near_runs = np.zeros(1 << 20, bool)
        self.near_runs[(self.runs & np.uint64(0xFFFFF)).astype(np.int64)] = True

    def held_runs(self, w: Words, h: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """Text, place of the first word and index of the item of each run that texts hold; of adjoining runs of an item the first."""
        if not len(self.runs):
            return
        g = run_hashes(h)
        place = np.flatnonzero(self.near_runs[(g & np.uint64(0xFFFFF)).astype(np.int64)])
        low, high = (np.searchsorted(self.runs, g[place], side) for side in ("left", "right"))
        doc = np.searchsorted(w.first, place, "right") - 1
        use = (high > low) & (place + RUN_WORDS <= w.first[doc + 1])
        last: dict[tuple[int, int], int] = {}
        for at, d, a, b in zip(*(x[use].tolist() for x in (place, doc, low, high)), strict=True):
            for i in self.run_of[a:b].tolist():
                if last.get((d, i)) != at - 1:
                    yield d, at, i
                last[d, i] = at

    def weigh(self, frequency: np.ndarray, passages: int) -> None:
        """The columns' inverse document frequencies; which columns are frequent, and their places among these."""
        self.idf = np.log((1 + passages) / (1 + frequency)) + 0.1
        self.head = np.argsort(-frequency, kind="stable")[:HEAD]
        self.slot = np.full(len(frequency), -1)
        self.slot[self.head] = np.arange(len(self.head))

    def rows(self) -> tuple[np.ndarray, np.ndarray]:
        """Unit and column of each column word of the units."""
        unit = np.repeat(np.arange(len(self.units)), [len(u) for u in self.units])
        return self._hits(np.concatenate(self.units), unit)

    def _hits(self, h: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        use = self.near[(h & np.uint64(0xFFFF)).astype(np.int64)]
        h, of = h[use], of[use]
        at = np.minimum(np.searchsorted(self.columns, h), len(self.columns) - 1)
        hit = self.columns[at] == h
        return of[hit], at[hit]

    def blocks(self, w: Words, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Block and column of each column word, the first block of each text and the end, and the column words' places; blocks are half a window."""
        half = self.window // 2
        count = np.diff(w.first)
        base = np.concatenate([[0], np.cumsum(-(-count // half))])
        place, col = self._hits(h, np.arange(len(h)))
        doc = np.searchsorted(w.first, place, "right") - 1
        return base[doc] + (place - w.first[doc]) // half, col, base, place


def _whole(block: np.ndarray, base: np.ndarray) -> np.ndarray:
    """For blocks, the passage they lie in when passages do not overlap: two blocks of a text each."""
    doc = np.searchsorted(base, block, "right") - 1
    return base[doc] + (block - base[doc]) // 2 * 2


def _frequencies(bench: Benchmark):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = len(bench.columns), 0
        counts = np.zeros(n, np.int64)
        for batch in batches:
            for part in slices(batch):
                w = Words(lowered(part.column(0)))
                block, col, base, _ = bench.blocks(w, word_hashes(w))
                cells = np.sort(_whole(block, base) * n + col)
                counts += np.bincount(cells[_firsts(cells)] % n, minlength=n)
                total += int((-(-np.diff(base) // 2)).sum())
        yield pa.RecordBatch.from_arrays([pa.array([*range(n), -1], pa.int32()), pa.array([*counts, total], pa.int64())], names=["col", "n"])

    return run


def _firsts(x: np.ndarray) -> np.ndarray:
    """The places in ascending values where another one begins."""
    return np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]])) if len(x) else np.zeros(0, np.int64)


def _summed(row: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums of values by row; rows ascending."""
    at = _firsts(row)
    return row[at], np.add.reduceat(values, at, axis=0) if len(at) else values[:0]


def _parts(bench: Benchmark, row: np.ndarray, col: np.ndarray, values: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """Rows (ascending), PART_ROWS at a time, and the sums of their columns' values.

    Besides, how often each holds each frequent column, and row within the part and column of the other column words.
    """
    first = np.append(_firsts(row), len(row))
    often = values[bench.head]
    for i in range(0, len(first) - 1, PART_ROWS):
        bounds = first[i : i + PART_ROWS + 1]
        own, n = col[bounds[0] : bounds[-1]], len(bounds) - 1
        nth, slot = np.repeat(np.arange(n), np.diff(bounds)), bench.slot[own]
        dense = slot >= 0
        counts = np.zeros((n, len(often)), np.float32)
        np.add.at(counts.reshape(-1), nth[dense] * len(often) + slot[dense], np.float32(1))
        sums = counts @ often
        rare, other = nth[~dense], own[~dense]
        at, more = _summed(rare, values[other])
        sums[at] += more
        yield row[bounds[:-1]], sums, counts, rare, other


def _gram(bench: Benchmark, row: np.ndarray, col: np.ndarray, weighted: np.ndarray, into: np.ndarray) -> None:
    """Adds A'(A omega) of TF-IDF rows; row ascending. weighted: omega times the columns' idf."""
    idf = bench.idf.astype(into.dtype)[:, None]
    for _, y, counts, rare, other in _parts(bench, row, col, weighted):
        into[bench.head] += counts.T @ y * idf[bench.head]
        order = np.argsort(other, kind="stable")
        cols, sums = _summed(other[order], y[rare[order]])
        into[cols] += sums * idf[cols]


def _sketch(bench: Benchmark, omega: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(omega.shape, np.float32)
        weighted = omega * bench.idf.astype(np.float32)[:, None]
        for batch in batches:
            for part in slices(batch):
                w = Words(lowered(part.column(0)))
                block, col, base, _ = bench.blocks(w, word_hashes(w))
                _gram(bench, _whole(block, base), col, weighted, total)
        used = np.flatnonzero(total.any(axis=1))
        bounds = np.arange(len(used) + 1, dtype=np.int32) * omega.shape[1]
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.ListArray.from_arrays(pa.array(bounds), pa.array(total[used].ravel()))], names=["col", "v"])

    return run


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of vectors by column, over one partition: no more rows than columns."""
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for col, v in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            x = np.asarray(v.values, np.float64)
            sums[col] = sums[col] + x if col in sums else x
    yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([v.tolist() for v in sums.values()], pa.list_(pa.float64()))], names=["col", "v"])


def singular_vectors(y: np.ndarray, omega: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The leading right singular vectors and singular values of A from y = A'A omega, by the Nystroem approximation."""
    shift = 1e-9 * np.linalg.norm(y)
    y = y + shift * omega
    core = omega.T @ y
    values, vectors = np.linalg.eigh((core + core.T) / 2)
    use = values > 1e-12 * max(values.max(initial=0.0), 1e-300)
    half = y @ (vectors[:, use] / np.sqrt(values[use]))
    u, s, _ = np.linalg.svd(half, full_matrices=False)
    return u, np.sqrt(np.maximum(s**2 - shift, 0))


def prepared(docs: DataFrame, benchmark: DataFrame, window: int = 64, rank: int = 96, max_words: int = 400_000, id_col: str = "item_id", text_col: str = "text") -> tuple[Benchmark, np.ndarray]:
    """The benchmark with its columns' weights, and the latent basis times them."""
    small_batches(docs.sparkSession)
    items = benchmark.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    if (items.agg(F.sum(F.size(F.split("text", r"\s+")))).first()[0] or 0) > max_words:
        raise ValueError(f"more than {max_words} words in the benchmark: search it in parts")
    bench = Benchmark(sorted(((r[0], r[1]) for r in items.collect()), key=str), window)
    texts, n = docs.select("text"), len(bench.columns)
    frequency, passages = np.zeros(n, np.int64), 0
    if not n:
        bench.idf = np.zeros(0)
        return bench, np.zeros((0, 1), np.float32)
    for r in texts.mapInArrow(_frequencies(bench), "col int, n long").groupBy("col").agg(F.sum("n").alias("n")).collect():
        if r["col"] < 0:
            passages = r["n"]
        else:
            frequency[r["col"]] = r["n"]
    bench.weigh(frequency, passages)
    omega = np.random.default_rng(11).standard_normal((n, min(rank, n))).astype(np.float32)
    parts = texts.mapInArrow(_sketch(bench, omega), "col int, v array<float>").repartition("col").mapInArrow(_added, "col int, v array<double>")
    gram = np.zeros(omega.shape)
    for r in parts.collect():  # one row for each column of the benchmark
        gram[r["col"]] = r["v"]
    own = np.zeros(omega.shape)
    _gram(bench, *bench.rows(), omega * bench.idf[:, None], own)
    weight = 10 * max(1.0, np.linalg.norm(gram)) / max(1e-9, np.linalg.norm(own))
    basis, _ = singular_vectors(gram + weight * own, omega.astype(np.float64))
    return bench, (basis * bench.idf[:, None]).astype(np.float32)


def _set_bits(bits: np.ndarray, row: np.ndarray, col: np.ndarray) -> None:
    np.bitwise_or.at(bits.reshape(-1), row * bits.shape[1] + (col >> 6), np.uint64(1) << (col & 63).astype(np.uint64))


def _common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many bits the rows have in common."""
    a &= b
    return np.bitwise_count(a).sum(axis=1, dtype=np.int64)


class Finder:
    """Finds the units that texts hold."""

    def __init__(self, bench: Benchmark, basis: np.ndarray, cosine: float, share: float, weak_share: float, answer_share: float, wide_share: float):
        self.bench, self.basis, self.cosine = bench, basis, cosine
        self.share, self.weak_share, self.answer_share, self.wide_share = share, weak_share, answer_share, wide_share
        self.latent = np.zeros((len(bench.units), basis.shape[1]), np.float32)
        if len(bench.units):
            unit, col = bench.rows()
            for at, sums, *_ in _parts(bench, unit, col, basis):
                self.latent[at] = sums
            self.latent /= np.maximum(np.linalg.norm(self.latent, axis=1, keepdims=True), 1e-9)
        # the columns of each unit as bits, and how many of them texts must have in common with it
        self.unit_bits = np.zeros((len(bench.units), -(-len(bench.columns) // 64)), np.uint64)
        if len(bench.units):
            _set_bits(self.unit_bits, unit, col)
            self.cells, self.times = np.unique(unit * len(bench.columns) + col, return_counts=True)
        n, different = np.array([len(u) for u in bench.units], np.int64), np.array([len(np.unique(u)) for u in bench.units], np.int64)
        answers = np.array([len(a) > 0 for a in bench.answers], bool)
        self.sizes = n
        self.near_share, self.far_share = np.where(n < 8, 1, np.where(answers, min(share, weak_share), share)), np.where(n < 8, 2, wide_share)
        self.least, self.least_wide = (np.where(n >= 8, s * n, n) - (n - different) for s in (np.where(answers, weak_share, share), wide_share))
        self.masks, self.answer_masks = ([self._masks(u) for u in of] for of in (bench.units, bench.answers))
        self.col_masks = [self._masks(np.searchsorted(bench.columns, u)) for u in bench.units]

    @staticmethod
    def _masks(unit: np.ndarray) -> dict[int, int]:
        out: dict[int, int] = {}
        for i, x in enumerate(unit.tolist()):
            out[x] = out.get(x, 0) | 1 << i
        return out

    def holds(self, near: list[int], wide: list[int], words: np.ndarray, unit: int) -> float:
        """The share of the unit that a passage covers in order, or 0 if that is too little.

        near and wide: the unit's columns among the words around it, and in a wide stretch; words: the hashes of the former's stretch.
        """
        # words of other units never lengthen a subsequence
        n, answer, masks = len(self.bench.units[unit]), len(self.bench.answers[unit]), self.col_masks[unit]
        if near:
            share = covered(near, masks, n) / n
            if share >= (self.share if n >= 8 else 1):
                return share
            if n >= 8 and answer and share >= self.weak_share and covered(words.tolist(), self.answer_masks[unit], answer) >= self.answer_share * answer:
                return share
        if wide and (share := covered(wide, masks, n) / n) >= self.wide_share:
            return share
        return 0.0

    def _own(self, col: np.ndarray, low: np.ndarray, high: np.ndarray, unit: np.ndarray, least: np.ndarray) -> list[list[int]]:
        """For stretches of columns, those of a unit; none if they, each as often as in the unit at most, are a smaller share of it than least."""
        count = high - low
        pair = np.repeat(np.arange(len(unit)), count)
        cols = col[np.arange(len(pair)) + np.repeat(low - np.cumsum(count) + count, count)]
        of = unit[pair]
        own = (self.unit_bits[of, cols >> 6] >> (cols & 63).astype(np.uint64)) & np.uint64(1) == 1
        pair, cols, n = pair[own], cols[own], len(self.bench.columns)
        cells = np.sort(pair * n + cols)
        first = _firsts(cells)
        cell, often = cells[first], np.diff(np.append(first, len(cells)))
        often = np.minimum(often, self.times[np.searchsorted(self.cells, unit[cell // n] * n + cell % n)])
        most = np.bincount(cell // n, often, len(unit)) / self.sizes[unit]
        ends = np.searchsorted(pair, np.arange(len(unit) + 1)).tolist()
        return [cols[a:b].tolist() if use else [] for a, b, use in zip(ends, ends[1:], (most >= least).tolist(), strict=False)]

    def __call__(self, texts: pa.Array) -> list[tuple[int, int, float]]:
        """Text, unit and covered share of what is found."""
        bench = self.bench
        if not len(bench.units):
            return []
        w = Words(lowered(texts))
        h = word_hashes(w)
        found = self._near_units(w, h)
        seen = {(d, bench.items[unit]) for d, unit in found}
        for d, at, i in bench.held_runs(w, h):
            units = bench.units_of[i]
            if (d, bench.items[units[0]]) in seen:
                continue
            near = h[max(w.first[d], at - bench.window) : min(w.first[d + 1], at + 2 * bench.window)].tolist()
            share, unit = max((covered(near, self.masks[u], len(bench.units[u])) / len(bench.units[u]), u) for u in units)
            found[d, unit] = max(share, found.get((d, unit), 0))
        return [(d, unit, share) for (d, unit), share in found.items()]

    def _near_units(self, w: Words, h: np.ndarray) -> dict[tuple[int, int], float]:
        """Covered share by text and unit, of units that passages are near to."""
        bench, half = self.bench, self.bench.window // 2
        block, col, base, place = bench.blocks(w, h)
        parts = [part[:2] for part in _parts(bench, block, col, self.basis)]
        if not parts:
            return {}
        at, sums = (np.concatenate(x) for x in zip(*parts, strict=True))
        # a passage is a block and the next one of its text
        doc = np.searchsorted(base, at, "right") - 1
        passage = np.unique(np.concatenate([at, at[at > base[doc]] - 1]))
        end = base[np.searchsorted(base, passage, "right")]
        spots = [np.minimum(np.searchsorted(at, passage + step), len(at) - 1) for step in (0, 1)]
        there = [(at[spot] == passage + step) & (passage + step < end) for step, spot in enumerate(spots)]
        z = np.zeros((len(passage), self.basis.shape[1]), np.float32)
        for spot, own in zip(spots, there, strict=True):
            z[own] += sums[spot[own]]
        z /= np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-9)
        # which columns each block holds, as bits, with five empty blocks around each text; then each passage with one and with four blocks to either side
        doc = np.searchsorted(base, passage, "right") - 1
        bits = np.zeros((int(base[-1]) + 5 * len(base), self.unit_bits.shape[1]), np.uint64)
        _set_bits(bits, block + 5 * np.searchsorted(base, block, "right"), col)
        spread = passage + 5 * doc + 5
        two = bits[:-1] | bits[1:]
        four = two[:-2] | two[2:]  # a passage's row is one lower here
        ten = four[:-6] | four[4:-2] | two[8:]  # and four lower here
        least = np.minimum(self.least, self.least_wide)
        found: dict[tuple[int, int], float] = {}
        for i in range(0, len(passage), 1024):
            p, unit = np.nonzero(z[i : i + 1024] @ self.latent.T >= self.cosine)
            # no subsequence is longer than what both have in common
            row = spread[i + p]
            far = _common(ten[row - 4], self.unit_bits[unit])
            some = np.flatnonzero(far >= least[unit])
            p, unit, row, far = p[some], unit[some], row[some], far[some]
            use = (far >= self.least_wide[unit]) | (_common(four[row - 1], self.unit_bits[unit]) >= self.least[unit])
            spot, unit = i + p[use], unit[use]
            start, end = w.first[doc[spot]], w.first[doc[spot] + 1]
            first = start + (passage[spot] - base[doc[spot]]) * half
            (low, high), far = ((np.maximum(start, first - k * half), np.minimum(end, first + (2 + k) * half)) for k in (1, 4))
            cuts = [np.searchsorted(place, x) for x in (low, high, *far)]
            words = np.cumsum(cuts[3] - cuts[2])
            at = 0
            while at < len(spot):
                to = max(at + 1, int(np.searchsorted(words, (words[at - 1] if at else 0) + PART_WORDS, "right")))
                a, b, c, e, u, d, x, y = (v[at:to] for v in (*cuts, unit, doc[spot], low, high))
                near, wide = self._own(col, a, b, u, self.near_share[u]), self._own(col, c, e, u, self.far_share[u])
                for key, n, f, x_, y_ in zip(zip(d.tolist(), u.tolist(), strict=True), near, wide, x.tolist(), y.tolist(), strict=True):
                    if (n or f) and found.get(key, 0) < 1 and (share := self.holds(n, f, h[x_:y_], key[1])):
                        found[key] = max(share, found.get(key, 0))
                at = to
        return found


def _finder(docs: DataFrame, benchmark: DataFrame, cosine: float, share: float, weak_share: float, answer_share: float, wide_share: float, **options) -> Finder:
    return Finder(*prepared(docs, benchmark, **options), cosine, share, weak_share, answer_share, wide_share)


def leaks(docs: DataFrame, benchmark: DataFrame, cosine: float = 0.3, share: float = 0.6, weak_share: float = 0.5, answer_share: float = 0.8, wide_share: float = 0.85, **options) -> DataFrame:
    """doc_id, item_id and covered (the largest share of a unit in order) of every leak."""
    finder = _finder(docs, benchmark, cosine, share, weak_share, answer_share, wide_share, **options)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                ids, best = part.column(0).to_pylist(), {}
                for d, unit, share in finder(part.column(1)):
                    key = (d, finder.bench.items[unit])
                    best[key] = max(share, best.get(key, 0))
                rows = [(ids[d], item, share) for (d, item), share in best.items()]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.float64()))], names=["doc_id", "item_id", "covered"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, item_id long, covered double")


def clean(docs: DataFrame, benchmark: DataFrame, cosine: float = 0.3, share: float = 0.6, weak_share: float = 0.5, answer_share: float = 0.8, wide_share: float = 0.85, **options) -> DataFrame:
    """The rows of docs that hold no leak, with all their columns."""
    finder = _finder(docs, benchmark, cosine, share, weak_share, answer_share, wide_share, **options)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                keep = np.ones(part.num_rows, bool)
                keep[[d for d, _, _ in finder(part.column(at))]] = False
                yield part.filter(pa.array(keep))

    return docs.mapInArrow(run, docs.schema)
