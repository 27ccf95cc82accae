"""Token counts under a unigram vocabulary, without making tokens.

An Aho-Corasick automaton finds every vocabulary entry that ends at each character;
a dynamic programme carries the best score and its number of pieces. Ties follow the
tokenizers library's Unigram model: among equal scores the entry that starts first
stays. A character that no entry covers alone costs ten below the least score and
counts as its bytes when the vocabulary has them, else as one.

A piece can hold the word mark only at its front, so a text's count is the sum over
its words; each distinct word is counted once per task while it stays in a bounded
cache. Null and empty texts have 0 tokens. Repeated rows are counted each, empty tables
give empty results, texts of any length are read whole, and only doc_id and text are
read, so other columns may have any name.

The vocabulary the query is given is of a BPE model, whose scores (minus the rank of a
merge) are read as a unigram model's: the counts are those of a Unigram tokenizer with
these pieces and scores, not of that BPE tokenizer.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import small_batches

MARK = "▁"
CACHED = 400_000
CACHED_CHARS = 64


def vocabulary(path: str) -> list[tuple[str, float]]:
    """Entries and scores of a sentencepiece model file; only the file is read, nothing is trained."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    return [(sp.id_to_piece(i), sp.get_score(i)) for i in range(sp.get_piece_size())]


class Counter:
    """Counts of texts under Unigram(vocabulary, byte_fallback=True) after marking and splitting at spaces."""

    def __init__(self, vocab: list[tuple[str, float]]):
        import ahocorasick

        self.find = ahocorasick.Automaton()
        for piece, score in vocab:
            if piece:
                self.find.add_word(piece, (len(piece), score))
        self.find.make_automaton()
        self.unknown = min(s for _, s in vocab) - 10.0
        entries = {p for p, _ in vocab}
        self.bytes = all(f"<0x{b:02X}>" in entries for b in range(256))
        self.lines = self.bytes and not any("\n" in p for p in entries)
        self.known: dict[str, int] = {}

    def word(self, text: str) -> int:
        """The number of pieces of the best split of a text that holds no mark but at its front."""
        n = len(text)
        best, count, fused = [-math.inf] * (n + 1), [0] * (n + 1), [False] * (n + 1)
        best[0] = 0.0
        done = 0  # ends up to here have all their candidates

        def unknown(end: int) -> None:
            # the unknown character is tried last at its end, and only if no entry covers it alone
            if not single[end] and (s := best[end - 1] + self.unknown) > best[end]:
                best[end] = s
                if self.bytes:
                    count[end] = count[end - 1] + len(text[end - 1].encode())
                else:
                    count[end] = count[end - 1] + (not fused[end - 1])
                    fused[end] = True

        single = [False] * (n + 1)
        for last, (size, score) in self.find.iter(text):
            end = last + 1
            while done < end - 1:
                done += 1
                unknown(done)
            if size == 1:
                single[end] = True
            if (s := best[end - size] + score) > best[end]:
                best[end], count[end], fused[end] = s, count[end - size] + 1, False
        while done < n:
            done += 1
            unknown(done)
        return count[n]

    def __call__(self, texts: list[str | None]) -> list[int]:
        if len(self.known) > CACHED:
            self.known = {}
        known = self.known
        # where a line break is in no piece but its own byte, what follows it is counted apart, without a mark
        line = " \n" if self.lines else "\n"
        split = [(t[1:] if t[0] in (" ", MARK) else t).replace(MARK, " ").replace("\n", line).split(" ") if t else [] for t in texts]
        new = set().union(*split).difference(known)
        for c in new:
            known[c] = self.word(c if self.lines and c[:1] == "\n" else MARK + c)
        out = [sum([known[c] for c in chunks]) for chunks in split]
        for c in new:
            if len(c) > CACHED_CHARS:
                del known[c]
        return out


@functools.cache
def counter(path: str) -> Counter:
    """One per worker process, so that tasks share what is known."""
    return Counter(vocabulary(path))


def token_counts(docs: DataFrame, vocabulary_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and n_tokens of every whole text."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(vocabulary_path)
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(count(part.column(1).to_pylist()), pa.int64())], names=["doc_id", "n_tokens"])

    return docs.selectExpr(f"`{id_col}` AS doc_id", f"`{text_col}` AS text").mapInArrow(run, "doc_id long, n_tokens long")
