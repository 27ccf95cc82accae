import itertools
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from tessera.llm import packing

P = pytest.importorskip("public_tokenizers")
PATH = P.path("word_bpe_49k.json")


def test_encoder_equals_the_tokenizer():
    from tokenizers import Tokenizer

    r = random.Random(2)
    bits = ["word", "Word.", "it's", "don't,", "é", "É", "ß", "日本", "x1y2", "...", "a.b", "<|endoftext|>", "\x1c", "\xa0", "İ", "ΑΣ", "é", "́", "😀", "q" * 60, ".,", "A.", "1.", "''"]
    texts = ["", " ", "\n\t"] + ["".join(r.choice(bits) + r.choice([" ", "", "\n", "  ", "\r\n", "\t"]) for _ in range(r.randint(1, 30))) for _ in range(400)]
    want = [np.asarray(e.ids, "<u4").tobytes() for e in Tokenizer.from_file(PATH).encode_batch(texts, add_special_tokens=False)]
    encode = packing.Encoder(PATH)
    assert list(encode(texts)) == want and list(encode(texts)) == want and list(encode([None, "word"]))[0] == b""


def test_other_tokenizers_get_whole_texts():
    from tokenizers import Tokenizer

    path = P.path("byte_bpe_50k.json")
    texts = ["Two  words.", "", " Leading, and\nlines ", "ÄÖ x1 <|endoftext|>"]
    encode = packing.Encoder(path)
    assert packing.Encoder(PATH).by_chunk and not encode.by_chunk
    want = [np.asarray(e.ids, "<u4").tobytes() for e in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]
    assert list(encode([*texts, None])) == [*want, b""]


def test_fullest_equals_brute_force():
    r = random.Random(3)
    for _ in range(200):
        counts = {r.randint(1, 30): r.randint(1, 3) for _ in range(r.randint(1, 5))}
        room = r.randint(0, 70)
        lengths = sorted(counts, reverse=True)
        used = packing.fullest(lengths, counts, room)
        best = max(s for k in itertools.product(*(range(counts[n] + 1) for n in lengths)) if (s := sum(a * n for a, n in zip(k, lengths))) <= room)
        assert sum(n * k for n, k in used.items()) == best and all(k <= counts[n] for n, k in used.items())


def test_patterns_use_up_the_histogram():
    r = random.Random(4)
    histogram = defaultdict(int)
    for _ in range(3000):
        histogram[min(512, int(r.lognormvariate(4, 1)) + 1)] += 1
    seen, at = defaultdict(int), 0
    for first, times, used in packing.minimum_slack(histogram, 512):
        assert first == at and sum(n * k for n, k in used.items()) <= 512
        at += times
        for n, k in used.items():
            seen[n] += k * times
    assert seen == histogram and at <= -(-sum(n * k for n, k in histogram.items()) // 512) + 1


def test_sequences(spark):
    r = random.Random(5)
    rows = [(i, None if i % 50 == 0 else " ".join(r.choice(["cat", "violin", "the", "of,"]) for _ in range(r.choice([0, 1, 3, 30, 200, 900])))) for i in range(300)]
    rows += [rows[3]] * 40 + [(None, "no id")]
    docs = spark.createDataFrame([(*x, 1) for x in rows], "doc_id long, text string, length int").repartition(3)
    out = packing.packed(docs, PATH, capacity=256, rank_rows=50).collect()
    encode = packing.Encoder(PATH)
    want = defaultdict(list)
    for (d, _), ids in zip(rows, encode([t for _, t in rows]), strict=True):
        ids += b"\x02\0\0\0"
        for a in range(0, len(ids) // 4, 256):
            piece = ids[4 * a : 4 * a + 1024]
            want[d].append((a, len(piece) // 4, zlib.crc32(piece), len(ids) // 4))
    got, sequences = defaultdict(list), defaultdict(list)
    for x in out:
        got[x.doc_id].append((x.start, x.length, x.ids_crc32, x.doc_tokens))
        sequences[x.sequence_id].append((x.offset, x.length))
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 256
    total = sum(x.length for x in out)
    assert sorted(sequences) == list(range(len(sequences))) and len(sequences) * 256 - total < 256 * 2 + total // 50
    assert packing.packed(docs.where("false"), PATH).count() == 0
