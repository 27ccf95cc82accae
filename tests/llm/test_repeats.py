import hashlib
import random

import numpy as np
import pytest

from tessera.llm import repeats


def brute(rows, length):
    seen = {}
    data = [(d, (t or "").encode()) for d, t in rows]
    for k, (_, b) in enumerate(data):
        for i in range(len(b) - length + 1):
            seen.setdefault(b[i : i + length], []).append((k, i))
    marks = [np.zeros(len(b), bool) for _, b in data]
    for where in seen.values():
        if len(where) > 1:
            for k, i in where:
                marks[k][i : i + length] = True
    out = []
    for (d, b), m in zip(data, marks, strict=True):
        kept = bytes(np.frombuffer(b, np.uint8)[~m])
        out.append((d, len(b), int(m.sum()), len(repeats._stretches(m)[0]), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def corpus(seed, n=60):
    r = random.Random(seed)
    letters = "abcdefgé日 "
    make = lambda k: "".join(r.choice(letters) for _ in range(k))
    shared = [make(r.randint(30, 300)) for _ in range(6)]
    rows = [(1, None), (2, ""), (3, "ab" * 400), (4, "x" * 350), (5, "ab" * 30), (None, "x" * 90)]
    for i in range(n):
        text = make(r.randint(0, 200))
        for _ in range(r.randint(0, 3)):
            piece = list(r.choice(shared))
            for _ in range(r.choice([0, 0, 1, 3])):
                piece[r.randrange(len(piece))] = r.choice(letters)
            text += "".join(piece) + make(r.randint(0, 40))
        rows.append((i + 10, text))
    return rows + rows[-4:]


@pytest.mark.parametrize(("seed", "length", "index_bytes", "hot"), [(1, 60, 1 << 22, 8192), (2, 60, 2000, 2), (3, 160, 1 << 22, 1), (4, 60, 50, 8192), (5, 130, 1 << 22, 4)])
def test_equals_brute_force(spark, seed, length, index_bytes, hot):
    rows = corpus(seed)
    docs = spark.createDataFrame([(*x, 1, "k", "w") for x in rows], "doc_id long, text string, n_bytes int, anchor string, whole string").repartition(5)
    got = sorted((tuple(r) for r in repeats.removed(docs, length, index_bytes, hot).collect()), key=str)
    assert got == brute(rows, length)


def thue_morse_pair(size=2048, seed=4):
    """Two texts whose polynomial hashes modulo 2**64 are equal for any odd base, with no long string in common."""
    r = random.Random(seed)
    one, two = [], []
    for j in range(size // 2):
        odd = bin(j).count("1") % 2
        same = r.choice("cdefgh")
        one += ["ab"[odd], same]
        two += ["ba"[odd], same]
    return "".join(one), "".join(two)


def test_colliding_hashes_do_no_harm(spark):
    one, two = thue_morse_pair()
    rows = [(1, one), (2, one), (3, two), (4, one[:900] + two[900:]), (5, "y" + one[200:1000]), (6, "z" + two[200:1000])]
    docs = spark.createDataFrame(rows[:3], "doc_id long, text string").repartition(2)
    got = sorted((tuple(r) for r in repeats.removed(docs, 400).collect()), key=str)
    assert got == brute(rows[:3], 400) and got[2][2] == 0
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert sorted((tuple(r) for r in repeats.removed(docs, 400).collect()), key=str) == brute(rows, 400)


def test_a_very_long_text(spark):
    r = random.Random(2)
    long = "".join(r.choice("abcdefgh") for _ in range(5_000_000))
    rows = [(1, long), (2, "q" + long[4_194_000:4_194_700] + "q"), (3, "short")]
    got = {x.doc_id: x for x in repeats.removed(spark.createDataFrame(rows, "doc_id long, text string"), 400).collect()}
    assert [(got[i].n_removed, got[i].n_spans) for i in (1, 2, 3)] == [(700, 1), (700, 1), (0, 0)]


def test_matches_equal_brute_force():
    r = random.Random(3)
    parts = ["".join(r.choice("ab") for _ in range(r.randint(1, 60))).encode() for _ in range(12)]
    index = repeats.RunIndex(parts)
    got = index.matches(100)
    for i, p in enumerate(parts):
        for a in range(len(p)):
            best = 0
            for j, q in enumerate(parts):
                for b in range(len(q)):
                    if (i, a) != (j, b):
                        k = 0
                        while a + k < len(p) and b + k < len(q) and p[a + k] == q[b + k]:
                            k += 1
                        best = max(best, k)
            assert got[index.starts[i] + a] == best


def test_empty_table(spark):
    assert repeats.removed(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_texts_that_meet_only_across_partitions(spark):
    r = random.Random(9)
    make = lambda k: "".join(r.choice("abcdef") for _ in range(k))
    shared = make(100)
    rows = [(1, make(200)), (2, make(20) + shared + make(90)), (3, make(150)), (4, shared), (5, make(99))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5, "doc_id")
    assert sorted((tuple(x) for x in repeats.removed(docs, 60).collect()), key=str) == brute(rows, 60)
