import random
import re

import numpy as np
import pytest

from tessera.llm import ngram_join


def brute(rows, size, percent):
    sets = {}
    for doc, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets[doc] = {tuple(words[i : i + size]) for i in range(len(words) - size + 1)} if len(words) >= size else ({tuple(words)} if words else set())
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), find(d)) for d in ids}


def corpus(seed, n=160):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(300)]
    line = [r.choice(words) for _ in range(12)]
    base = [[r.choice(words) for _ in range(r.randint(5, 90))] for _ in range(12)]
    rows = [(0, None), (1, ""), (2, "  \n\t "), (3, "One"), (4, "one"), (5, "one two"), (6, "ONE  two\x0b")]
    for i in range(7, n):
        words_i = list(r.choice(base))
        for _ in range(r.choice([0, 0, 1, 1, 2, 3])):
            words_i[r.randrange(len(words_i))] = r.choice(words)
        if r.random() < 0.3:
            words_i += line
        rows.append((i, " ".join(words_i)))
    return rows


@pytest.mark.parametrize(("seed", "size", "percent", "block"), [(1, 3, 90, 10**6), (2, 3, 90, 300), (3, 5, 80, 10**6), (4, 5, 80, 200), (5, 3, 60, 100)])
def test_components_equal_brute_force(spark, seed, size, percent, block):
    rows = corpus(seed)
    docs = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, class int").repartition(5)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.near_components(docs, size, percent, block=block).collect()}
    assert got == brute(rows, size, percent)


def test_empty_table_and_null_ids(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert ngram_join.near_components(docs).count() == 0
    docs = spark.createDataFrame([(None, "a b c"), (4, "a b c"), (7, "a b c"), (7, "a b c")], "doc_id long, text string")
    got = sorted(((r["doc_id"], r["component_id"]) for r in ngram_join.near_components(docs, 3, 90).collect()), key=str)
    assert [c for d, c in got if d is not None] == [4, 4, 4]


def test_search_equals_set_arithmetic():
    r = np.random.default_rng(0)
    sets = [np.unique(r.integers(0, 60, r.integers(1, 40))) for _ in range(120)]
    index = ngram_join.Index(sets, 50)
    for q in sets:
        want = [j for j, s in enumerate(sets) if 100 * len(np.intersect1d(q, s)) >= 50 * len(np.union1d(q, s))]
        assert list(index.search(q, np.ones(len(sets), bool))) == want


def test_lists_that_span_batches_lose_no_pair():
    import pyarrow as pa

    rows = sorted([(t, 20 + c % 3, c) for t in range(6) for c in range(t * 7)] + [(9, 5, c) for c in (1, 1, 2)])

    def result(size):
        table = pa.table({"token": [r[0] for r in rows], "class": [r[2] for r in rows], "n": [r[1] for r in rows]})
        got = {}
        for b in ngram_join._neighbours(90)(iter(table.to_batches(max_chunksize=size))):
            for x in b.to_pylist():
                key = (x["a"], x["b"])
                got[key] = got.get(key, 0) + x["shared"]
        return got

    whole = result(10**6)
    assert all(whole.get((a, a + 3), 0) >= 2 for a in range(4))
    for size in (1, 2, 5, 30):
        part = result(size)
        assert {k for k, v in part.items() if v >= 2} == {k for k, v in whole.items() if v >= 2}
