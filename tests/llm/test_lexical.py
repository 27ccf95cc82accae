import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tessera.llm import lexical
from tessera.llm.common import Words

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall((text or "").translate(LOW))


def brute(docs, items, k):
    counted = [(i, Counter(terms(t))) for i, t in docs if terms(t)]
    n, length = len(counted), sum(sum(c.values()) for _, c in counted)
    df = Counter(w for _, c in counted for w in c)
    out = []
    for item, text in dict.fromkeys(items):
        scores = []
        for doc, c in counted:
            m = 100 - 90 + (90 * sum(c.values()) * n) // length
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1))) * ((1_000_000_000 * c[w]) // (1000 * c[w] + 8 * m)) for w in set(terms(text)) if w in c)
            if s > 0:
                scores.append((-s, doc is None, doc))
        out += [(item, rank, doc, -s) for rank, (s, _, doc) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=str)


def run(spark, docs, items, k=3, **options):
    d = spark.createDataFrame([(*r, 1, "x") for r in docs], "doc_id long, text string, rank int, row string").repartition(3)
    q = spark.createDataFrame([(*r, 1) for r in items], "item_id long, text string, score int")
    out = lexical.search(d, q, k, **options)
    assert out.columns == ["item_id", "rank", "doc_id", "score"]
    return sorted((tuple(r) for r in out.collect()), key=str)


@pytest.fixture(scope="module")
def corpus():
    r = random.Random(2)
    words = [f"w{i}" for i in range(60)] + ["Été", "ÉTÉ", "naïve", "数据", "Straße", "K", "don", "T"]
    weights = [1 / (1 + i) for i in range(len(words))]
    docs = [(i, r.choice([" ", "-", ", ", "\x00"]).join(r.choices(words, weights, k=r.choice([1, 3, 20, 200])))) for i in range(300)]
    docs += [(300, None), (301, ""), (302, "... --"), (None, docs[5][1]), (303, docs[5][1]), (304, docs[5][1]), (7, "W1 w1 w2"), (7, "w2")]
    items = [(i, " ".join(r.choices(words, k=r.choice([1, 4, 30])))) for i in range(25)] + [(90, None), (91, "?!"), (92, "nowhere"), (1, "w3 w4"), (2, docs[9][1]), (2, docs[9][1])]
    return docs, items


@pytest.mark.parametrize("options", [{}, {"block_terms": 60}, {"k": 400}])
def test_equals_brute_force(spark, corpus, options):
    docs, items = corpus
    assert run(spark, docs, items, **options) == brute(docs, items, options.get("k", 3))


def test_items_stop_at_the_first_tier_that_proves_them(spark, monkeypatch):
    """A rare word repeated in short documents is settled by high impacts; an item of common words goes down."""
    docs = [(i, "common filler words here " * 5) for i in range(400)] + [(1000 + i, "zebra " * 5) for i in range(4)] + [(2000 + i, "filler zebra okapi") for i in range(3)]
    items = [(1, "zebra"), (2, "common filler words here")]
    tiers = []
    finished = lexical._finished
    monkeypatch.setattr(lexical, "_finished", lambda first, last, asked, kind: tiers.append((first, sorted(set(asked.value.items.tolist())))) or finished(first, last, asked, kind))
    assert run(spark, docs, items) == brute(docs, items, 3)
    assert [len(i) for _, i in tiers] == [1, 1] and tiers[0][0] < tiers[1][0]


def test_empty_tables(spark):
    assert run(spark, [], [(1, "a")]) == [] and run(spark, [(1, "a")], []) == [] and run(spark, [(1, None)], [(1, "a")]) == []


def test_long_text_and_one_document(spark):
    docs = [(1, "a " * 400_000 + "b"), (2, "a"), (3, "c")]
    assert run(spark, docs, [(1, "A b")]) == brute(docs, [(1, "A b")], 3)


def test_terms_that_share_a_hash_are_told_apart(monkeypatch):
    monkeypatch.setattr(Words, "hashes", property(lambda self: np.zeros(len(self.starts), np.uint64)))
    v = lexical.Vocabulary(["ab", "cd", "abc"])
    assert v.longest == 3 and v.find(Words(pa.array(["ab x cd", "ABC cde"]), space=lexical.PARTING)).tolist() == [0, -1, 1, 2, -1]


def test_string_ids(spark):
    d = spark.createDataFrame([("b", "x y"), ("a", "x y"), (None, "x y")], "name string, body string")
    q = spark.createDataFrame([("q", "x")], "item string, words string")
    got = lexical.search(d, q, 3, "name", "body", "item", "words").orderBy("rank").collect()
    assert [(r["item"], r["rank"], r["name"]) for r in got] == [("q", 1, "a"), ("q", 2, "b"), ("q", 3, None)]
