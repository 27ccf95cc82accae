import math

import numpy as np
import pytest

from tessera.llm import forest


def brute(rows, t):
    scaled = lambda v: np.array(v, float) / max(map(abs, v))
    good = [(i, scaled(v)) if v and all(c is not None and math.isfinite(c) for c in v) and any(v) else (i, None) for i, v in rows]
    links, label = [0] * len(rows), list(range(len(rows)))

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for a, (_, u) in enumerate(good):
        for b in range(a):
            v = good[b][1]
            if u is not None and v is not None and len(u) == len(v) and u @ v / (math.sqrt(u @ u) * math.sqrt(v @ v)) >= t:
                links[a] += 1
                links[b] += 1
                label[root(a)] = root(b)
    least = {}
    for a, (i, _) in enumerate(rows):
        r = root(a)
        least[r] = i if least.get(r) is None else least[r] if i is None else min(i, least[r])
    return sorted(((i, links[a], least[root(a)], i == least[root(a)]) for a, (i, _) in enumerate(rows)), key=str)


def run(spark, rows, **options):
    df = spark.createDataFrame([(*r, 3, "x") for r in rows], "vec_id long, embedding array<double>, label int, rep string").repartition(3)
    out = forest.near_vectors(df, **options)
    assert out.columns == ["vec_id", "n_links", "component_id", "kept"]
    return sorted((tuple(r) for r in out.collect()), key=str)


def cluster(r, centre, n, spread):
    return centre + spread * r.normal(size=(n, len(centre))) / math.sqrt(len(centre))


@pytest.fixture(scope="module")
def rows():
    r = np.random.default_rng(1)
    x = r.normal(size=(500, 16))
    parts = [x, cluster(r, x[0] / np.linalg.norm(x[0]), 150, 0.08), cluster(r, x[1] / np.linalg.norm(x[1]), 60, 0.3), cluster(r, x[2] / np.linalg.norm(x[2]), 40, 0.22), x[3:20] * 7, x[20:25]]
    x = np.concatenate(parts).round(4)
    bad = [(5000, None), (5001, [0.0] * 16), (5002, [None] + [1.0] * 15), (5003, [math.nan] * 16), (5004, [math.inf] * 16), (5005, []), (None, [1.0, 2.0]), (5006, [2.0, 4.0]), (5007, [1e200, 2e200]), (5008, [-1.0, 2.0])]
    return [(i, v.tolist()) for i, v in enumerate(x)] + bad + [(3, x[3].tolist()), (3, x[3].tolist()), (None, x[3].tolist()), (None, [5.0] * 3)]


@pytest.mark.parametrize("options", [{}, {"leaf_rows": 24, "trees": 10}])
def test_equals_brute_force(spark, rows, options):
    got, want = run(spark, rows, **options), brute(rows, 0.95)
    assert got == want


def test_large_balls_and_what_lies_about_them(spark):
    """Two overlapping tight groups fill most of the table; their rims and strangers link as well."""
    r = np.random.default_rng(2)
    a = np.zeros(16)
    a[0] = 1
    b = np.zeros(16)
    b[:2] = math.cos(0.4), math.sin(0.4)
    x = np.concatenate([cluster(r, a, 400, 0.1), cluster(r, b, 300, 0.1), cluster(r, a, 60, 0.35), r.normal(size=(60, 16))])
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    assert run(spark, rows, leaf_rows=64) == brute(rows, 0.95)


def test_leaves_that_cannot_be_parted_are_compared_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(forest, "BALL_LEAST", 10**9)
    r = np.random.default_rng(3)
    a = np.zeros(12)
    a[0] = 1
    rows = [(i, v.tolist()) for i, v in enumerate(np.concatenate([cluster(r, a, 260, 0.2), r.normal(size=(40, 12))]))]
    assert run(spark, rows, leaf_rows=32) == brute(rows, 0.95)


def test_rounds_after_the_first_sample(spark, monkeypatch):
    monkeypatch.setattr(forest, "SAMPLE_BYTES", 0)
    r = np.random.default_rng(4)
    x = r.normal(size=(3000, 8))
    x[2000:] = x[:1000] + 0.01 * r.normal(size=(1000, 8))
    u = x / np.linalg.norm(x, axis=1)[:, None]
    want = ((u @ u.T) >= 0.95).sum(axis=1) - 1
    got = run(spark, [(i, v.tolist()) for i, v in enumerate(x)], leaf_rows=24, trees=8)
    found = {i: n for i, n, _, _ in got}
    assert all(found[i] <= want[i] for i in found) and sum(found.values()) >= 0.99 * want.sum()


def test_many_equal_vectors(spark):
    rows = [(i, [1.0, 2.0, 3.0]) for i in range(1500)] + [(2000, [1.0, 2.0, 3.1]), (2001, [-1.0, 0.0, 0.0]), (2002, [-1.0, 0.0, 0.0])]
    got = {i: x for i, *x in run(spark, rows)}
    assert got[0] == [1500, 0, True] and got[7] == [1500, 0, False] and got[2000] == [1500, 0, False] and got[2001] == [1, 2001, True] and got[2002] == [1, 2001, False]


def test_empty_table(spark):
    assert run(spark, []) == [] and run(spark, [(1, None)]) == [(1, 0, 1, True)]


def test_float_vectors_and_other_thresholds(spark):
    r = np.random.default_rng(5)
    x = r.normal(size=(120, 6)).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, e array<float>")
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(x)]
    assert sorted((tuple(r) for r in forest.near_vectors(df, 0.7, id_col="id", vector_col="e").collect()), key=str) == brute(rows, 0.7)
