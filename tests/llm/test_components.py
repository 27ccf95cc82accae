"""Connected components against a plain search, and how many rounds they take."""

import numpy as np
import pytest

from tessera.llm import components


def plain(edges):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a != b:
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    return {x: find(x) for x in root}


@pytest.mark.parametrize("held", [7, 1 << 18])
def test_equals_a_plain_search(spark, monkeypatch, held):
    r = np.random.default_rng(5)
    path = r.permutation(60).tolist()
    edges = [*zip(path, path[1:]), *((int(a), int(b)) for a, b in r.integers(100, 220, (70, 2))), (-5, 2**62), (2**62, -(2**62)), (300, 300), (301, 302), (302, 301), (301, 302)]
    monkeypatch.setattr(components, "HELD", held)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5")
    got = components.connected(spark.createDataFrame(edges, "x long, y long").repartition(3))
    assert sorted((x.node, x.root) for x in got.collect()) == sorted(plain(edges).items())
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert components.connected(spark.createDataFrame([(1, 1)], "x long, y long")).count() == 0


def test_few_rounds(spark, monkeypatch):
    """A path that one task holds is settled at once: it is written, and once more to see that nothing changes."""
    made, stored = [], components.stored
    monkeypatch.setattr(components, "stored", lambda *a: made.append(a) or stored(*a))
    path = np.random.default_rng(1).permutation(400).tolist()
    got = components.connected(spark.createDataFrame(list(zip(path, path[1:])), "x long, y long").coalesce(1))
    assert got.where("root = 0").count() == 400
    assert len(made) == 2
