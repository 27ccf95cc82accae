"""Every query of the array operators against its SQL, on the smallest tables."""

import os

import duckdb
import numpy as np
import pytest

from tessera.object_queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(SF):
        if f.endswith(".parquet"):
            c.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{SF}/{f}'")
    return c


def test_every_query_but_one_has_sql():
    assert set(QUERIES) - set(SQL) == {"pca"} and set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, duck, name):
    got, want = QUERIES[name](spark, SF), duck.sql(SQL[name])
    names = sorted(got.columns)
    assert names == sorted(want.columns)
    a = sorted((tuple(r[n] for n in names) for r in got.collect()), key=str)
    b = sorted((tuple(dict(zip(want.columns, r))[n] for n in names) for r in want.fetchall()), key=str)
    assert a == b and a


def test_pca(spark):
    rows = QUERIES["pca"](spark, SF).collect()
    assert len(rows) == 10 and all(x.sd >= y.sd for x, y in zip(rows, rows[1:]))


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 200
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_tcrossprod_is_over_the_whole_array(spark, duck):
    from tessera.operators import matrix as M
    from tessera.queries import ps

    n, low, parts, part = duck.sql("SELECT (SELECT count(*) FROM supplier), (SELECT min(s_suppkey) FROM supplier), count(*), min(p_partkey) FROM part").fetchall()[0]
    a = np.zeros((parts, n))
    for r, c, v in duck.sql("SELECT l_partkey, l_suppkey, sum(l_quantity) FROM lineitem GROUP BY 1, 2").fetchall():
        a[r - part, c - low] = v
    got = np.zeros((n, n))
    for r in QUERIES["tcrossprod_whole"](spark, SF).collect():
        got[r.c_a - low, r.c_b - low] = r.value
    np.testing.assert_allclose(got, a.T @ a)
    whole = M.tcrossprod(ps(spark, SF), strategy="join")
    assert whole.shape == (parts, parts)
    np.testing.assert_allclose(whole.to_numpy(), a @ a.T)
