"""Queries of arrays as objects: shapes, labels, local forms, types on disk and refusals, with their SQL.

Importing this module adds them to those of `queries`.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import matrix as M
from .operators.array import CoordArray
from .operators.realize import block_cells, block_totals
from .operators.workflows import normalize, pca
from .queries import _TOP, CUSTOMERS, ORD, PRIORITIES, QUERIES, SQL, STATUSES, X, _path, _tiles, add, ord3, ps, rounded
from .sources.writer import side_info, write_coo

__all__ = ["QUERIES", "SQL"]

EDGES = """r AS (SELECT min(p_partkey) AS lo, max(p_partkey) AS hi FROM part), c AS (SELECT min(s_suppkey) AS lo, max(s_suppkey) AS hi FROM supplier),
    k AS (SELECT min(c_custkey) AS lo, max(c_custkey) AS hi FROM customer), one AS (SELECT 1 AS lo)"""


# shapes and labels
def _views(s: SparkSession, d: str) -> dict[str, CoordArray]:
    x, y = ps(s, d), ord3(s, d)
    return {"whole": x, "turned": x.T, "part": x[10:60, [0, 3, 7]], "column": x[:, 0], "cube": y, "permuted": y.aperm((2, 0, 1)), "face": y[:, "1-URGENT", :], "shifted": x + 7, "over 40": x > 40}


def _shapes(s: SparkSession, d: str) -> DataFrame:
    rows = [(name, i, n, str(v.dimnames[i][0]), str(v.dimnames[i][-1])) for name, v in _views(s, d).items() for i, n in enumerate(v.shape)]
    return s.createDataFrame(rows, "view string, axis int, extent long, low string, high string")


_R, _C, _K = (("r", "hi - lo + 1", "lo", "hi"), ("c", "hi - lo + 1", "lo", "hi"), ("k", "hi - lo + 1", "lo", "hi"))
_P, _S = ("one", "5", "'1-URGENT'", "'5-LOW'"), ("one", "3", "'F'", "'P'")
_AXES = {
    "whole": (_R, _C),
    "turned": (_C, _R),
    "part": (("r", "50", "lo + 10", "lo + 59"), ("c", "3", "lo", "lo + 7")),
    "column": (_R,),
    "cube": (_K, _P, _S),
    "permuted": (_S, _K, _P),
    "face": (_K, _S),
    "shifted": (_R, _C),
    "over 40": (_R, _C),
}
add(
    "shapes_labels",
    _shapes,
    f"WITH {EDGES} "
    + " UNION ALL ".join(
        f"SELECT '{view}' AS view, CAST({i} AS INT) AS axis, CAST({extent} AS BIGINT) AS extent, CAST({low} AS VARCHAR) AS low, CAST({high} AS VARCHAR) AS high FROM {source}"
        for view, axes in _AXES.items()
        for i, (source, extent, low, high) in enumerate(axes)
    ),
)


def _shown(s: SparkSession, d: str) -> DataFrame:
    return s.createDataFrame([(name, repr(v), v.is_sparse, v.zero_filled) for name, v in _views(s, d).items()], "view string, shown string, sparse boolean, zero_filled boolean")


_TYPES = {"cube": "integer64", "permuted": "integer64", "face": "integer64", "over 40": "logical"}
_EXTENTS = {"r": "(SELECT hi - lo + 1 FROM r)", "c": "(SELECT hi - lo + 1 FROM c)", "k": "(SELECT hi - lo + 1 FROM k)"}


def _show_sql(view: str) -> str:
    axes = [_EXTENTS[source] if extent == "hi - lo + 1" else extent for source, extent, _, _ in _AXES[view]]
    shape, kind = " || ' x ' || ".join(axes), "CoordMatrix" if len(axes) == 2 and view != "face" else "CoordArray"
    return f"""SELECT '{view}' AS view, '<' || {shape} || '> sparse {kind} object of type "{_TYPES.get(view, 'double')}"' AS shown, true AS sparse, {str(view != 'shifted').lower()} AS zero_filled"""


add("shown", _shown, f"WITH {EDGES} " + " UNION ALL ".join(_show_sql(v) for v in _AXES))


def _accessors(s: SparkSession, d: str) -> DataFrame:
    """The table behind a subset, with and without its choice of columns and of rows."""
    x = ps(s, d)
    x = CoordArray.from_coo(x.df.withColumn("note", F.lit("n")), "v", {q.name: q for q in x.dims})[10:60, :]
    tables = {(a, b): x.to_df(select=a, filter=b) for a in (True, False) for b in (True, False)}
    each = [t.agg(F.count(F.lit(1)).alias("n")).select(F.lit(a).alias("chosen_columns"), F.lit(b).alias("chosen_rows"), F.lit(" ".join(t.columns)).alias("names"), "n") for (a, b), t in tables.items()]
    return reduce(DataFrame.unionByName, each)


add(
    "accessors",
    _accessors,
    f"""WITH {X}, {EDGES}, n AS (SELECT count(*) AS whole, count(*) FILTER (WHERE x.r >= lo + 10 AND x.r < lo + 60) AS part FROM x CROSS JOIN r)
    SELECT a AS chosen_columns, b AS chosen_rows, CASE WHEN a THEN 'r c value' ELSE 'r c v note' END AS names, CASE WHEN b THEN part ELSE whole END AS n
    FROM n CROSS JOIN (SELECT unnest([true, false]) AS a) CROSS JOIN (SELECT unnest([true, false]) AS b)""",
)
add(
    "many_levels",
    lambda s, d: rounded((x := ps(s, d))[[i for i in range(len(x.dims[0])) if i % 3], :].rows()),
    f"WITH {X}, {EDGES} SELECT x.r, x.c, round(v, 6) AS value FROM x CROSS JOIN (SELECT lo AS r0 FROM r) WHERE (x.r - r0) % 3 <> 0",
)


# local forms
_PLACED = f"""WITH {ORD}, m AS (SELECT min(c_custkey) AS k0 FROM customer),
    g AS (SELECT k, p, s, k - k0 AS p0, CAST(left(p, 1) AS BIGINT) - 1 AS p1, CAST(CASE s WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 2 END AS BIGINT) AS p2
          FROM ({CUSTOMERS}) CROSS JOIN ({PRIORITIES}) CROSS JOIN ({STATUSES}) CROSS JOIN m)"""


#: Blocks in which local forms are made: at most four million cells.
_LONG, _ACROSS = 1 << 17, 32


def _local(s: SparkSession, x: CoordArray, form: str) -> DataFrame:
    """A local form, made of blocks that are long in the first dimension."""
    rest = [min(len(q), _ACROSS) for q in x.dims[1:]]
    return rounded(block_cells(x, (max(1, min(len(x.dims[0]), _LONG)), *rest), form))


def _local_blocks(s: SparkSession, d: str) -> DataFrame:
    x = ps(s, d) + 1
    return rounded(block_totals(x, _tiles(x, 3, 2)), "total")


add("local_coo", lambda s, d: _local(s, ord3(s, d), "coo"), f"{_PLACED} SELECT p0, p1, p2, CAST(v AS DOUBLE) AS value FROM g JOIN x USING (k, p, s)")
add("local_dense", lambda s, d: _local(s, ord3(s, d) + 1, "dense"), f"{_PLACED} SELECT p0, p1, p2, CAST(coalesce(v, 0) + 1 AS DOUBLE) AS value FROM g LEFT JOIN x USING (k, p, s)")
add("local_csc", lambda s, d: _local(s, ps(s, d), "csc"), f"WITH {X}, {EDGES} SELECT x.r - r0 AS p0, x.c - c0 AS p1, round(v, 6) AS value FROM x CROSS JOIN (SELECT lo AS r0 FROM r) CROSS JOIN (SELECT lo AS c0 FROM c)")
add(
    "local_blocks",
    _local_blocks,
    f"""WITH {X}, {EDGES}, m AS (SELECT r.lo AS r0, c.lo AS c0, r.hi - r.lo + 1 AS nr, c.hi - c.lo + 1 AS nc FROM r CROSS JOIN c),
    g AS (SELECT *, i * tr AS p0, j * tc AS p1 FROM (SELECT *, (nr + 2) // 3 AS tr, (nc + 1) // 2 AS tc FROM m), unnest([0, 1, 2]) AS a(i), unnest([0, 1]) AS b(j))
    SELECT p0, p1, least(tr, nr - p0) * least(tc, nc - p1) AS cells, CAST(coalesce(t, 0) + least(tr, nr - p0) * least(tc, nc - p1) AS DOUBLE) AS total
    FROM g LEFT JOIN (SELECT (x.r - r0) // ((nr + 2) // 3) AS i, (x.c - c0) // ((nc + 1) // 2) AS j, sum(v) AS t FROM x CROSS JOIN m GROUP BY 1, 2) USING (i, j)""",
)


# types on disk
def _disk_types(s: SparkSession, d: str) -> DataFrame:
    out, x = [], ps(s, d)
    for name, y in (("whole", x), ("divided", x / 7)):
        write_coo(y, path := _path(s, name), ["i", "j"])
        out += [(name, f["name"], f["type"]) for f in side_info(s, path)["schema"]["fields"]]
    return s.createDataFrame(out, "held string, field string, kind string")


def _narrowest(n: str) -> str:
    return f"CASE WHEN {n} <= 127 THEN 'byte' WHEN {n} <= 32767 THEN 'short' WHEN {n} <= 2147483647 THEN 'integer' ELSE 'long' END"


add(
    "disk_types",
    _disk_types,
    f"""WITH {X}, {EDGES}, e AS (SELECT 'i' AS field, {_narrowest('hi - lo + 1')} AS kind FROM r UNION ALL SELECT 'j', {_narrowest('hi - lo + 1')} FROM c)
    SELECT held, field, kind FROM e CROSS JOIN (SELECT unnest(['whole', 'divided']) AS held) UNION ALL
    SELECT 'whole', 'value', {_narrowest('max(v)')} FROM x UNION ALL SELECT 'divided', 'value', CASE WHEN bool_and(v % 7 = 0) THEN {_narrowest('max(v / 7)')} ELSE 'double' END FROM x""",
)


# refusals
def _refused(attempt: Callable[[], object]) -> str:
    """The kind of error that an attempt raises; empty if it raises none."""
    try:
        attempt()
    except (TypeError, ValueError, IndexError, KeyError, NotImplementedError) as e:
        return type(e).__name__
    return ""


def _gram_guard(s: SparkSession, d: str) -> DataFrame:
    """A join is refused at one pair less than it makes, and not at as many."""
    x = ps(s, d)
    pairs = int(x.row_nnzs(complete=False).agg(F.sum(F.col("value").cast("long") * F.col("value").cast("long"))).first()[0])
    return s.createDataFrame([(n, _refused(lambda n=n: M.gram(x, "row", "join", limit=n))) for n in (pairs - 1, pairs)], "pairs long, refused string")


add("gram_guard", _gram_guard, f"WITH {X}, n AS (SELECT CAST(sum(n * n) AS BIGINT) AS n FROM (SELECT count(*) AS n FROM x GROUP BY r)) SELECT n - 1 AS pairs, 'ValueError' AS refused FROM n UNION ALL SELECT n, '' FROM n")

_MATHS = {"NotImplementedError": ("cummax", "cummin", "cumprod", "cumsum", "cospi", "sinpi", "tanpi", "digamma", "trigamma"), "": ("abs", "exp", "gamma", "lgamma", "log", "sqrt")}


def _validity(s: SparkSession, d: str) -> DataFrame:
    x, y, words = ps(s, d), ord3(s, d), s.createDataFrame([(1, "a")], "i long, v string")
    n, text = len(x.dims[0]), CoordArray.from_coo(words, "v", {"i": [1]})
    attempts = {
        "last row": lambda: x[n - 1, :],
        "row after the last": lambda: x[n, :],
        "row before the first": lambda: x[-n - 1, :],
        "a subscript for each dimension": lambda: y[0, 0, 0],
        "a subscript too few": lambda: y[0, 0],
        "a label": lambda: y[:, "5-LOW", :],
        "no such label": lambda: y[:, "6-NONE", :],
        "a logical too few": lambda: y[:, [True] * 4, :],
        "labels": lambda: y.with_dimnames({"p": list("abcde")}),
        "a label too few": lambda: y.with_dimnames({"p": list("abcd")}),
        "no such dimension": lambda: y.dim("q"),
        "no dimension": lambda: CoordArray.from_coo(x.df, "v", []),
        "no such type": lambda: x.astype("complex"),
        "a type": lambda: x.astype("logical"),
        "a matrix of three dimensions": lambda: y.as_matrix(),
        "transposed cube": lambda: y.T,
        "arrays of one table": lambda: x + x,
        "arrays of two tables": lambda: x + y,
        "arithmetic of words": lambda: text + 1,
        "mathematics of words": lambda: text.math("sqrt"),
        "no permutation": lambda: y.aperm((0, 0, 1)),
        **{f"function {f}": lambda f=f: x.math(f) for names in _MATHS.values() for f in names},
    }
    return s.createDataFrame([(name, _refused(a)) for name, a in attempts.items()], "attempt string, refused string")


_REFUSED = {
    "": ("last row", "a subscript for each dimension", "a label", "labels", "a type", "arrays of one table"),
    "IndexError": ("row after the last", "row before the first", "a subscript too few", "no such label", "a logical too few"),
    "KeyError": ("no such dimension",),
    "TypeError": ("arithmetic of words", "mathematics of words"),
    "ValueError": ("a label too few", "no dimension", "no such type", "a matrix of three dimensions", "transposed cube", "arrays of two tables", "no permutation"),
}


def _values_sql(kinds: dict[str, tuple[str, ...]]) -> str:
    return "SELECT * FROM (VALUES " + ", ".join(f"('{name}', '{kind}')" for kind, names in kinds.items() for name in names) + ") AS t(attempt, refused)"


add("validity", _validity, _values_sql(_REFUSED) + " UNION ALL " + _values_sql({kind: tuple(f"function {f}" for f in names) for kind, names in _MATHS.items()}))


def _write_refusals(s: SparkSession, d: str) -> DataFrame:
    """What the writer refuses before it writes anything; the attempts run in this order on one folder."""
    x, path = ps(s, d), _path(s, "slabs")
    half, top = len(x.dims[1]) // 2, [len(q) for q in x.dims]
    left, right, tall = x[:, :half], x[:, half:], max(1, top[0] // 4)
    write = lambda a, to=path, index=("i", "j"), **options: write_coo(a, to, list(index), **options)
    slab = {"grid": (tall, half), "append": True, "along": "j", "offset": half}
    attempts = {
        "a new folder": lambda: write(left, grid=(tall, half), max_dim=top),
        "a folder that exists": lambda: write(left, grid=(tall, half)),
        "a fill that is not zero": lambda: write(x + 7, _path(s, "none")),
        "a name too few": lambda: write(x, _path(s, "none"), ("i",)),
        "a grid of nothing": lambda: write(x, _path(s, "none"), grid=(0, 1)),
        "extents too small": lambda: write(x, _path(s, "none"), max_dim=[1, 1]),
        "a slab of no folder": lambda: write(right, _path(s, "none"), **slab, group_offset=1),
        "a slab along nothing": lambda: write(right, grid=(tall, half), append=True, offset=half),
        "a slab before the start": lambda: write(right, **{**slab, "offset": -1}, group_offset=1),
        "a slab of other fields": lambda: write(right, index=("i", "m"), **{**slab, "along": "m"}, group_offset=1),
        "a slab of wider values": lambda: write(right / 7, **slab, group_offset=1),
        "a slab over another": lambda: write(right, **slab, group_offset=0),
        "a slab": lambda: write(right, **slab, group_offset=1),
        "the slab again": lambda: write(right, **slab, group_offset=1),
    }
    return s.createDataFrame([(name, _refused(a)) for name, a in attempts.items()], "attempt string, refused string")


_UNWRITTEN = ("a folder that exists", "a fill that is not zero", "a name too few", "a grid of nothing", "extents too small", "a slab of no folder", "a slab along nothing", "a slab before the start", "a slab of other fields", "a slab of wider values", "a slab over another", "the slab again")
add("write_refusals", _write_refusals, _values_sql({"": ("a new folder", "a slab"), "ValueError": _UNWRITTEN}))


# all components together: their variances sum to the trace of the covariances, the squares of these to the sum of squared covariances
def _pca_moments(s: SparkSession, d: str) -> DataFrame:
    deviations, _ = pca(normalize(ps(s, d), _TOP), _TOP)
    return rounded(s.createDataFrame([(float((deviations**2).sum()), float((deviations**4).sum()))], "variance double, squares double"), "variance", "squares", digits=4)


add(
    "pca_moments",
    _pca_moments,
    f"""WITH y AS ({SQL['normalize_hvg'].replace('round(v / q, 4)', 'v / q')}), k AS (SELECT CAST(count(*) AS DOUBLE) AS K FROM supplier),
    m AS (SELECT r, sum(value) / max(K) AS m FROM y CROSS JOIN k GROUP BY r), g AS (SELECT a.r AS ra, b.r AS rb, sum(a.value * b.value) AS g FROM y a JOIN y b USING (c) GROUP BY 1, 2),
    cv AS (SELECT a.r AS one, b.r AS two, (coalesce(g, 0) - K * a.m * b.m) / (K - 1) AS cv FROM m a CROSS JOIN m b CROSS JOIN k LEFT JOIN g ON ra = a.r AND rb = b.r)
    SELECT round(sum(cv) FILTER (WHERE one = two), 4) AS variance, round(sum(cv * cv), 4) AS squares FROM cv""",
)
