"""Repair of conversation structure at least cost, by a rank-compressed dynamic program.

A conversation's turns are kept, given another role or deleted, and empty turns inserted, so
that the roles' initials read (s?(ua)+)?. Of the cheapest ways the one whose string of edits
(D, I, K, R) is least in ASCII order is taken.

A turn's edit together with the insertions before it is one step, with a code such as "IIK". No
code begins another one, and a turn takes one step, so comparing two strings of edits
is comparing their steps: of the strings that lead to the four states (nothing yet, after s, u, a) only their
ranks are kept from turn to turn, with a pointer to the state before. Strings are made up
at the end, from the pointers. Costs less the smallest one and ranks take few values, so a
turn costs a look-up.

Rows that agree in everything are one run with a count. Runs are dealt by ranges of the whole sort order, so
a conversation of any length is many pieces; a piece gives cost and rank from each state to each state, the
pieces of a conversation are chained, and each is then run again from the state chosen for it.
Only the digest of a conversation is a chain of its own: one task streams its lines.

Defined results: a null role or text is one space; a null conversation is one of its own; turns
without a number come first; rows of one turn go by role and then by the text's SHA-256. A role whose
initial is not s, u or a cannot stay. Conversations none of whose rows is left have zeros, no
edits and the digest of an empty text; an empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import small_batches, stored

SPACES = " \t\n\x0b\x0c\r"
#: Costs of an insertion, another role, a deletion, and of a cut-off turn that stays.
INSERT, REROLE, DELETE, CUT = 3, 3, 4, 3
#: States: nothing yet, after s, after u, after a; where an insertion leads; what a step's code is.
AFTER_INSERT = (2, 2, 3, 2)
CODES = sorted("I" * k + e for k in range(3) for e in "DKR")
KEPT = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}
#: Insertions that end a conversation well from each state.
ENDING = (0, 2, 1, 0)
FORCED = ("-", True, False)
NONE = (None, None, None, None)
ROLES = {2: "user", 3: "assistant"}

Layer = tuple[tuple[int | None, ...], tuple[int | None, ...]]
START: tuple[Layer, ...] = tuple((tuple(0 if x == e else None for x in range(4)), tuple(0 if x == e else None for x in range(4))) for e in range(4))


def _inserted(state: int, k: int) -> int:
    for _ in range(k):
        state = AFTER_INSERT[state]
    return state


@functools.lru_cache(maxsize=None)
def step(layer: Layer, kind: tuple[str, bool, bool]) -> tuple[Layer, int, tuple]:
    """The layer after a turn of a kind (initial, must go, cut off), what all costs rose by, and (state before, code) of each state."""
    costs, ranks = layer
    initial, must_go, cut = kind
    best: list[tuple | None] = [None] * 4
    for state in range(4):
        if costs[state] is None:
            continue
        for number, code in enumerate(CODES):
            at, edit = _inserted(state, len(code) - 1), code[-1]
            cost = costs[state] + INSERT * (len(code) - 1)
            if edit == "D":
                to, cost = at, cost + DELETE
            elif must_go:
                continue
            elif edit == "K":
                to, cost = KEPT.get(initial, {}).get(at), cost + CUT * cut
            else:
                to, cost = 3 if at == 2 else 2, cost + REROLE + CUT * cut
            if to is not None and (best[to] is None or (cost, ranks[state], number) < best[to][:3]):
                best[to] = (cost, ranks[state], number, state)
    for x in (0, 1):  # what state 0 or 1 can save over 3 is one deletion at most
        if best[x] and best[3] and best[x][0] > best[3][0] + DELETE:
            best[x] = None
    least = min(b[0] for b in best if b)
    order = sorted(b[1:3] for b in best if b)
    return (tuple(b and b[0] - least for b in best), tuple(b and order.index(b[1:3]) for b in best)), least, tuple(b and (b[3], b[2]) for b in best)


def _steps(kind: tuple, n: int) -> tuple[tuple | None, int]:
    """The first step's kind of a run of n equal turns (None if all must go), and how many must go after it."""
    return (None, n) if kind[1] else (kind, n - 1)


def advance(layer: Layer, kind: tuple, n: int) -> tuple[Layer, int, list]:
    """A run's layer, cost and pointers. Of turns that must go, insertions come last, as D is before I: one step is made for the last, the others are plain."""
    first, gone = _steps(kind, n)
    rise, back = 0, []
    if first is not None:
        layer, more, pointers = step(layer, first)
        rise, back = rise + more, [pointers]
    if gone:
        layer, more, pointers = step(layer, FORCED)
        rise += more + DELETE * (gone - 1)
        back.append(pointers)
    return layer, rise, back


def _path(backs: list, state: int) -> list[list[tuple[int, str]]]:
    """For each run, (state before, code) of its steps, by pointers from the last state."""
    out = []
    for back in reversed(backs):
        mine = []
        for pointers in reversed(back):
            before, code = pointers[state]
            mine.append((before, CODES[code]))
            state = before
        out.append(mine[::-1])
    return out[::-1]


def _lines(steps: list[tuple[int, str]], role: str) -> list[tuple[str, str, bool]]:
    """(edit, role, whether the text is the turn's own) of what a run's steps leave."""
    out = []
    for state, code in steps:
        for edit in code:
            if edit == "I":
                state = AFTER_INSERT[state]
                out.append(("I", ROLES[state], False))
            elif edit == "R":
                out.append(("R", ROLES[3 if state == 2 else 2], True))
            elif edit == "K":
                out.append(("K", role, True))
    return out


KEY = ("conv", "turn", "role", "digest")


def _sorted(conv: str = "conv") -> list[Column]:
    return [F.col(conv).asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role"), F.col("digest")]


def runs_of(rows: DataFrame) -> DataFrame:
    """Rows (conv, turn, role, text, n) as runs of equal ones, with what the faults need."""
    text = F.rtrim("text", F.lit(SPACES))
    runs = rows.select("conv", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), "n")
    runs = runs.groupBy("conv", "turn", "role", "text").agg(F.sum("n").cast("long").alias("n"))
    runs = runs.withColumns({"digest": F.unhex(F.sha2("text", 256)), "initial": F.substring("role", 1, 1), "blank": text == "", "cut": ~F.substring(text, -1, 1).isin(".", "!", "?")})
    return stored(runs, "runs")


def ordered(runs: DataFrame) -> DataFrame:
    """Runs without texts, told whether role and text came earlier, in parts by ranges of the sort order."""
    light = runs.drop("text")
    first = light.groupBy("conv", "role", "digest").agg(F.count(F.lit(1)).alias("c"), F.min(F.struct(F.col("turn").isNotNull().alias("has"), "turn")).alias("first"))
    first = first.where("c > 1").select(F.col("conv").alias("__c"), F.col("role").alias("__r"), F.col("digest").alias("__d"), "first")
    on = light["conv"].eqNullSafe(F.col("__c")) & (light["role"] == F.col("__r")) & (light["digest"] == F.col("__d"))
    again = F.col("first").isNotNull() & ~F.col("first.turn").eqNullSafe(F.col("turn"))
    out = light.join(first, on, "left").select(*light.columns, again.alias("again"))
    return stored(out.repartitionByRange(*_sorted()).withColumn("part", F.spark_partition_id()), "ordered")


def _kind(initial: str, blank: bool, cut: bool, again: bool) -> tuple[str, bool, bool]:
    return FORCED if blank or again else (initial if initial in KEPT else "-", False, cut)


class _Piece:
    """What a part says of the conversation that it is in the middle of."""

    def __init__(self, conv: Any, first: bool):
        self.conv, self.layers = conv, [(e, START[e], 0) for e in range(1 if first else 4)]
        self.counts = [0, 0, 0, 0]  # blank, duplicate, truncated, illegal
        self.begin: tuple[str, Any] | None = None
        self.last: tuple[str, Any] = ("", None)
        self.turns = [None, None, 0]  # least, largest, how many

    def add(self, turn: Any, n: int, initial: str, blank: bool, cut: bool, again: bool) -> None:
        kind = _kind(initial, blank, cut, again)
        moved = []
        for entry, layer, cost in self.layers:
            layer, rise, _ = advance(layer, kind, n)
            moved.append((entry, layer, cost + rise))
        self.layers = moved
        self.counts[0 if blank else 1] += n if blank or again else n - 1
        self.counts[2] += not (blank or again) and cut
        self.counts[3] += n - 1 + (self.begin is not None and self.last[0] + initial not in ("su", "ua", "au"))
        if turn is not None:
            least, largest, count = self.turns
            self.turns = [turn if least is None else least, turn, count + (largest is None or turn != largest)]
        self.begin, self.last = self.begin or (initial, turn), (initial, turn)

    def row(self, part: int) -> tuple:
        costs, ranks = [None] * 16, [None] * 16
        for entry, (c, r), base in self.layers:
            costs[4 * entry : 4 * entry + 4] = [None if x is None else x + base for x in c]
            ranks[4 * entry : 4 * entry + 4] = r
        return (self.conv, part, costs, ranks, self.counts, [self.begin[0], self.last[0]], *self.turns)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def _pieces(schema: pa.Schema):
    """Rows (part, conv, turn, n, initial, blank, cut, again) in order, to a row for each part and conversation."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, piece, out = None, None, []
        for b in batches:
            for at, conv, *rest in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if at != part or piece is None or conv != piece.conv:
                    if piece is not None:
                        out.append(piece.row(part))
                    # another conversation's rows came first in this part, so this one begins here
                    piece = _Piece(conv, piece is not None and at == part)
                    part = at
                piece.add(*rest)
            if len(out) >= 1000:
                yield _batch(out, schema)
                out = []
        if piece is not None:
            out.append(piece.row(part))
        yield _batch(out, schema)

    return run


def chain(pieces: list[tuple]) -> tuple[list[tuple[int, int]], int, int]:
    """The states in which each piece of a conversation begins and ends, the insertions at its end, and the cost. pieces: (costs, ranks), 16 each."""
    costs, ranks, back = [0, None, None, None], [0, None, None, None], []
    for cost, rank in pieces:
        best: list[tuple | None] = [None] * 4
        for m in range(4):
            for x in range(4):
                if costs[m] is not None and cost[4 * m + x] is not None:
                    found = (costs[m] + cost[4 * m + x], ranks[m], rank[4 * m + x], m)
                    best[x] = found if best[x] is None else min(best[x], found)
        order = sorted(b[1:3] for b in best if b)
        costs, ranks = [b and b[0] for b in best], [b and order.index(b[1:3]) for b in best]
        back.append([b and b[3] for b in best])
    total, _, tail, state = min((costs[x] + INSERT * ENDING[x], ranks[x], ENDING[x], x) for x in range(4) if costs[x] is not None)
    path, at = [], state
    for pointers in reversed(back):
        path.append((pointers[at], at))
        at = pointers[at]
    return path[::-1], tail, total


def _chosen(schema: pa.Schema):
    """Pieces in order, to (conv, part, begins, ends, totals, tail); totals and the tail's lines stand on the last one."""

    def whole(held: list[tuple]) -> list[tuple]:
        path, tail, cost = chain([(p[2], p[3]) for p in held])
        counts = [sum(p[4][i] for p in held) for i in range(4)]
        least = largest = before = None
        distinct = 0
        for i, p in enumerate(held):
            counts[3] += i > 0 and held[i - 1][5][1] + p[5][0] not in ("su", "ua", "au")
            if p[8]:
                distinct += p[8] - (before is not None and p[6] == before)
                least, largest, before = p[6] if least is None else least, p[7], p[7]
        gaps = 0 if least is None else largest - least + 1 - distinct
        lines = [x[:2] for x in _lines([(path[-1][1], "I" * tail)], "")]
        rows = [(p[0], p[1], *path[i], None, None) for i, p in enumerate(held)]
        rows[-1] = (*rows[-1][:4], [gaps, *counts, cost], lines)
        return rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, out = [], []
        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if held and row[0] != held[0][0]:
                    out += whole(held)
                    held = []
                held.append(row)
            if len(out) >= 1000:
                yield _batch(out, schema)
                out = []
        yield _batch(out + (whole(held) if held else []), schema)

    return run


def _edited(schema: pa.Schema):
    """Rows (conv, begins, ends, turn, role, digest, n, initial, blank, cut, again), a piece's states before its runs, to each run's edits and lines."""

    def made(runs: list[tuple], begins: int, ends: int) -> list[tuple]:
        layer, backs = START[begins], []
        for r in runs:
            layer, _, back = advance(layer, _kind(*r[5:]), r[4])
            backs.append(back)
        out = []
        for r, steps in zip(runs, _path(backs, ends), strict=True):
            plain = "D" * (_steps(_kind(*r[5:]), r[4])[1] - 1)  # before the last step of those that must go
            codes = [c for _, c in steps]
            audit = "".join(codes[:-1]) + plain + codes[-1] if r[4] > 1 else codes[0]
            out.append((*r[:4], audit, _lines(steps, r[2])))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs, states, out = [], None, []
        for b in batches:
            for conv, begins, ends, *rest in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if begins is not None:
                    if runs:
                        out += made(runs, *states)
                    runs, states = [], (begins, ends)
                else:
                    runs.append((conv, *rest))
            if len(out) >= 1000:
                yield _batch(out, schema)
                out = []
        yield _batch(out + (made(runs, *states) if runs else []), schema)

    return run


@dataclass
class Repair:
    """runs: turns as they came, equal ones with a count. edits: each run's edits and the lines they leave.
    totals: for each conversation its counts, cost and the lines at its end."""

    runs: DataFrame
    edits: DataFrame
    totals: DataFrame

    def turns(self) -> DataFrame:
        """The repaired turns in order: conv, place (turn, run, number), edit, role and text."""
        edits = self.edits.alias("e")
        runs = self.runs.select(*[F.col(c).alias("__" + c) for c in KEY], "text")
        same = [F.col("e." + c).eqNullSafe(F.col("__" + c)) for c in KEY]
        own = edits.join(runs, functools.reduce(lambda a, b: a & b, same)).select(*[F.col("e." + c) for c in KEY], "text", F.posexplode("lines").alias("number", "line"))
        own = own.select("conv", F.lit(0).alias("late"), "turn", F.col("role").alias("was"), "digest", "number", "line.edit", F.col("line.role").alias("role"), F.when(F.col("line.own"), F.col("text")).otherwise("").alias("text"))
        end = self.totals.select("conv", F.posexplode("tail").alias("number", "line"))
        none = [F.lit(None).cast(self.runs.schema[c].dataType).alias(a) for c, a in (("turn", "turn"), ("role", "was"), ("digest", "digest"))]
        return own.unionByName(end.select("conv", F.lit(1).alias("late"), *none, "number", "line.edit", "line.role", F.lit("").alias("text")))


def _arrow(fields: list[tuple[str, T.DataType]]) -> tuple[T.StructType, pa.Schema]:
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = T.StructType([T.StructField(n, t) for n, t in fields])
    return schema, to_arrow_schema(schema)


def repair(rows: DataFrame) -> Repair:
    """Repairs conversations: rows (conv, turn, role, text, n), n times each."""
    small_batches(rows.sparkSession)
    runs = runs_of(rows)
    parts = ordered(runs)
    conv, turn = runs.schema["conv"].dataType, runs.schema["turn"].dataType
    longs, texts = T.ArrayType(T.LongType()), T.ArrayType(T.StringType())
    schema, arrow = _arrow([("conv", conv), ("part", T.IntegerType()), ("costs", longs), ("ranks", longs), ("counts", longs), ("ends", texts), ("least", turn), ("largest", turn), ("distinct", T.LongType())])
    read = parts.select("part", *KEY, "n", "initial", "blank", "cut", "again").repartition("part").sortWithinPartitions("part", *_sorted())
    pieces = stored(read.select("part", "conv", "turn", "n", "initial", "blank", "cut", "again").mapInArrow(_pieces(arrow), schema), "pieces")
    tail = T.ArrayType(T.StructType([T.StructField("edit", T.StringType()), T.StructField("role", T.StringType())]))
    schema, arrow = _arrow([("conv", conv), ("part", T.IntegerType()), ("begins", T.IntegerType()), ("ends", T.IntegerType()), ("totals", longs), ("tail", tail)])
    chosen = stored(pieces.repartition("conv").sortWithinPartitions(F.col("conv").asc_nulls_first(), "part").mapInArrow(_chosen(arrow), schema), "chosen")
    line = T.StructType([T.StructField("edit", T.StringType()), T.StructField("role", T.StringType()), T.StructField("own", T.BooleanType())])
    schema, arrow = _arrow([("conv", conv), ("turn", turn), ("role", T.StringType()), ("digest", T.BinaryType()), ("audit", T.StringType()), ("lines", T.ArrayType(line))])
    both = parts.unionByName(chosen.select("conv", "part", "begins", "ends"), allowMissingColumns=True)
    both = both.repartition("part").sortWithinPartitions("part", F.col("conv").asc_nulls_first(), F.col("begins").isNull(), *_sorted()[1:])
    edits = both.select("conv", "begins", "ends", "turn", "role", "digest", "n", "initial", "blank", "cut", "again").mapInArrow(_edited(arrow), schema)
    return Repair(runs, stored(edits, "edits"), chosen.where("totals IS NOT NULL").select("conv", "totals", "tail"))


COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def _digested(schema: pa.Schema):
    """A conversation's totals, then its edits and its lines in order, to its row: texts stream by, none is held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        open_, conv, totals, audit, sha, lines = False, None, [0] * 6, [], hashlib.sha256(), 0
        for b in batches:
            for c, counts, tail, edits, line in zip(*(x.to_pylist() for x in b.columns), strict=True):
                if not open_ or c != conv:
                    if open_:
                        out.append((conv, *totals, "".join(audit), sha.hexdigest()))
                    open_, conv, totals, audit, sha, lines = True, c, [0] * 6, [], hashlib.sha256(), 0
                if counts is not None:
                    totals = counts
                if edits is not None:
                    audit.append(edits)
                if tail is not None:
                    audit.append("I" * tail)
                if line is not None:
                    sha.update(("\n" * (lines > 0) + line).encode())
                    lines += 1
            if len(out) >= 1000:
                yield _batch(out, schema)
                out = []
        if open_:
            out.append((conv, *totals, "".join(audit), sha.hexdigest()))
        yield _batch(out, schema)

    return run


def digests(done: Repair, convs: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """A row for each of convs (one column of conversations): counts, cost, edits, and the SHA-256 of the repaired lines."""
    conv = done.runs.schema["conv"].dataType
    turns = done.turns().select("conv", "late", "turn", F.col("was").alias("role"), "digest", "number", F.concat("role", F.lit(":"), "text").alias("line"))
    parts = [convs.select(F.col(convs.columns[0]).alias("conv"), F.lit(-1).alias("late")).distinct()]
    parts.append(done.totals.select("conv", F.lit(-1).alias("late"), "totals"))
    parts.append(done.totals.select("conv", F.lit(1).alias("late"), F.size("tail").alias("tail")))
    parts.append(done.edits.select("conv", F.lit(0).alias("late"), "turn", "role", "digest", "audit"))
    both = functools.reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts, turns)
    both = both.repartition("conv").sortWithinPartitions(F.col("conv").asc_nulls_first(), "late", *_sorted()[1:], F.col("number").asc_nulls_first())
    schema, arrow = _arrow([(conv_col, conv), *[(c, T.LongType()) for c in COUNTS], ("audit", T.StringType()), ("repaired_sha256", T.StringType())])
    return both.select("conv", "totals", "tail", "audit", "line").mapInArrow(_digested(arrow), schema)


def damaged(rows: DataFrame) -> DataFrame:
    """Conversations (conv_id, turn, role, text) with the faults that the CRC-32 of conv_id and turn gives them, as repair() takes them."""
    text = F.coalesce("text", F.lit(" "))
    key = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")])
    fault = F.crc32(key) % 20
    rows = rows.select(F.col("conv_id").alias("conv"), "turn", F.coalesce("role", F.lit(" ")).alias("role"), text.alias("text"), fault.alias("fault")).where("fault <> 0")
    changed = F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("fault") == 4, "user").otherwise(F.col("role"))
    return rows.select("conv", "turn", role.alias("role"), changed.alias("text"), F.when(F.col("fault") == 3, 2).otherwise(1).alias("n"))
