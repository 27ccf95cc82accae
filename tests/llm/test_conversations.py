import functools
import hashlib
import random
import re
import zlib

import pytest

from tessera.llm import conversations as C

SPACE = re.compile(r"[^\x20\x09-\x0D]")


def damage(rows):
    """The contract's faults, row by row."""
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        fault = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if fault == 1:
            text = ""
        if fault == 2:
            text = re.sub("[.!?]", "", text)
        if fault == 4:
            role = "user"
        out += [(conv, turn, role, text)] * (0 if fault == 0 else 2 if fault == 3 else 1)
    return out


def brute(rows):
    """Every string of edits that can still be best, by full strings: (cost, edits, lines) for each state, turn by turn."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).digest()))
    seen, faults = set(), []
    for _, role, text in ((r[0], r[1], r[2]) for r in rows):
        found = SPACE.findall(text)
        faults.append("blank" if not found else "duplicate" if (role, text) in seen else "truncated" if found[-1] not in ".!?" else None)
        seen.add((role, text))

    def follow(initial, state):
        return {("s", ""): "s", ("u", ""): "u", ("u", "s"): "u", ("u", "a"): "u", ("a", "u"): "a"}.get((initial, state))

    now = {"": (0, "", ())}

    def best(options):
        out = {}
        for state, x in options:
            if state is not None and (state not in out or x < out[state]):
                out[state] = x
        return out

    def insertions(states):
        options = list(states.items())
        for _ in range(3):
            options += [(follow(r[0], s), (c + 3, e + "I", ls + (r + ":",))) for s, (c, e, ls) in options for r in ("user", "assistant")]
        return [(s, x) for s, x in options if s is not None]

    for (_, role, text), fault in zip(rows, faults):
        after = []
        for s, (c, e, ls) in insertions(now):
            after.append((s, (c + 4, e + "D", ls)))
            if fault not in ("blank", "duplicate"):
                more = 3 * (fault == "truncated")
                after.append((follow(role[:1], s), (c + more, e + "K", ls + (f"{role}:{text}",))))
                after += [(follow(r[0], s), (c + 3 + more, e + "R", ls + (f"{r}:{text}",))) for r in ("user", "assistant")]
        # the lesser prefix at equal cost stays the lesser one, whatever follows
        now = best(after)
    cost, edits, lines = min(x for s, x in insertions(now) if s in ("", "a"))
    turns = [r[0] for r in rows if r[0] is not None]
    pairs = [a[1][:1] + b[1][:1] for a, b in zip(rows, rows[1:])]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    return (gaps, *[faults.count(k) for k in ("blank", "duplicate", "truncated")], sum(p not in ("su", "ua", "au") for p in pairs), cost, edits, hashlib.sha256("\n".join(lines).encode()).hexdigest())


def run(spark, rows):
    df = spark.createDataFrame([(*r, 7) for r in rows], "conv_id long, turn long, role string, text string, n int")
    out = C.digests(C.repair(C.damaged(df)), df.select("conv_id"))
    assert out.columns == ["conv_id", *C.COUNTS, "audit", "repaired_sha256"]
    got = [tuple(r) for r in out.collect()]
    assert len(got) == len({r[0] for r in got})
    return {r[0]: r[1:] for r in got}


def expected(rows):
    left = {}
    for r in damage(rows):
        left.setdefault(r[0], []).append(r[1:])
    return {c: brute(left.get(c, [])) for c in {r[0] for r in rows}}


@pytest.fixture
def whole_parts(spark):
    """Small parts stay apart, so that conversations cross their borders."""
    name = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(name, "false")
    yield
    spark.conf.unset(name)


ROLES = ["user", "assistant", "system", "tool", "", None, "Uber", "agent", "su"]
TEXTS = ["Yes.", "no", "Well!\n", "", " \t\x0b", None, "why? ", "é ", "x. ", "Same."]


def test_equals_brute_force(spark, whole_parts):
    r = random.Random(4)
    rows = []
    for conv in [None, *range(120)]:
        turns = [r.choice([None, *range(9)]) if r.random() < 0.2 else t for t in range(r.randint(1, 9))]
        for i, t in enumerate(turns):
            role = r.choice(ROLES) if r.random() < 0.35 else ["system", "user", "assistant"][min(i, 1) + (i > 0 and i % 2 == 0)]
            rows.append((conv, t, role, r.choice(TEXTS) if r.random() < 0.5 else f"text {i}{r.choice('.!?,')}"))
    rows += rows[10:14] * 3
    r.shuffle(rows)
    got, want = run(spark, rows), expected(rows)
    assert got.keys() == want.keys()
    for c in want:
        assert got[c] == want[c], c


def test_a_conversation_over_many_parts(spark, whole_parts):
    """One conversation holds most rows, and one of its turns is repeated hundreds of times."""
    r = random.Random(5)
    rows = [(1, t, r.choice(["user", "assistant", "system", "x"]), r.choice(["a.", "b", "c?", f"d{t}."])) for t in range(700)]
    rows += [(1, 350, "user", "again.")] * 400 + [(2, 0, "user", "q."), (2, 1, "assistant", "a.")] + [(3, 5, "user", " ")] * 300
    assert run(spark, rows) == expected(rows)


def test_turns_are_whole(spark):
    rows = [(1, 0, "user", "a."), (1, 1, "tool", "b."), (1, 3, "user", "c.")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "conv long, turn long, role string, text string, n int")
    done = C.repair(df)
    got = done.turns().orderBy("conv", "late", "turn", "number").collect()
    assert [(x.turn, x.edit, x.role, x.text) for x in got] == [(0, "K", "user", "a."), (1, "R", "assistant", "b."), (3, "K", "user", "c."), (None, "I", "assistant", "")]


def test_none_left_and_empty(spark):
    gone = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    assert run(spark, [(gone, 0, "user", "hi.")]) == {gone: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}
    assert run(spark, []) == {}


def test_clashing_names_and_a_long_text(spark):
    df = spark.createDataFrame([(1, 0, "user", "w " * 300_000 + ".", "a", "b"), (1, 1, "assistant", "ok.", "a", "b")], "conv_id long, turn long, role string, text string, digest string, audit string")
    got = C.digests(C.repair(C.damaged(df)), df.select("conv_id")).collect()
    left = damage([tuple(r)[:4] for r in df.collect()])
    assert len(got) == 1 and tuple(got[0])[1:] == brute([r[1:] for r in left])


def test_few_layers(spark):
    """Costs less the smallest and ranks take few values, so a turn costs a look-up."""
    C.step.cache_clear()
    r = random.Random(1)
    kinds = [C._kind(i, False, c, g) for i in "sua-" for c in (False, True) for g in (False, True)]
    for entry in range(4):
        layer = C.START[entry]
        for _ in range(20_000):
            layer = C.step(layer, r.choice(kinds))[0]
    assert C.step.cache_info().currsize < 3000
    assert functools.reduce(lambda a, b: a and b, (a < b for a, b in zip(C.CODES, C.CODES[1:])))
