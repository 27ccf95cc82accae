import random

import pytest

from tessera.llm import decontamination as D

ITEMS = [
    (1, "The quick zebra counted seventeen amber lanterns beside the frozen harbor while three patient otters argued about marmalade. The answer was twelve copper buttons from Lisbon."),
    (2, "Étienne gardait onze violons rouges dans une grange humide près du canal et personne ne savait pourquoi les cordes chantaient encore après minuit."),
    (3, "Short item here"),
    (4, None),
    (5, "   "),
    (6, " ".join(f"long{i}" for i in range(150))),
]


def words(r, n):
    return [r.choice(["the", "of", "and", "a"]) if r.random() < 0.4 else f"w{r.randrange(4000)}" for _ in range(n)]


def exhaustive(text, unit):
    """The largest common subsequence of a unit with any stretch of 128 words of the text."""
    best = 0
    for at in range(0, max(1, len(text) - 127)):
        row = [0] * (len(unit) + 1)
        for w in text[at : at + 128]:
            new = row[:]
            for j, u in enumerate(unit):
                new[j + 1] = row[j] + 1 if w == u else max(row[j + 1], new[j])
            row = new
        best = max(best, row[-1])
    return best


@pytest.fixture(scope="module")
def case():
    r = random.Random(5)
    rows, leaked = [(1000, None), (1001, ""), (1002, " \n")], set()
    for i in range(120):
        text = words(r, r.randint(5, 400))
        kind = i % 6
        if kind in (0, 1, 2):
            item, unit = r.choice([(1, ITEMS[0][1]), (2, ITEMS[1][1]), (6, ITEMS[5][1])])
            copy = unit.split()
            if kind == 1:  # some words changed
                for _ in range(len(copy) // 6):
                    copy[r.randrange(len(copy))] = f"w{r.randrange(4000)}"
            if kind == 2:  # some words put in between
                for _ in range(len(copy) // 5):
                    copy.insert(r.randrange(len(copy)), f"w{r.randrange(4000)}")
            copy = [w.upper() for w in copy] if r.random() < 0.3 else copy
            at = r.randrange(len(text))
            text[at:at] = copy
            leaked.add((i, item))
        elif kind == 3:  # a scattering of an item's words is no leak
            for w in ITEMS[0][1].split()[::5]:
                text.insert(r.randrange(len(text)), w)
        rows.append((i, " ".join(text)))
    rows.append((500, "before. Short item here, after"))
    leaked.add((500, 3))
    return rows, leaked


def tables(spark, rows, items=ITEMS):
    return spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, covered string").repartition(4), spark.createDataFrame(items, "item_id long, text string")


def test_finds_planted_passages_and_nothing_else(spark, case):
    rows, leaked = case
    docs, items = tables(spark, rows)
    got = D.leaks(docs, items).collect()
    assert {(r.doc_id, r.item_id) for r in got} == leaked
    kept = D.clean(docs, items)
    assert {r.doc_id for r in kept.collect()} == {d for d, _ in rows} - {d for d, _ in leaked} and kept.columns == docs.columns


def test_covered_is_the_longest_common_subsequence():
    r = random.Random(1)
    for _ in range(50):
        unit, text = [r.randrange(12) for _ in range(r.randint(1, 20))], [r.randrange(12) for _ in range(r.randint(0, 40))]
        assert D.covered(text, D.Finder._masks(__import__("numpy").array(unit, "uint64")), len(unit)) == exhaustive(text, unit)


def test_edges(spark, case):
    docs, items = tables(spark, case[0][:20])
    assert D.leaks(docs, items.where("item_id > 99")).count() == 0 and D.clean(docs, items.where("item_id = 4")).count() == 20
    assert D.leaks(docs.where("false"), items).count() == 0
    twice = D.leaks(docs.unionByName(docs), items)
    assert twice.count() == 2 * D.leaks(docs, items).count()
    with pytest.raises(ValueError, match="in parts"):
        D.leaks(docs, items, max_words=20)


def test_excerpts_across_units_and_short_runs(spark):
    long, r = ITEMS[5][1].split(), random.Random(8)
    other = [(7, " ".join(f"the{i % 5} of{i % 7} and{i % 11}" for i in range(60)))]
    rows = [(0, words(r, 300) + long[36:92] + words(r, 300))]  # 28 words on either side of a border
    rows += [(1 + k, words(r, 90) + long[58 + k : 71 + k] + words(r, 90)) for k in range(8)]  # 13 words on and around it
    rows += [(20, long[128:150]), (21, words(r, 50) + other[0][1].split()[100:113])]
    clean = [(30 + k, words(r, 90) + long[60 + k : 72 + k] + words(r, 90)) for k in range(3)]  # 12 words
    clean += [(40, long[60:66] + ["x"] + long[66:73]), (41, long[60:66])]
    clean += [(42, long[66:73])]
    docs, items = tables(spark, [(i, " ".join(t)) for i, t in rows + clean], ITEMS + other)
    got = {(x.doc_id, x.item_id): x.covered for x in D.leaks(docs, items).collect()}
    assert set(got) == {(i, 7 if i == 21 else 6) for i, _ in rows}
    assert got[0, 6] == 56 / 64 and all(0 < v <= 1 for v in got.values())
    assert {x.doc_id for x in D.clean(docs, items).collect()} == {i for i, _ in clean}


def test_changed_excerpts_across_units(spark):
    changed, r = ITEMS[5][1].split()[36:92], random.Random(9)
    for i in range(4, 56, 8):
        changed[i] = "changed"
    rows = [(0, words(r, 200) + changed + words(r, 200))] + [(1 + i, words(r, 3300)) for i in range(40)]
    docs, items = tables(spark, [(i, " ".join(t)) for i, t in rows])
    assert [(x.doc_id, x.item_id, x.covered) for x in D.leaks(docs, items).collect()] == [(0, 6, 49 / 64)]


def test_runs_do_not_pass_from_one_text_to_the_next(spark):
    import pyarrow as pa

    bench = D.Benchmark([(6, ITEMS[5][1])], 64)
    w = D.Words(pa.array([" ".join(f"long{i}" for i in range(20, 28)), " ".join(f"long{i}" for i in range(28, 36)), None, " ".join(f"long{i}" for i in range(28, 42))]))
    assert list(bench.held_runs(w, D.word_hashes(w))) == [(3, 16, 0)]


def test_paraphrases_made_of_frequent_words(spark):
    r = random.Random(12)
    common = [f"c{i}" for i in range(60)]
    text = lambda n: [r.choice(common) for _ in range(n)]
    items = [(i, text(40)) for i in range(12)]
    rows, planted = [(1000 + i, text(r.randint(40, 300))) for i in range(150)], set()
    for i in range(60):
        item, copy = i % 12, items[i % 12][1][:]
        for _ in range(7):
            copy[r.randrange(len(copy))] = r.choice(common)
        rows.append((i, text(r.randint(0, 120)) + copy + text(r.randint(0, 120))))
        planted.add((i, item))
    for i in range(12):  # two words put in between for each of the item's
        rows.append((500 + i, [w for x in items[i][1] for w in (x, f"n{r.randrange(9000)}", f"n{r.randrange(9000)}")]))
        planted.add((500 + i, i))
    docs, bench = tables(spark, [(i, " ".join(t)) for i, t in rows], [(i, " ".join(t)) for i, t in items])
    got = {(x.doc_id, x.item_id) for x in D.leaks(docs, bench).collect()}
    assert len(planted & got) >= 0.97 * len(planted)
    assert not [x for x in got - planted if max(exhaustive(dict(rows)[x[0]], items[x[1]][1]), 0) < 24]


def test_singular_vectors_of_a_low_rank_matrix():
    import numpy as np

    r = np.random.default_rng(1)
    a = r.standard_normal((50, 6)) @ r.standard_normal((6, 30))
    omega = r.standard_normal((30, 10))
    v, s = D.singular_vectors(a.T @ (a @ omega), omega)
    u, want, vt = np.linalg.svd(a, full_matrices=False)
    assert np.allclose(s[:6], want[:6], rtol=1e-4) and np.allclose(np.abs(v[:, :6].T @ vt[:6].T), np.eye(6), atol=1e-3)


def test_finder_equals_a_search_without_bounds(monkeypatch):
    import numpy as np
    import pyarrow as pa

    r, half, covered = random.Random(3), 8, D.covered
    common = [f"c{i}" for i in range(12)]
    draw = lambda n: [r.choice(common) if r.random() < 0.8 else f"w{r.randrange(300)}" for _ in range(n)]
    items = [(i, " ".join(draw(20)) + ". " + " ".join(draw(n))) for i, n in enumerate((3, 7, 9, 30, 60))] + [(9, "c1 c2 w400")]
    texts = [draw(r.randint(0, 250)) for _ in range(24)]
    for text in texts[::3]:
        copy = r.choice(items)[1].split()
        copy = [w for x in copy for w in ([x, "x"] if r.random() < 0.1 else ["x"] if r.random() < 0.15 else [x])]
        at = r.randrange(len(text) + 1)
        text[at:at] = copy
    bench = D.Benchmark(items, 2 * half)
    frequency = np.array([r.randrange(9) for _ in bench.columns])
    basis = np.random.default_rng(1).standard_normal((len(bench.columns), 5)).astype(np.float32)
    arrow = pa.array([None, *(" ".join(t) for t in texts), ""])

    def search():
        bench.weigh(frequency, 99)
        return D.Finder(bench, basis, -2, 0.6, 0.5, 0.8, 0.85)

    want: dict = {}
    finder = search()
    w = D.Words(D.lowered(arrow))
    h = D.word_hashes(w).tolist()
    for d, (start, end) in enumerate(zip(w.first, w.first[1:], strict=False)):
        for first in range(start, end, half):
            if not any(x in bench.columns for x in h[first : min(end, first + 2 * half)]):
                continue
            near, wide = (h[max(start, first - k * half) : min(end, first + (2 + k) * half)] for k in (1, 4))
            for u, unit in enumerate(bench.units):
                n, answer = len(unit), len(bench.answers[u])
                a, b = (covered(x, finder.masks[u], n) / n for x in (near, wide))
                held = n >= 8 and answer and a >= 0.5 and covered(near, finder.answer_masks[u], answer) >= 0.8 * answer
                if share := a if a >= (0.6 if n >= 8 else 1) or held else b if n >= 8 and b >= 0.85 else 0:
                    want[d, u] = max(share, want.get((d, u), 0))
    assert len(want) > 15 and finder._near_units(w, np.array(h, np.uint64)) == want
    for name, value in (("HEAD", 3), ("PART_ROWS", 2), ("PART_WORDS", 40)):
        monkeypatch.setattr(D, name, value)
    assert search()._near_units(w, np.array(h, np.uint64)) == want


def test_words_that_a_unit_has_once_cover_little_of_it(monkeypatch):
    import numpy as np
    import pyarrow as pa

    calls, covered = [0], D.covered
    monkeypatch.setattr(D, "covered", lambda *x: calls.__setitem__(0, calls[0] + 1) or covered(*x))
    bench = D.Benchmark([(1, "c1 c1 c1 c1 c1 c1 c2 c2 c2 c2 c2 c2 c2 c3 c4 c5")], 16)
    bench.weigh(np.ones(len(bench.columns), np.int64), 9)
    finder = D.Finder(bench, np.ones((len(bench.columns), 1), np.float32), -2, 0.6, 0.5, 0.8, 0.85)
    assert finder(pa.array(["c1 c3 c3 c3 c3 c3 c4 c4 c4 c4 c4 c4 c2 c5 c5 c5"])) == [] and calls == [0]


def test_gram_of_frequent_and_rare_columns(monkeypatch):
    import numpy as np

    monkeypatch.setattr(D, "HEAD", 4)
    monkeypatch.setattr(D, "PART_ROWS", 3)
    r = np.random.default_rng(2)
    bench = D.Benchmark([(1, " ".join(f"w{i}" for i in range(11)))], 64)
    bench.weigh(r.integers(0, 9, 11), 30)
    row, col = np.sort(r.integers(0, 20, 90)), r.integers(0, 11, 90)
    a, omega, got = np.zeros((20, 11)), r.standard_normal((11, 3)), np.zeros((11, 3))
    np.add.at(a, (row, col), bench.idf[col])
    D._gram(bench, row, col, omega * bench.idf[:, None], got)
    assert np.allclose(got, a.T @ (a @ omega))
    D._gram(bench, row[:0], col[:0], omega * bench.idf[:, None], got)
    assert np.allclose(got, a.T @ (a @ omega))
