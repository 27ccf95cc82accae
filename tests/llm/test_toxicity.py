import os
import random
import zlib

import numpy as np
import pyarrow as pa

from tessera.llm import toxicity as X

GROUPS = ["women", "men", "muslims", "christians", "immigrants", "citizens"]


def corpus(n=1200):
    r = random.Random(8)
    docs, labels = [], []
    for i in range(n):
        toxic = r.random() < 0.3
        words = [f"w{r.randrange(300)}" for _ in range(r.randint(3, 60))]
        if toxic:
            words.insert(r.randrange(len(words)), r.choice(["scumbag", "idiots!", "Worthless"]))
        # one group is named mostly in toxic texts
        if r.random() < (0.7 if toxic else 0.1):
            words.insert(0, "women" if toxic else r.choice(GROUPS))
        docs.append((i, " ".join(words)))
        labels.append((i, 0, int(toxic)))
    return docs, labels


def frames(spark, docs, labels):
    return spark.createDataFrame([(*d, 1.0) for d in docs], "doc_id long, text string, score double"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_held_out_accuracy_and_neutral_mentions(spark):
    docs, labels = corpus()
    d, y = frames(spark, [*docs, (5000, None), (5001, ""), (5002, "women met men today"), (5003, "w1 met w2 today"), (None, "w1")], labels)
    got = {r.doc_id: r for r in X.toxicity(d, y).collect()}
    assert len(got) == len(docs) + 5
    for i in (0, 7, 5000):
        assert got[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2)
    truth = {i: t for i, _, t in labels}
    held = [i for i in truth if got[i].held_out]
    assert np.mean([got[i].predicted == truth[i] for i in held]) > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got.values())
    assert got[5000].score == got[5001].score and got[5002].predicted == 0
    # without the penalty the term carries score; with it, swapping the group hardly changes one
    free, tied = (X.train(d, y, swap_penalty=p) for p in (0.0, 10.0))
    gap = lambda m: abs(float(np.diff(m(pa.array(["women w1 w2", "men w1 w2"])))[0]))
    assert gap(tied) < 0.02 and gap(tied) < gap(free) / 3


def test_labels_of_held_out_rows_are_not_read(spark):
    docs, labels = corpus(400)
    d, y = frames(spark, docs, labels)
    turned = [(i, q, 1 - t if zlib.crc32(str(i).encode()) % 4 == 2 else t) for i, q, t in labels]
    a, b = ({r.doc_id: r.score for r in X.toxicity(d, frames(spark, docs, k)[1]).collect()} for k in (labels, turned))
    assert a == b


def test_edges(spark):
    docs, labels = corpus(40)
    d, y = frames(spark, docs, labels)
    assert X.toxicity(d.where("false"), y).count() == 0
    assert {r.score for r in X.toxicity(d, y.where("false")).collect()} == {1 / (1 + np.exp(30))}
    assert X.toxicity(d.unionByName(d), y.unionByName(y)).count() == 80
    assert X.swapped("Women and men") == "men and women" and X.swapped("none") is None


def test_scarce_labels_and_a_long_text(spark):
    """Thirty labelled toxic rows teach ten words, each in a few rows only, among thousands of other words."""
    r = random.Random(3)
    insults = [f"insult{chr(97 + k)}" for k in range(10)]
    docs, labels = [], []
    for i in range(400):
        toxic = i % 10 == 0
        words = [f"v{r.randrange(4000)}x" for _ in range(r.randint(20, 200))]
        if toxic:
            for w in r.sample(insults, 3):
                words.insert(r.randrange(len(words)), w)
        docs.append((i, " ".join(words)))
        labels.append((i, 0, int(toxic)))
    long = " ".join(f"v{k % 4000}y" for k in range(300_000))
    d, y = frames(spark, [*docs, (9000, long), (9001, long + " insulta insultb insultc")], labels)
    got = {x.doc_id: x for x in X.toxicity(d, y).collect()}
    held = [i for i, _, _ in labels if got[i].held_out]
    wanted = [i for i in held if i % 10 == 0]
    assert len(wanted) >= 5 and sum(got[i].predicted for i in wanted) >= 0.8 * len(wanted)
    assert sum(got[i].predicted for i in held if i % 10) <= 2
    assert got[9001].score > got[9000].score and got[9001].predicted == 1


def test_fit_is_at_the_least_of_its_objective():
    """Against the dense gradient: zero where a weight is, within the penalty where none is."""
    r = np.random.default_rng(1)
    n, m, l1, swap = 120, 15, 0.01, 10.0
    x = r.random((n, m)) < 0.3
    y = (x[:, 0] | x[:, 3]) ^ (r.random(n) < 0.1)
    twins = x[:40].copy()
    twins[:, [1, 2]] = twins[:, [2, 1]]
    ats = [np.flatnonzero(v).tolist() for v in [*x, *twins]]
    rows = pa.table({"row": pa.array([*range(n), *range(40)], pa.int64()), "label": pa.array([*y.astype(int), *y[:40].astype(int)], pa.int32()), "twin": [False] * n + [True] * 40, "ats": pa.array(ats, pa.list_(pa.int32()))})
    shuffled = rows.take(r.permutation(n + 40))
    w, b = X.fit(shuffled, m, swap, l1, steps=3000)
    error = (1 / (1 + np.exp(-(x @ w + b))) - y) / n
    diff = x[:40].astype(float) - twins
    gradient = x.T @ error + swap / 40 * diff.T @ (diff @ w)
    assert abs(error.sum()) < 1e-5 and (np.abs(gradient) < l1 + 1e-5).all()
    assert np.allclose(gradient[w != 0], -l1 * np.sign(w[w != 0]), atol=1e-5) and w[0] > 0 and w[3] > 0 and (w == 0).any()
    none, _ = X.fit(rows.filter(pa.compute.invert(rows["twin"])), m, swap, 1.0)
    assert (none == 0).all()


def test_the_driver_does_not_fit(spark, monkeypatch):
    driver, fit = os.getpid(), X.fit

    def elsewhere(*args):
        assert os.getpid() != driver
        return fit(*args)

    monkeypatch.setattr(X, "fit", elsewhere)
    docs = [(i, "you idiot of a man" if i % 3 == 0 else "a calm and kind woman") for i in range(60)]
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(60)], "doc_id long, toxic int")
    model = X.train(spark.createDataFrame(docs, "doc_id long, text string"), labels)
    toxic, calm = model(pa.array([docs[0][1], docs[1][1]]))
    assert len(model.keys) and toxic > 0.5 > calm
