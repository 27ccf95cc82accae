import os
import re

import pytest

import corpus_pipeline
from tessera.llm import decontamination, toxicity

from .test_ngram_join import brute

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "ngram_join", "decontamination", "pii", "packing"]
    now = docs.cache()
    for name, stage in corpus_pipeline.STAGES:
        rows = {r.doc_id: r for r in now.collect()}
        out = stage(spark, now, SF).cache()
        if name != "packing":
            assert out.columns == docs.columns and out.schema == docs.schema
        kept = {r.doc_id: r for r in out.collect()} if name != "packing" else None
        if name == "toxicity":
            labels = spark.read.parquet(f"{SF}/labels.parquet")
            model = toxicity.train(now, labels)
            scores = {r.doc_id: r.score for r in toxicity.scored(now, model).collect()}
            assert set(kept) == {i for i, s in scores.items() if s < 0.3} and len(kept) < len(rows)
        elif name == "ngram_join":
            groups = brute([(i, r.text) for i, r in rows.items()], 5, 80)
            assert set(kept) == {g for _, g in groups.values()}
        elif name == "decontamination":
            items = spark.read.parquet(f"{SF}/benchmark.parquet").collect()
            words = lambda t: re.findall(r"\w+", t.lower())
            grams = {tuple(w[i : i + 12]) for x in items for w in [words(x.text)] for i in range(len(w) - 11)}
            leaked = {i for i, r in rows.items() for w in [words(r.text or "")] if any(tuple(w[k : k + 12]) in grams for k in range(len(w) - 11))}
            assert leaked <= set(rows) - set(kept)
            found = {r.doc_id for r in decontamination.leaks(now, spark.read.parquet(f"{SF}/benchmark.parquet")).collect()}
            assert set(kept) == set(rows) - found
        elif name == "pii":
            mail = re.compile(r"[\w.]+@[\w.]+\w|\+1 \(\d{3}\) \d{3}-\d{4}")
            for i, r in rows.items():
                a, b = mail.findall(r.text or ""), mail.findall(kept[i].text or "")
                assert len(a) == len(b) and all(x != y for x, y in zip(a, b)) and kept[i].n_chars == len(kept[i].text or "")
        else:
            done = out.groupBy("doc_id").agg({"length": "sum", "doc_tokens": "max"}).collect()
            assert {r.doc_id for r in done} == set(rows) and all(r[1] == r[2] for r in done)
        now = out
    again = corpus_pipeline.run(spark, SF).count()
    assert again == now.count()


def test_odd_rows_pass(spark):
    columns = "doc_id long, text string, lang string, source string, n_chars long, score double, found string, row int, __entities string"
    more = ("en", "s", 3, 0.9, "f", 7, "e")
    long = "w " * 60_000
    rows = [(1, None), (2, ""), (2, ""), (None, "no id"), (None, "no id"), (3, "a b"), (3, "a b"), (4, "one text here"), (7, "one text here"), (7, "another that is only here"), (8, long)]
    docs = spark.createDataFrame([(*r, *more) for r in rows], columns)
    now = docs
    for name, stage in corpus_pipeline.STAGES:
        now = stage(spark, now, SF)
        if name != "packing":
            assert now.schema == docs.schema
            got = now.collect()
            assert all(tuple(r)[2:4] + tuple(r)[5:] == more[:2] + more[3:] for r in got)
        if name == "ngram_join":
            want = [(1, None), (2, ""), (2, ""), (None, "no id"), (3, "a b"), (4, "one text here"), (7, "another that is only here"), (8, long)]
            assert sorted((str(r.doc_id), str(r.text)) for r in got) == sorted((str(i), str(t)) for i, t in want)
    assert now.select("doc_id").distinct().count() == 7
    empty = docs.where("false")
    for _, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, SF)
    assert empty.count() == 0
