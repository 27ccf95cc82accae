import random

import pytest

from tessera.llm import token_counts as T

P = pytest.importorskip("public_tokenizers")


def exact(vocab, texts, bytes_=True):
    from tokenizers import Tokenizer, models, pre_tokenizers

    t = Tokenizer(models.Unigram(vocab, 0, bytes_))
    t.pre_tokenizer = pre_tokenizers.Metaspace(replacement=T.MARK, prepend_scheme="always", split=True)
    return [len(e.ids) for e in t.encode_batch(texts, add_special_tokens=False)]


def texts(letters, n=500):
    r = random.Random(6)
    return ["", " ", "\n", "  a", "▁", " ▁b", "a\n\nb \n c"] + ["".join(r.choice(letters) for _ in range(r.randint(0, 40))) for _ in range(n)]


def test_public_vocabulary():
    vocab = T.vocabulary(P.path("piece_bpe_32k.model"))
    sample = texts("abcdefghij  \n.,éß日😀1▁\t<s>0xA")
    assert T.Counter(vocab)(sample) == exact(vocab, sample)


@pytest.mark.parametrize("seed", range(6))
def test_ties_and_unknowns(seed):
    r = random.Random(seed)
    pieces = {"<unk>"} | {"".join(r.choice("abc▁") if i == 0 else r.choice("abc") for i in range(r.randint(1, 4))) for _ in range(14)}
    vocab = [("<unk>", 0.0), *((p, -float(r.choice([1, 2, 2, 3, 4]))) for p in sorted(pieces - {"<unk>"}))]
    sample = texts("abcd ")
    # the mark alone is part of such a vocabulary in practice
    vocab = vocab if any(p == T.MARK for p, _ in vocab) else [*vocab, (T.MARK, -2.0)]
    assert T.Counter(vocab)(sample) == exact(vocab, sample, False)


def test_rows(spark):
    rows = [(1, "two words"), (2, None), (None, ""), (1, "two words")]
    got = T.token_counts(spark.createDataFrame([(*x, 1) for x in rows], "doc_id long, text string, n_tokens int"), P.path("piece_bpe_32k.model")).collect()
    n = exact(T.vocabulary(P.path("piece_bpe_32k.model")), ["two words"])[0]
    assert sorted(((r.doc_id, r.n_tokens) for r in got), key=str) == sorted([(1, n), (1, n), (2, 0), (None, 0)], key=str)
    assert T.token_counts(spark.createDataFrame([], "doc_id long, text string"), P.path("piece_bpe_32k.model")).count() == 0
