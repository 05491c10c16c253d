"""The language model learns from all training texts, not from the windows its start is fitted on."""

import numpy as np
from pyspark.sql import functions as F

from rankframe.llm import attention, lm, queries
from rankframe.llm.bpe import WordBpe


def test_texts_outside_the_start_are_learnt(spark, monkeypatch):
    docs = spark.createDataFrame([(i, "red green blue " * 300) for i in range(30)] + [(40, None), (41, "")], "doc_id long, text string")
    with open(queries.word_bpe_path(), encoding="utf-8") as f:
        ids = sum(WordBpe(f.read()).ids_of_words("red\ngreen\nblue\n"), [])

    def score(training):
        model = lm.train(docs, queries.word_bpe_path(), training, sample=0, steps=5)
        return model, lm.score(docs, model, F.lit(False)).agg(F.sum("score")).first()[0]
    monkeypatch.setattr(lm, "PASS_BATCH", 16)
    model, learnt = score(F.lit(True))
    assert all(model.classes[i] > 2 for i in ids)
    assert model.rare[ids].tolist() == [0.0] * len(ids)
    monkeypatch.setattr(lm, "PASS_RATE", 0.0)
    assert learnt > 0.9 * score(F.lit(True))[1]
    monkeypatch.undo()
    model, other = score(F.col("doc_id") > 39)
    assert not model.classes[ids].any() and other < learnt


def test_scatter_adds_repeated_ids():
    rng = np.random.default_rng(4)
    ids, vectors, got = rng.integers(0, 5, (3, 4)), rng.normal(size=(3, 4, 2)).astype(np.float32), np.zeros((6, 2), np.float32)
    attention._scatter(got, ids, vectors)
    want = np.zeros((6, 2), np.float32)
    np.add.at(want, ids, vectors)
    assert np.allclose(got, want, atol=1e-6)


def test_gradients_are_the_slopes_of_the_loss():
    rng = np.random.default_rng(6)
    ids, starts, sizes = rng.integers(0, 30, 90).astype(np.int32), np.array([0, 51, 54]), np.array([50, 2, 35])
    model = attention.Attention.fresh(np.bincount(ids, minlength=30).astype(float), rng)
    model.tables = {k: v + rng.normal(0, 0.3, v.shape).astype(np.float32) for k, v in model.tables.items()}
    loss = lambda: -attention.log_probabilities(model, ids, starts, sizes).astype(float).mean()
    got = attention.gradients(model, ids, attention.blocks_of(starts, sizes))
    assert got.keys() == model.tables.keys()
    for name, table in model.tables.items():
        at = np.unravel_index(np.argmax(np.abs(got[name])), table.shape)
        was, ends = table[at], []
        for by in (0.02, -0.02):
            table[at] = was + by
            ends.append(loss())
        table[at] = was
        assert np.isclose((ends[0] - ends[1]) / 0.04, got[name][at], rtol=0.05, atol=1e-4), name


def test_words_below_the_newer_characters_are_coded_without_looking_for_them(monkeypatch):
    with open(queries.word_bpe_path(), encoding="utf-8") as f:
        coder = WordBpe(f.read())
    low, high = ["Über", "l'été,", "año", "\u02b0", "don't", "x1y22", "...", "a" * 90], ["\u03a3\u03a3", "中文", "\u1c89", "\u0558b", "\ua7daX", "e\u0301", "😀"]
    want = [np.frombuffer(coder.encode_texts([w])[0][0], "<u4").tolist() for w in low + high]
    assert coder.ids_of_words("".join(w + "\n" for w in low + high)) == want
    assert coder.ids_of_words("") == []

    class Never:
        def search(self, text):
            raise AssertionError(text)
    monkeypatch.setattr(coder, "newer", Never())
    coder.forget_pieces()
    assert coder.ids_of_words("".join(w + "\n" for w in low)) == want[:len(low)]
