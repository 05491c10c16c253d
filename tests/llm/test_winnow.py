"""Winnowing against a plain search for every window of every item."""

import random
import re

import numpy as np
import pyarrow as pa
from conftest import SMALL

from rankframe.llm import queries, winnow

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


def plain(docs, items):
    windows = {}
    for name, text in items:
        w = words(text)
        m = min(len(w), 10)
        for i in range(len(w) - m + 1 if m else 0):
            windows.setdefault(tuple(w[i:i + m]), set()).add(name)
    out = []
    for name, text in docs:
        w, hit, found = words(text), set(), set()
        for m in {len(x) for x in windows}:
            for i in range(len(w) - m + 1):
                if tuple(w[i:i + m]) in windows:
                    hit |= set(range(i, i + m))
                    found |= windows[tuple(w[i:i + m])]
        out.append((name, len(w), len(hit), tuple(sorted(str(x) for x in found if x is not None))))
    return sorted(out, key=repr)


def found_by(spark, docs, items):
    kind = "doc_id long, text string, size int, key string, row_id int, id string, windows int"
    docs = spark.createDataFrame([(*d, 1, "k", 2, "i", 3) for d in docs], kind)
    items = spark.createDataFrame([(*i, 1, "k") for i in items], "item_id long, text string, hash int, class string")
    found, sets = winnow.decontaminate(docs, items)
    names = {r.item_set: tuple(r["items"]) for r in sets.collect()}
    return sorted([(r.doc_id, r.n_words, r.n_hit, names[r.item_set] if r.item_set else ()) for r in found.collect()], key=repr)


def made(r, n_docs=60):
    vocabulary = [f"w{i}" for i in range(12)] + ["Ünï", "中文", "x1"]
    text = lambda n: r.choice((" ", ", ", "\n", "\x00")).join(r.choice(vocabulary) for _ in range(n))
    items = [(i, text(r.choice((10, 11, 14, 25, 40)))) for i in range(20)] + [(20, "w1 w2 w3 w1"), (21, "ÜNÏ rare"), (22, "..."), (23, None), (24, "")]
    items += [(i + 30, items[i % 3][1]) for i in range(40)] + [(None, items[4][1]), (4, items[5][1]), (4, items[4][1])]
    docs = [(9, None), (None, ""), (9, "... \t"), (8, "w1"), (8, "w1"), (None, items[0][1].upper())]
    for i in range(n_docs):
        parts = [text(r.randint(0, 30)) for _ in range(2)]
        parts.insert(1, r.choice(items)[1] or "" if r.random() < 0.6 else "")
        docs.append((i, r.choice((" ", " - ")).join(parts)))
    docs.append((99, " ".join([items[1][1]] * 400)))
    return docs, items


def test_every_window_is_found(spark, monkeypatch):
    monkeypatch.setattr(winnow, "LEAST_HOT", 5)  # so that frequent windows are dealt over several tasks here too
    docs, items = made(random.Random(4))
    assert found_by(spark, docs, items) == plain(docs, items)


def test_empty_tables(spark):
    docs, items = made(random.Random(5), 5)
    assert found_by(spark, docs, items[:0] or [(1, None)]) == plain(docs, [])
    assert found_by(spark, [(1, None)], items) == [(1, 0, 0, ())]
    nothing = spark.createDataFrame([], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    found, sets = winnow.decontaminate(nothing, none)
    assert found.count() == 0 and sets.count() == 0
    found, _ = winnow.decontaminate(spark.createDataFrame(docs, "doc_id long, text string"), none)
    assert found.count() == len(docs) and found.filter("n_hit > 0").count() == 0


def test_every_shared_span_keeps_a_common_fingerprint():
    r = random.Random(6)
    for _ in range(200):
        shared = [r.choice("abc") for _ in range(winnow.SPAN)]
        sides = [[r.choice("abc") for _ in range(r.randint(0, 9))] + shared + [r.choice("abc") for _ in range(r.randint(0, 9))] for _ in "ab"]
        prints = [set(winnow.chosen(*winnow.read_words(pa.array([" ".join(s)])))[1].tolist()) for s in sides]
        assert prints[0] & prints[1]


def test_words_are_those_of_the_pattern():
    r = random.Random(7)
    texts = ["".join(r.choice("aZ09 ./:@[`{\x7fÜ中\x80\n") for _ in range(r.randint(0, 60))) for _ in range(200)] + [None, ""]
    hashed, at = winnow.read_words(pa.array(texts))
    assert np.diff(at).tolist() == [len(words(t)) for t in texts]
    by = {}
    for h, w in zip(hashed.tolist(), [w for t in texts for w in words(t)]):
        assert by.setdefault(w, h) == h
    assert len(set(by.values())) == len(by)


def test_query_is_that_of_its_sql(spark):
    import os
    import sys
    sys.path.insert(0, os.path.join(os.path.dirname(__file__), "..", "..", "tools"))
    import oracle_check
    con = oracle_check.duck(SMALL)
    for key in ("op11_winnow", "op13_periodic"):
        info = oracle_check.compare(spark, con, key, queries.QUERIES[key], queries.SQL[key], SMALL)
        assert info["ok"], info
