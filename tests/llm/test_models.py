"""Language, LM scores, subwords, chat, secrets and pages against plain code, with odd rows."""

import collections
import itertools
import json
import math
import re
import zlib

import numpy as np
import pytest
from conftest import SMALL
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from rankframe.llm import attention, bpe, chat, html_labels, htmlmain, langid, lm, queries, secretscan
from rankframe.llm.common import crc_bucket

ODD = [None, "", " \n\t", "123 456", "a", "中文", "<|endoftext|> x", "\x1c\x1f \x85\xa0", "word " * 40_000, "x" * 3000]


def table(spark, texts):
    """Documents with extra columns named like the operators' own."""
    return spark.createDataFrame([(i, t, "en", "s", 0, "ids", 1.0, "p") for i, t in enumerate(texts)],
                                 "doc_id long, text string, lang string, source string, n_chars long, ids string, score double, lang_pred string")


# ------------------------------------------------------------------ language
def test_gradients_of_the_byte_network():
    rng = np.random.default_rng(1)
    model = langid.ByteCnn.fresh(["a", "b", "c"], rng)
    x, y = rng.integers(0, 256, (6, 40)).astype(np.uint8), np.array([0, 1, 2, 0, 1, 2])

    def loss():
        p = model.predict(x, model.tables())
        return -np.log(p[np.arange(6), y]).mean()
    # forward in single precision: a coarse step and tolerance
    for p, g in zip(model.params(), model.gradients(x, y)):
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        old = p[at]
        p[at] = old + 1e-2
        up = loss()
        p[at] = old - 1e-2
        down = loss()
        p[at] = old
        assert (up - down) / 2e-2 == pytest.approx(g[at], rel=0.2, abs=2e-3)


def test_windows_cover_every_byte():
    data = np.arange(1000, dtype=np.int64).astype(np.uint8)
    starts, ends = np.array([0, 0, 600]), np.array([0, 600, 1000])
    windows, text, used = langid.document_windows(data, starts, ends)
    assert text.tolist() == [0, 1, 1, 1, 2, 2] and used.sum() == 1000
    assert bytes(windows[text == 1].ravel()[:600]) == bytes(data[:600])


def test_language_of_held_out_documents(spark):
    got = {r.doc_id: r for r in queries.op3_language_id(spark, SMALL).collect()}
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").collect()
    assert len(got) == len(docs)
    held = [d for d in docs if zlib.crc32(str(d.doc_id).encode()) % 4 == 2]
    assert all(got[d.doc_id].held_out == (d in held) for d in docs)
    assert np.mean([got[d.doc_id].lang_pred == d.lang for d in held]) > 0.9


def test_language_of_odd_rows(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    model = langid.train(docs, sample=60)
    got = sorted(langid.identify(table(spark, ODD), model).collect(), key=lambda r: r.doc_id)
    assert [r.lang_pred == "und" for r in got] == [not t or not re.search(r"[^\W\d_]", t) for t in ODD]
    assert all(0 <= r.score <= 1 for r in got)
    none = langid.train(docs.filter("lang = 'no such'"))
    assert none is None
    assert {(r.lang_pred, r.score) for r in langid.identify(table(spark, ODD), none).collect()} == {("und", 0.0)}
    assert langid.identify(table(spark, []), model).count() == 0


# ------------------------------------------------------------------ LM
def test_batched_windows_equal_one_by_one():
    rng = np.random.default_rng(2)
    ids, starts, sizes = rng.integers(0, 40, 130).astype(np.int32), np.array([0, 1 + 70, 1 + 70 + 3]), np.array([70, 2, 55])
    model = attention.Attention.fresh(np.bincount(ids, minlength=40).astype(float), rng)
    model.tables["far"] = rng.normal(0, 1, attention.KEYS).astype(np.float32)
    got, t, want = attention.log_probabilities(model, ids, starts, sizes), model.tables, []
    for s, n in zip(starts, sizes):
        for i in range(n):
            first = max(0, i - i % attention.BLOCK - attention.CONTEXT)
            keys = ids[s + first:s + i + 1]
            score = t["key"][keys] @ t["query"][ids[s + i]] + t["far"][i - np.arange(first, i + 1)]
            share = np.exp(score - score.max())
            hidden = np.tanh(t["own"][ids[s + i]] + share @ t["value"][keys] / share.sum())
            target = ids[s + i + 1]
            c = target % model.clusters
            top, low = hidden @ t["top"].T + t["top_bias"], hidden @ t["low"][model.members(c)].T + t["low_bias"][model.members(c)]
            want.append(top[c] - np.logaddexp.reduce(top) + low[target // model.clusters] - np.logaddexp.reduce(low))
    assert np.allclose(got, want, atol=1e-4)


def test_every_next_id_sums_to_one():
    rng = np.random.default_rng(3)
    model = attention.Attention.fresh(np.arange(30.0), rng)
    total = sum(np.exp(attention.log_probabilities(model, np.array([4, 9, j], np.int32), np.array([0]), np.array([2]))[1]) for j in range(30))
    assert total == pytest.approx(1.0, abs=1e-4)


def brute_base(rows, training):
    fold = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    tokens = {i: re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(fold)) + [None] for i, t in rows}
    count = collections.Counter(w for i, _ in rows if training(i) for w in tokens[i])
    n, v = sum(count.values()), len(count)
    return {i: (len(ts), sum(count[w] > 0 for w in ts), n, sum(math.log10((count[w] + 1) / (n + v + 1)) for w in ts)) for i, ts in tokens.items()}


def test_lm_scores(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    training = F.coalesce(crc_bucket("doc_id", 7) != 2, F.lit(True))
    model = lm.train(docs, queries.word_bpe_path(), training, steps=150)
    got = {r.doc_id: r for r in lm.score(docs, model, training).collect()}
    rows = docs.collect()
    train = lambda i: zlib.crc32(str(i).encode()) % 7 != 2
    want = brute_base([(d.doc_id, d.text) for d in rows], train)
    for i, (n, known, total, base) in want.items():
        r = got[i]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (n, known, total) and r.base_score == pytest.approx(base)
        assert r.score < 0
    assert sum(r.score for i, r in got.items() if train(i)) > sum(r.base_score for i, r in got.items() if train(i))


def test_lm_of_odd_rows(spark):
    docs = table(spark, ODD + ["a A", "a A"])
    training = F.col("doc_id") != 4
    model = lm.train(docs, queries.word_bpe_path(), training, steps=5)
    got = {r.doc_id: r for r in lm.score(docs, model, training).collect()}
    want = brute_base(list(enumerate(ODD + ["a A", "a A"])), lambda i: i != 4)
    assert {i: (r.n_tokens, r.n_known, r.train_tokens) for i, r in got.items()} == {i: w[:3] for i, w in want.items()}
    assert all(r.base_score == pytest.approx(want[i][3]) and np.isfinite(r.score) for i, r in got.items())
    none = table(spark, [])
    assert lm.score(none, lm.train(none, queries.word_bpe_path(), F.lit(True), steps=5), F.lit(True)).count() == 0
    alone = lm.score(docs, lm.train(docs, queries.word_bpe_path(), F.lit(False), steps=5), F.lit(False)).collect()
    assert {r.train_tokens for r in alone} == {0} and {r.base_score for r in alone} == {0.0}


@pytest.mark.parametrize("of", [lambda i: (None, f"text {i}"), lambda i: (7, "the same text"), lambda i: (None, "w " * 4000 if i % 20 == 0 else "w")])
def test_lm_blocks_stay_bounded_whatever_the_ids(spark, monkeypatch, of):
    docs = spark.createDataFrame([of(i) for i in range(400)], "doc_id long, text string").repartition(3)
    model = lm.train(docs, queries.word_bpe_path(), F.lit(True), sample=5, steps=2)
    monkeypatch.setattr(lm, "BLOCK_DOCS", 20)
    monkeypatch.setattr(lm, "BLOCK_BYTES", 8000)
    ask = lm._ask

    def bounded(n_ranges):
        run = ask(n_ranges)

        def check(table):
            assert table.num_rows < 80, table.num_rows
            assert sum(len(t) for t in table.column("text").to_pylist()) < 64_000
            return run(table)
        return check
    monkeypatch.setattr(lm, "_ask", bounded)
    got = lm.score(docs, model, F.lit(True)).collect()
    tokens = sum(len(of(i)[1].split()) + 1 for i in range(400))
    assert len(got) == 400 and {r.train_tokens for r in got} == {tokens} and sum(r.n_tokens for r in got) == tokens


# ------------------------------------------------------------------ subwords
@pytest.fixture(scope="module")
def coders():
    from tokenizers import Tokenizer
    path = queries.word_bpe_path()
    theirs = Tokenizer.from_file(path)
    theirs.no_truncation()
    theirs.no_padding()
    with open(path, encoding="utf-8") as f:
        return bpe.WordBpe(f.read()), theirs


def same(coders, text):
    ours, theirs = coders
    packed, decoded = ours.encode_texts([text])[0]
    ids = theirs.encode(text, add_special_tokens=False).ids
    return np.frombuffer(packed, "<u4").tolist() == ids and decoded == theirs.decode(ids, skip_special_tokens=False) and ours.decode(ids) == decoded


SOME = st.lists(st.sampled_from(["a", "The", "'s", "'RE", "<|endoftext|>", "<|end", " ", "\n", "\x1c", "\x85", "\xa0", "Σ", "ΑΣ ", "İ", "é", "ß", "9", "²",
                                 "中文", "가", "😀", "_", "...", "x" * 70, "abcdefghij" * 7, "ﬁ", "​"]), max_size=12).map("".join)


@settings(max_examples=300, deadline=None)
@given(st.one_of(SOME, st.text(max_size=30)))
def test_subwords_equal_the_library(coders, text):
    assert same(coders, text)


def test_lines_of_words_equal_texts(coders):
    ours, theirs = coders
    lines = ["the", "ünder", "x" * 80, "9a", "<|endoftext|>", "...", "\xa0", "'s"]
    assert ours.ids_of_words("\n".join(lines) + "\n") == [theirs.encode(w, add_special_tokens=False).ids for w in lines]
    lines.remove("<|endoftext|>")
    assert ours.ids_of_words("\n".join(lines) + "\n") == [theirs.encode(w, add_special_tokens=False).ids for w in lines]


def test_forgetting_changes_nothing(coders, monkeypatch):
    ours, _ = coders
    texts = ["some words and more words", "other words here", "<|endoftext|> some"]
    before = [ours.encode_texts([t])[0] for t in texts]
    monkeypatch.setattr(bpe, "REMEMBERED", 2)
    assert ours.encode_texts(texts) == before and [ours.encode_texts([t])[0] for t in texts] == before


def test_subword_table(spark, coders):
    ours, theirs = coders
    docs = table(spark, ODD)
    got = sorted(bpe.encode(docs, queries.word_bpe_path()).collect(), key=lambda r: r.doc_id)
    assert [np.frombuffer(r.ids, "<u4").tolist() for r in got] == [theirs.encode(t or "", add_special_tokens=False).ids for t in ODD]
    assert [r.text for r in got] == ODD
    assert bpe.encode(table(spark, []), queries.word_bpe_path()).count() == 0


# ------------------------------------------------------------------ chat
def test_calls_results_and_order(spark):
    call = lambda *cs: json.dumps({"tool_calls": [{"id": i, "name": n, "arguments": a} for i, n, a in cs]})
    answer = lambda i, c: json.dumps({"tool_call_id": i, "content": c})
    rows = [(1, 0, "system", "rules"), (1, 1, "user", "hello"), (1, 2, "assistant", call(("a", "add", {"y": 2, "x": 1}), ("b", "add", {"x": {"$result": "a"}}))),
            (1, 3, "tool", answer("a", "3")), (1, 4, "tool", answer("b", "4")), (1, 5, "tool", answer("b", "again")), (1, 6, "tool", answer("zz", "?")),
            (2, 0, "assistant", call(("c", "add", {"x": {"$result": "d"}}), ("d", "add", {"x": {"$result": "c"}}), ("a", "add", {}))),
            (2, 1, "tool", answer("c", "1")), (2, 2, "tool", answer("d", "1")), (2, 3, "assistant", call(("e", "nope", 5), ("f", "add", {"x": "s", "q": 1}))),
            (3, 0, "user", None), (3, 1, "assistant", "{not json"), (3, 1, "assistant", "{not json"), (None, None, None, None)]
    schema = {"add": {"type": "object", "required": ["x"], "additionalProperties": False, "properties": {"x": {}, "y": {"type": "integer", "maximum": 1}}}} | chat.REPLY_SCHEMA
    schema["add"]["properties"]["x"] = {"type": "integer"}
    df = spark.createDataFrame([(*r, "extra") for r in rows], "conv_id long, turn long, role string, text string, status string")
    got = chat.format_chat(df, schema).collect()
    by = collections.defaultdict(list)
    for r in got:
        by[r.kind, r.call_id].append(r)
    status = lambda kind, i: sorted(r.status for r in by[kind, i])
    assert status("call", "a") == ["linked", "repeated"] and status("result", "b") == ["linked", "repeated"]
    assert status("result", "zz") == ["orphan"] and status("call", "e") == ["open"]
    step = {(r.kind, r.call_id): r.step for r in got if r.status in ("linked", "open")}
    assert step["call", "a"] == 0 and step["result", "a"] == 1 and step["call", "b"] == 2 and step["result", "b"] == 3
    assert step["call", "c"] is None and step["result", "d"] is None
    first = next(r for r in by["call", "a"] if r.status == "linked")
    assert first.json == '{"arguments":{"x":1,"y":2},"id":"a","name":"add"}' and first.errors == ["$.y: value out of bounds"]
    assert by["call", "e"][0].errors == ["$: unknown tool"]
    assert by["call", "f"][0].errors == ["$.q: not allowed", "$.x: not of type integer"]
    assert by["call", "3:0"][0].errors == ["$.prompt: length out of bounds"]
    assert sorted(r.status for r in by["result", "3:0"]) == ["linked", "repeated"]
    assert len(got) == len(rows) + 1 + 2 + 1
    assert chat.format_chat(df.limit(0), schema).count() == 0


def test_canonical_json_is_stable():
    value = {"b": [1, {"z": None, "a": "é\n"}], "a": True}
    assert chat.canonical(json.loads(chat.canonical(value))) == chat.canonical(value) == '{"a":true,"b":[1,{"a":"é\\n","z":null}]}'


# ------------------------------------------------------------------ secrets
@pytest.fixture(scope="module")
def forest(spark):
    return secretscan.train(spark)


def test_forest_on_findings_it_has_not_seen(spark, forest):
    found = secretscan.labelled_findings(400, seed=99)
    docs = spark.createDataFrame([(i, f["before"] + f["candidate"] + f["after"]) for i, f in enumerate(found)], "doc_id long, text string")
    got = collections.defaultdict(bool)
    for r in secretscan.scan(docs, forest).collect():
        got[r.doc_id] |= r.secret
    right = np.mean([got[i] == bool(f["label"]) for i, f in enumerate(found)])
    assert right > 0.97


def test_forest_columns_equal_its_trees(spark, forest):
    found = secretscan.labelled_findings(60, seed=5)
    rows = spark.createDataFrame([(f["candidate"], f["before"], f["after"]) for f in found], "candidate string, before string, after string")
    names = [f"f_{k}" for k in secretscan.feature_columns()]

    def walk(tree, x):
        while tree.feature >= 0:
            tree = tree.below if x[tree.feature] <= tree.cut else tree.above
        return tree.share
    for r in secretscan.with_features(rows).select("*", forest[0].column(names).alias("vote")).collect():
        assert r.vote == walk(forest[0], [r[n] for n in names])


def test_secrets_of_odd_rows(spark, forest):
    key = "04dbebab91ab85687d33eeaaf9ac699e1188f962"
    texts = ODD + [f'x token = "{key}" y 4736962573099581 z{"a" * 16}', f"commit {key}", f'{key} token = "{key}"']
    df = secretscan.scan(table(spark, texts), forest)
    assert not re.search("Python|Arrow|Pandas", df._jdf.queryExecution().toString())
    got = sorted(((r.doc_id, r.nth, r.candidate, r.secret) for r in df.collect()))
    n = len(ODD)
    assert [g for g in got if g[3]] == [(n, 0, key, True), (n + 2, 1, key, True)]
    assert (n, 1, "4736962573099581", False) in got and (n + 1, 0, key, False) in got
    assert secretscan.scan(table(spark, []), forest).count() == 0


# ------------------------------------------------------------------ pages
@pytest.fixture(scope="module")
def model():
    return html_labels.trained()


def test_messages_equal_enumeration():
    rng = np.random.default_rng(4)
    parent = np.array([-1, 0, 0, 1, 1, 3, -1, 6])
    depth = np.array([0, 1, 1, 2, 2, 3, 0, 1])
    x = rng.normal(0, 1, (8, htmlmain.N_FEATURES))
    m = htmlmain.TreeModel(rng.normal(0, 0.3, htmlmain.N_FEATURES), rng.normal(0, 1, (2, 2)))
    p, joint = m.passes(x, parent, depth)
    total, ones, both = 0.0, np.zeros(8), np.zeros((8, 2, 2))
    for y in itertools.product((0, 1), repeat=8):
        w = math.exp(sum(y[i] * (x[i] @ m.weights) for i in range(8)) + sum(m.edge[y[parent[i]], y[i]] for i in range(8) if parent[i] >= 0))
        total += w
        ones += w * np.array(y)
        for i in range(8):
            if parent[i] >= 0:
                both[i, y[parent[i]], y[i]] += w
    assert np.allclose(p, ones / total) and np.allclose(joint, both / total)


def test_pages_it_has_not_seen(model):
    pages, labels, sources = html_labels.labelled_pages(200, 77)
    got = htmlmain.texts(model, sources)
    want = [" ".join(t for _, t in p.runs if html_labels.MARK in t) for p in pages]
    share = np.mean([sum(w in g.split() for w in t.split()) / max(1, len(t.split())) for g, t in zip(got, want)])
    extra = np.mean([max(0, len(g.split()) - len(t.split())) / max(1, len(t.split())) for g, t in zip(got, want)])
    assert share > 0.97 and extra < 0.05


def test_pages_of_the_table(spark):
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{SMALL}/pages.parquet").collect()}
    import html as H

    def article(source):
        inner = re.search(r"<article>(.*)</article>", source, re.S).group(1)
        inner = re.sub(r"<[^>]+>", "", re.sub(r"</?(p|h1|br|div)\b[^>]*>", " ", inner))
        return " ".join(H.unescape(inner).split())
    got = queries.op10_html(spark, SMALL).collect()
    assert len(got) == len(pages)
    assert all(r.text == article(pages[r.page_id]) and r.n_chars == len(r.text) for r in got)


def test_odd_pages(spark, model):
    body = "Some words, and more of them. Then a second sentence follows, with a comma."
    pages = [None, "", "   ", "no markup at all", "<", "<p", "<div>" * 3000 + "x", f"<article><h1>T &amp; U</h1><p>a&nbsp;b  <b>c</b>d<br>e {body}<script>var x='</p>'</script></article>"]
    df = spark.createDataFrame([(i, p, "old", "u") for i, p in enumerate(pages)], "page_id long, html string, text string, url string")
    got = sorted(htmlmain.extract(df, model, keep_html=False).collect(), key=lambda r: r.page_id)
    assert [r.text for r in got[:3]] == [""] * 3
    assert got[7].text == f"T & U a b cd e {body}" and got[7].url == "u"
    assert htmlmain.extract(df.limit(0), model).count() == 0


# ------------------------------------------------------------------ pipeline
def test_pipeline(spark):
    import corpus_pipeline as P
    assert [n for n, _ in P.STAGES] == ["language_id", "exact_dedup", "near_dedup", "mixing", "bpe"]
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    got = P.run(spark, SMALL)
    assert got.columns == [*docs.columns, "ids", "decoded"]
    rows = got.collect()
    known = {r.doc_id: r.text for r in docs.collect()}
    assert all(known[r.doc_id] == r.text for r in rows)
    times = collections.Counter(r.doc_id for r in rows)
    texts = collections.Counter(known[i] for i in times)
    assert max(times.values()) <= 2 and max(texts.values()) == 1


def test_held_out_rule(spark):
    rows = spark.range(300).select(F.col("id").alias("doc_id"), crc_bucket("id", 7).alias("b")).collect()
    assert all(r.b == zlib.crc32(str(r.doc_id).encode()) % 7 for r in rows)
