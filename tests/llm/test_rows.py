"""Exact copies, near copies, fingerprints and mixing against plain code, with odd rows."""

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from conftest import SMALL
from pyspark.sql import functions as F

from rankframe.llm import exact, fingerprint, minhash, mixing, shingles
from rankframe.llm.common import SHINGLE_WORDS

KIND = "doc_id long, text string, lang string, source string, n_chars long, id long, bits string, row_id long, node string, block long, _maybe boolean"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def table(spark, rows):
    """Documents with extra columns named like the operators' own."""
    return spark.createDataFrame([(*r, None, 7, "x", 1, "y", 2, True)[:11] if len(r) == 4 else r for r in rows], KIND)


def odd_rows():
    r = random.Random(3)
    long_text = " ".join(str(r.randint(0, 999)) for _ in range(30_000))
    return [(0, None, "en", "a"), (1, "", "en", None), (2, " \t\n", None, "a"), (3, "one two", "en", "b"), (3, "one two", "en", "b"),
            (None, "one two", "en", "b"), (5, long_text, "en", "a"), (6, long_text, "fr", "b"), (7, "Ünïcode 中文 text", "de", None), (8, "a", "en", "z")]


def shingle_set(text):
    w = WORD.findall(text or "")
    return {tuple(w[i:i + SHINGLE_WORDS]) for i in range(max(1, len(w) - SHINGLE_WORDS + 1))} if w else set()


# ------------------------------------------------------------------ exact
def test_exact_groups(spark):
    rows = odd_rows()
    got = exact.exact_groups(table(spark, rows), hash_all=True).collect()
    assert len(got) == len(rows)
    same = {}
    for r in rows:
        same.setdefault(r[1] or "", []).append(r[0])
    for g in got:
        text = next(t for t in same if hashlib.sha256(t.encode()).hexdigest() == g.full_hash)
        ids = [i for i in same[text] if i is not None]
        assert g.keep_id == max(ids) and g.group_size == len(same[text])
    assert sum(g.kept for g in got) == len(same)
    assert all(g.doc_id == g.keep_id for g in got if g.kept)


def test_drop_copies_keeps_one_row_per_text_and_all_columns(spark):
    docs = table(spark, odd_rows())
    left = exact.drop_copies(docs)
    assert left.columns == docs.columns
    texts = [r.text or "" for r in left.collect()]
    assert sorted(texts) == sorted({r[1] or "" for r in odd_rows()})


# ------------------------------------------------------------------ near
def test_word_hashes_cut_nothing(monkeypatch):
    monkeypatch.setattr(shingles, "PIECE", 50)
    r = random.Random(1)
    texts = ["".join(r.choice("ab \n\tÜ中") for _ in range(r.choice((0, 3, 200, 700)))) for _ in range(60)] + ["x" * 400, " " * 90, ""]
    data, bounds = shingles.text_bytes(pa.array(texts))
    hashed, first, last, at = shingles.words(data, bounds)
    found = [bytes(data[a:b]) for a, b in zip(first, last)]
    want = [re.findall(rb"[^\x20\x09-\x0D]+", t.encode()) for t in texts]
    assert found == [w for ws in want for w in ws]
    assert np.diff(at).tolist() == [len(w) for w in want]
    by = {}
    for h, w in zip(hashed.tolist(), found):
        assert by.setdefault(w.lower(), h) == h
    assert len(set(by.values())) == len(by)


def test_samples_agree_as_often_as_texts_are_alike():
    rng = np.random.default_rng(0)
    sampler = minhash.Sampler(rng.uniform(0.5, 3, 1 << minhash.SLOT_BITS))
    left, right = [], []
    for i in range(300):
        w = [f"w{x}" for x in rng.integers(0, 400, 200)]
        v = list(w)
        for j in rng.integers(0, 200, rng.integers(1, 12)):
            v[j] = "other"
        left.append(" ".join(w))
        right.append(" ".join(v))
    a, b = (sampler.samples(*shingles.shingles(pa.array(t)), 300) for t in (left, right))
    like = sampler.similarities(pa.array(left), pa.array(right))
    assert abs((a == b).mean() - like.mean()) < 0.01


def brute_classes(rows):
    """class id per row, by comparing all pairs of distinct texts."""
    distinct = sorted({r[1] or "" for r in rows})
    t, h, c = shingles.shingles(pa.array(distinct))
    total = np.zeros(1 << minhash.SLOT_BITS, np.int64)
    times = np.array([sum((r[1] or "") == d for r in rows) for d in distinct])
    np.add.at(total, (h & np.uint64((1 << minhash.SLOT_BITS) - 1)).astype(int), times[t])
    sampler = minhash.Sampler(minhash.idf_table(total, len(rows)))
    parent = list(range(len(distinct)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    pairs = [(i, j) for i in range(len(distinct)) for j in range(i) if distinct[i].split() and distinct[j].split()]
    like = []
    for a in range(0, len(pairs), 4096):
        left, right = ([distinct[p[side]] for p in pairs[a:a + 4096]] for side in (0, 1))
        like += sampler.similarities(pa.array(left, pa.string()), pa.array(right, pa.string())).tolist()
    links = {d: 0 for d in distinct}
    for (i, j), s in zip(pairs, like):
        if s >= 0.8:
            parent[find(i)] = find(j)
            links[distinct[i]] += 1
            links[distinct[j]] += 1
    ids = {}
    for r in rows:
        ids.setdefault(find(distinct.index(r[1] or "")), []).append(r[0])
    smallest = {k: min((i for i in v if i is not None), default=None) for k, v in ids.items()}
    return [smallest[find(distinct.index(r[1] or ""))] for r in rows], links


def edited_rows(seed, originals, copies, edits):
    r = random.Random(seed)
    rows = []
    for o in range(originals):
        base = ["".join(r.choices("abcdefghij", k=5)) for _ in range(r.randint(60, 160))]
        rows.append((len(rows), " ".join(base), "en", "s"))
        for _ in range(copies):
            w = list(base)
            for _ in range(edits):
                w[r.randrange(len(w))] = "".join(r.choices("klmnop", k=6))
            rows.append((len(rows), " ".join(w), "en", "s"))
    return rows


@pytest.mark.parametrize("copies, edits", [(6, 1), (40, 2)])
def test_near_classes_equal_all_pairs(spark, copies, edits):
    rows = odd_rows() + [(100 + r[0], *r[1:]) for r in edited_rows(copies, 5, copies, edits)]
    got = minhash.near_duplicates(table(spark, rows))
    mine = sorted((r.doc_id is not None, r.doc_id or 0, r.class_id if r.class_id is not None else -1) for r in got.collect())
    classes, links = brute_classes(rows)
    want = sorted((r[0] is not None, r[0] or 0, c if c is not None else -1) for r, c in zip(rows, classes))
    assert len(mine) == len(rows)
    wrong = sum(a != b for a, b in zip(mine, want))
    assert wrong == 0, wrong


def test_one_bucket_of_chains_trees_and_twins_is_looked_at_whole(spark, monkeypatch):
    r = random.Random(8)
    base, texts = ["".join(r.choices("abcdefghij", k=5)) for _ in range(120)], []

    def edited(words, n):
        words = list(words)
        for _ in range(n):
            words[r.randrange(len(words))] = "".join(r.choices("klmnop", k=6))
        texts.append(words)
        return words
    for _ in range(4):
        last = edited(base, 12)
        for _ in range(7):  # a chain
            last = edited(last, 1)
    for _ in range(3):
        top = edited(base, 14)
        for _ in range(3):  # a tree
            edited(edited(top, 1), 1)
    for _ in range(12):  # twins
        edited(edited(base, r.randint(8, 20)), 1)
    r.shuffle(texts)
    rows = [(i, " ".join(t), "en", "s") for i, t in enumerate(texts)]
    monkeypatch.setattr(minhash, "_bucket_rows", lambda nodes: nodes.filter("has_shingles").select(F.lit(0).cast("long").alias("bucket"), "node"))
    got = {x.doc_id: x.class_id for x in minhash.near_duplicates(table(spark, rows)).collect()}
    classes, _ = brute_classes(rows)
    assert len(set(classes)) > 15
    assert got == {row[0]: c for row, c in zip(rows, classes)}


def test_a_third_of_all_rows_links_as_a_small_group_does(spark):
    r = random.Random(12)
    word = lambda of, k: "".join(r.choices(of, k=k))
    base = [word("abcdefghij", 5) for _ in range(160)]
    texts = [" ".join(base)]
    for i in range(50):
        w = list(base)
        for at in r.sample(range(8, 150, 10), 3):
            w[at] = word("klmnop", 8)
        texts.append(" ".join(w))
    plain = [len(shingle_set(texts[0]) & shingle_set(t)) / len(shingle_set(texts[0]) | shingle_set(t)) for t in texts[1:]]
    assert 0.82 < min(plain) and max(plain) < 0.84
    texts += [" ".join(word("qrstuv", 7) for _ in range(160)) for _ in range(102)]
    got = {x.doc_id: x.class_size for x in minhash.near_duplicates(table(spark, [(i, t, "en", "s") for i, t in enumerate(texts)])).collect()}
    assert [got[i] for i in range(51)] == [51] * 51 and {got[i] for i in range(51, 153)} == {1}


def test_drop_near_keeps_one_of_each_class(spark):
    rows = odd_rows() + [(100 + r[0], *r[1:]) for r in edited_rows(2, 3, 4, 1)]
    docs = table(spark, rows)
    left = minhash.drop_near(docs)
    assert left.columns == docs.columns
    classes, _ = brute_classes(rows)
    assert left.count() == len(set(classes))


def test_components_equal_union_find(spark):
    r = random.Random(5)
    edges = [(r.randrange(60), r.randrange(60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(40)]
    as_key = lambda i: i.to_bytes(2, "big")
    links = spark.createDataFrame([(as_key(a), as_key(b)) for a, b in edges], "a binary, b binary")
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x
    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        parent[y] = x
    got = {int.from_bytes(x.node, "big"): int.from_bytes(x.label, "big") for x in minhash.components(links).collect()}
    assert got == {x: find(x) for x in parent}


# ------------------------------------------------------------------ fingerprints
def test_sketch_is_exact_for_short_texts_and_merges(spark):
    rows = [(i, " ".join(random.Random(i).choices("abcde", k=40)), "en", "s") for i in range(12)] + [(50, None, "en", "s"), (51, "one", "en", "s")]
    k = 500
    df = table(spark, rows).select("doc_id", "text", fingerprint.sketch(F.col("text"), k).alias("sketch"))
    a, b = df.alias("a"), df.alias("b")
    pairs = a.crossJoin(b).select(
        F.col("a.text").alias("x"), F.col("b.text").alias("y"), fingerprint.resemblance(F.col("a.sketch"), F.col("b.sketch"), k).alias("like"),
        fingerprint.containment(F.col("a.sketch"), F.col("b.sketch"), k).alias("held"), fingerprint.distinct_shingles(F.col("a.sketch"), k).alias("n"))
    for r in pairs.collect():
        x, y = shingle_set(r.x), shingle_set(r.y)
        assert r.n == len(x)
        assert r.like == pytest.approx(len(x & y) / len(x | y) if x | y else 1.0)
        assert r.held == pytest.approx(len(x & y) / len(x) if x else 1.0)
    parts = df.filter("doc_id < 12").withColumn("key", F.col("doc_id") % 2)
    merged = {r.key: r.sketch for r in fingerprint.merge_parts(parts, "key", k=10).collect()}
    for key in (0, 1):
        every = sorted({h for r in parts.filter(F.col("key") == key).collect() for h in r.sketch})
        assert merged[key] == every[:10]


def test_next_document_wraps_and_edits(spark):
    rows = [r for r in odd_rows() if r[0] is not None]
    rows = [r for i, r in enumerate(rows) if r[0] not in [x[0] for x in rows[:i]]]
    got = {r.doc_id: r for r in fingerprint.with_next(table(spark, rows)).collect()}
    order = sorted(rows)
    for (i, t, *_), (_, after, *_) in zip(order, order[1:] + order[:1]):
        assert (got[i].text, got[i].next_text) == (t or "", after or "")
    assert fingerprint.with_next(table(spark, rows[:1])).first().next_text == ""
    assert fingerprint.with_next(table(spark, [])).count() == 0
    assert fingerprint.with_next(table(spark, odd_rows())).count() == len(odd_rows())


def test_fingerprint_query(spark):
    from rankframe.llm.queries import op7_fingerprint
    df = op7_fingerprint(spark, SMALL)
    assert not re.search("Python|Arrow|Pandas", df._jdf.queryExecution().toString())
    got = sorted(df.collect(), key=lambda r: r.doc_id)
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    ids, errors = sorted(docs), []
    for r, after in zip(got, ids[1:] + ids[:1]):
        text = docs[r.doc_id]
        put = len(text) // 4
        edited = text[:len(text) - put] + docs[after][:put]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        x, y = shingle_set(text), shingle_set(edited)
        errors.append(abs(r.near_edited - (len(x & y) / len(x | y) if x | y else 1.0)))
    assert max(errors) < 0.2 and np.mean(errors) < 0.04


# ------------------------------------------------------------------ mixing
def brute_targets(sizes):
    order = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    left, open_, target = 1.5 * sum(sizes.values()), set(order), {}
    while open_:
        share = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if share * weight[s] > 2 * sizes[s]}
        if not over:
            return target | {s: share * weight[s] for s in open_}
        for s in over:
            target[s] = 2.0 * sizes[s]
            left -= target[s]
        open_ -= over
    return target


@pytest.mark.parametrize("seed", [1, 2])
def test_mix_meets_targets(spark, seed):
    r = random.Random(seed)
    rows = odd_rows() + [(1000 + i, "w " * r.randint(0, 40), "en", r.choice(["a", "b", "Ü", "z", None, "hot", "hot", "hot"])) for i in range(3000)]
    run = lambda: sorted(mixing.copies_of(table(spark, rows), block_rows=50).collect(), key=lambda x: x.row_id)
    got = run()
    assert [tuple(x) for x in run()] == [tuple(x) for x in got]
    assert len(got) == len(rows)
    sizes = {}
    for _, text, _, source in rows:
        sizes[source] = sizes.get(source, 0) + len(WORD.findall(text or ""))
    target, taken, largest = brute_targets(sizes), {}, {}
    by_row = dict(enumerate(x[3] for x in rows))
    numbered = {x.row_id: x for x in got}
    sources = [x.source for x in table(spark, rows).withColumn("n", F.monotonically_increasing_id()).orderBy("n").collect()]
    for x, source in zip([numbered[k] for k in sorted(numbered)], sources):
        assert x.source_size == sizes[source] and x.target == pytest.approx(target[source])
        assert 0 <= x.copies <= 2
        taken[source] = taken.get(source, 0) + x.copies * x.size
        largest[source] = max(largest.get(source, 0), x.size)
    assert len(by_row) == len(rows)
    for s in sizes:
        assert abs(taken[s] - target[s]) <= largest[s] / 2 + 1e-6


def test_mix_takes_the_same_documents_however_rows_are_split(spark):
    r = random.Random(4)
    rows = odd_rows() + [(1000 + i, "w " * r.randint(0, 40), "en", r.choice(["a", "b", None, "hot", "hot"])) for i in range(1500)]
    rows += [(None, "the very same text", "en", "hot")] * 300

    def taken(given, parts):
        docs = table(spark, given).repartition(parts)
        return sorted(((x.doc_id is not None, x.doc_id or 0, x.size, x.copies) for x in mixing.copies_of(docs, block_rows=50).collect()))
    assert taken(rows, 1) == taken(r.sample(rows, len(rows)), 7)


def test_pairing_keeps_words_and_expectation():
    sizes, p = np.array([5.0, 3.0, 8.0, 1.0, 2.0]), np.array([0.4, 0.7, 0.2, 0.9, 0.5])
    seen = np.zeros(5)
    for seed in range(4000):
        got, left = mixing.settle(sizes, p, np.random.default_rng(seed))
        assert got @ sizes == pytest.approx(p @ sizes)
        assert all(x in (0.0, 1.0) for i, x in enumerate(got) if i != left)
        seen += got
    assert np.allclose(seen / 4000, p, atol=0.04)


def test_mixed_rows_come_as_often_as_taken(spark):
    rows = odd_rows()
    docs = table(spark, rows)
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    assert mixed.count() == sum(r.copies for r in mixing.copies_of(docs).collect())
    assert mixing.mix(table(spark, [])).count() == 0


@pytest.mark.parametrize("repeats", [0, 300])
def test_pipeline_mixing_writes_repeated_texts_only(spark, tmp_path, monkeypatch, repeats):
    import corpus_pipeline

    r = random.Random(5)
    rows = [(1000 + i, f"text {i} " + "w " * r.randint(0, 40), "en", r.choice(["a", "b", None])) for i in range(400)] + [(None, None, "en", "a"), (1, "", "en", "b")]
    rows += [(None, "the very same text", "en", "b")] * repeats
    table(spark, rows).repartition(5).write.parquet(f"{tmp_path}/docs")
    docs, written, cut = spark.read.parquet(f"{tmp_path}/docs"), [], mixing.cut_lineage

    def watch(df, name):
        if "row" in df.columns or "text" in df.columns:
            written.append(df.count())
        return cut(df, name)
    monkeypatch.setattr(mixing, "cut_lineage", watch)
    key = lambda x: (x.doc_id, x.text, x.source)
    mixed = [key(x) for x in corpus_pipeline.mixing_sources(spark, docs, "").collect()]
    by_id = {x.doc_id: key(x) for x in docs.collect() if x.doc_id is not None}
    text_of = lambda x: by_id.get(x.doc_id) or (None, "the very same text" if x.size else None, "b" if x.size else "a")
    want = [text_of(x) for x in mixing.copies_of(docs).collect() for _ in range(x.copies)]
    order = lambda v: sorted(v, key=str)
    assert len(mixed) > 300 and order(mixed) == order(want)
    assert sum(written) == repeats


def test_empty_tables(spark):
    none = table(spark, [])
    assert exact.exact_groups(none).count() == 0 and exact.drop_copies(none).count() == 0
    assert minhash.near_duplicates(none).count() == 0 and minhash.drop_near(none).count() == 0
    assert mixing.copies_of(none).count() == 0
