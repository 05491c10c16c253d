"""kNN plans agree; BM25 agrees with a brute-force Python scorer; merges follow their rules."""

import math
import re
from collections import Counter

from pyspark.sql import functions as F

from rankframe.operators.bm25 import bm25_index, bm25_scores, bm25_topk
from rankframe.operators.hybrid import merge_by_key, merge_first
from rankframe.operators.knn import knn
from conftest import MID, SMALL


def test_knn_plans_agree(spark):
    e = spark.read.parquet(f"{MID}/embeddings.parquet")
    q = e.where("vec_id % 10 = 0")
    a = knn(q, e, 10, qid="vec_id", iid="vec_id", exclude_self=True, method="blocked")
    b = knn(q, e, 10, qid="vec_id", iid="vec_id", exclude_self=True, method="sql")
    c = knn(q, e.repartition(7), 10, qid="vec_id", iid="vec_id", exclude_self=True, method="broadcast")
    assert sorted(a.collect()) == sorted(b.collect()) == sorted(c.collect())


def test_bm25_matches_python(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text")
    bench = spark.read.parquet(f"{SMALL}/benchmark.parquet")
    idx = bm25_index(docs, "doc_id", "text")
    got = {(r.query_id, r.item_id): r.score for r in bm25_scores(bench, idx, qid="item_id", qtext="text").collect()}
    tok = lambda s: re.sub(r"[^a-z0-9\s]", " ", s.lower()).split()
    corpus = [(r.doc_id, tok(r.text)) for r in docs.collect()]
    n = len(corpus)
    avgdl = sum(len(t) for _, t in corpus) / n
    df = Counter(w for _, t in corpus for w in set(t))
    idf = {w: math.log(n - f + 0.5) - math.log(f + 0.5) for w, f in df.items()}
    eps = 0.25 * sum(idf.values()) / len(idf)
    idf = {w: (eps if v < 0 else v) for w, v in idf.items()}
    for r in bench.collect():
        for d, toks in corpus:
            tf = Counter(toks)
            shared = [w for w in tok(r.text) if tf[w]]
            s = sum(idf.get(w, 0) * tf[w] * 2.5 / (tf[w] + 1.5 * (0.25 + 0.75 * len(toks) / avgdl))
                    for w in shared)
            if shared:
                assert abs(got[(r.item_id, d)] - s) < 1e-6
            else:
                assert (r.item_id, d) not in got


def test_merges(spark):
    dense = spark.createDataFrame([(1, 10, 1), (1, 11, 2), (1, 12, 3)], "query_id long, item_id long, rank int")
    sparse = spark.createDataFrame([(1, 12, 1), (1, 13, 2), (1, 10, 3)], "query_id long, item_id long, rank int")
    f = [r.item_id for r in merge_first([dense, sparse], "dense_first").orderBy("rank").collect()]
    i = [r.item_id for r in merge_first([dense, sparse], "interleave").orderBy("rank").collect()]
    assert f == [10, 11, 12, 13]
    assert i == [10, 12, 11, 13]
    keyed = [d.withColumn("url", F.when(F.col("item_id") == 13, "u10").otherwise(F.concat(F.lit("u"), F.col("item_id").cast("string"))))
             for d in (dense, sparse)]
    m = merge_by_key(keyed, "url").orderBy("rank").collect()
    # u10 first seen at dense pos 1, last value = sparse item 10 at pos 3 (after item 13 at pos 2)
    assert [(r.url, r.item_id) for r in m] == [("u10", 10), ("u11", 11), ("u12", 12)]


def test_bm25_topk_partition_invariance(spark):
    import __spark_entry__ as E
    q = E.queries()["bm25_topk"]
    old = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "1")
        a = sorted(q(spark, SMALL).collect())
        spark.conf.set("spark.sql.shuffle.partitions", "16")
        b = sorted(q(spark, SMALL).collect())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert a == b and len(a) > 0


def _loop_merge(lists, mode):
    if mode == "dense_first":
        seq = [x for l in lists for x in l]
    else:  # interleave
        seq = [l[i] for i in range(max(map(len, lists), default=0)) for l in lists if i < len(l)]
    out, seen = [], set()
    for x in seq:
        if x not in seen:
            out.append(x)
            seen.add(x)
    return out


def _loop_rrf(lists):
    score = {}
    for l in lists:
        for p, x in enumerate(l, 1):
            score[x] = score.get(x, 0.0) + 1.0 / (60 + p)
    return sorted(score, key=lambda x: (-math.floor(score[x] * 1e9 + 0.5), x))


def _loop_by_key(lists, key):
    d = {}
    for l in lists:
        for x in l:
            d[key(x)] = x
    return [(k, v) for k, v in d.items()]


def test_merges_equal_loops(spark):
    import random
    rng = random.Random(5)
    cases = {q: [rng.sample(range(30), rng.randint(0, 12)) for _ in range(2)] for q in range(200)}
    rows = [[(q, x, p + 1) for q, ls in cases.items() for p, x in enumerate(ls[s])] for s in range(2)]
    dfs = [spark.createDataFrame(r, "query_id long, item_id long, rank int") for r in rows]

    def lists_of(df):
        out = {}
        for r in df.orderBy("query_id", "rank").collect():
            out.setdefault(r.query_id, []).append(r.item_id)
        return out

    for mode in ("dense_first", "interleave"):
        got = lists_of(merge_first(dfs, mode))
        for q, ls in cases.items():
            assert got.get(q, []) == _loop_merge(ls, mode), (mode, q)
    got = lists_of(merge_first(dfs, "rrf"))
    for q, ls in cases.items():
        assert got.get(q, []) == _loop_rrf(ls), q
    keyed = [d.withColumn("url", (F.col("item_id") % 7).cast("string")) for d in dfs]
    m = merge_by_key(keyed, "url").orderBy("query_id", "rank").collect()
    got = {}
    for r in m:
        got.setdefault(r.query_id, []).append((r.url, r.item_id))
    for q, ls in cases.items():
        assert got.get(q, []) == _loop_by_key(ls, lambda x: str(x % 7)), q


def test_empty_inputs(spark):
    from rankframe.operators.knn import hash_embed
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text")
    none_q = spark.createDataFrame([], "item_id long, text string")
    idx = bm25_index(docs, "doc_id", "text")
    assert bm25_topk(bm25_scores(none_q, idx, qid="item_id", qtext="text"), 10).count() == 0
    e = spark.read.parquet(f"{SMALL}/embeddings.parquet")
    assert knn(e.limit(0), e, 5, qid="vec_id", iid="vec_id").count() == 0
    assert knn(e, e.limit(0), 5, qid="vec_id", iid="vec_id").count() == 0
    assert hash_embed(none_q, "item_id", "text").count() == 0
    empty_list = spark.createDataFrame([], "query_id long, item_id long, rank int")
    assert merge_first([empty_list, empty_list], "rrf").count() == 0


def test_bm25_scoring_paths_agree(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text")
    bench = spark.read.parquet(f"{SMALL}/benchmark.parquet")
    idx = bm25_index(docs, "doc_id", "text")
    full = sorted(bm25_scores(bench, idx, qid="item_id", qtext="text").collect())
    passes = bm25_scores(bench, idx, qid="item_id", qtext="text", query_side_rows=700)
    shuffled = bm25_scores(bench, idx, qid="item_id", qtext="text", query_side_rows=50)
    assert "Union" in passes._jdf.queryExecution().executedPlan().toString()
    assert sorted(passes.collect()) == full
    assert sorted(shuffled.collect()) == full


def test_padded_topk_ranks_negative_scores_last(spark):
    """Words that most items share have a negative idf; the floor takes the sign of their mean."""
    from rankframe.operators.bm25 import bm25_topk_padded
    docs = spark.createDataFrame([(1, "a b"), (2, "a b"), (3, "a b c"), (4, "zzz")], "doc_id long, text string")
    queries = spark.createDataFrame([(1, "a"), (2, "zzz"), (3, "none")], "query_id long, query string")
    idx = bm25_index(docs, "doc_id", "text")
    scores = bm25_scores(queries, idx).cache()
    raw = {(r.query_id, r.item_id): r.score for r in scores.collect()}
    for k in (1, 2, 4, 9):
        got = bm25_topk_padded(scores, queries, docs, "doc_id", k).collect()
        for q in (1, 2, 3):
            want = sorted(((-raw.get((q, d), 0.0), d) for d in (1, 2, 3, 4)))[:k]
            assert [(-r.score, r.item_id) for r in sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)] == want


def test_item_ids_must_be_unique(spark):
    import pytest
    docs = spark.createDataFrame([(1, "a"), (1, "b")], "doc_id long, text string")
    with pytest.raises(ValueError):
        bm25_index(docs, "doc_id", "text")


def test_scoring_shuffles_nothing_before_the_cut(spark):
    docs = spark.createDataFrame([(i, f"w{i % 7} w{i % 5} common") for i in range(200)], "doc_id long, text string")
    queries = spark.createDataFrame([(1, "common w1"), (2, "w2")], "query_id long, query string")
    idx = bm25_index(docs, "doc_id", "text")
    from rankframe.operators.bm25 import bm25_topk
    plan = bm25_topk(bm25_scores(queries, idx), 5)._jdf.queryExecution().executedPlan().toString()
    exchanges = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    assert sum("query_id" in line and "item_id" in line for line in exchanges) == 0, plan


def test_hash_embed_has_a_vector_for_each_row_of_an_id(spark):
    from rankframe.operators.knn import hash_embed
    rows = [(1, "red apple"), (1, "green pear"), (2, "red apple"), (2, None), (None, "")]
    got = hash_embed(spark.createDataFrame(rows, "id long, text string"), "id", "text").collect()
    alone = {t: hash_embed(spark.createDataFrame([(7, t)], "id long, text string"), "id", "text").first()["embedding"] for _, t in rows}
    key = lambda r: (str(r[0]), r[1])
    assert sorted([(r["id"], r["embedding"]) for r in got], key=key) == sorted([(i, alone[t]) for i, t in rows], key=key)


def test_knn_crossed_plan_agrees_and_copies_no_items(spark, monkeypatch):
    """More queries than a block: packs of both sides meet in a cartesian product, with the rows of the other plans."""
    from rankframe.operators import knn as K

    e = spark.read.parquet(f"{MID}/embeddings.parquet")
    base = sorted(knn(e, e, 10, qid="vec_id", iid="vec_id", exclude_self=True, method="sql").collect())
    monkeypatch.setattr(K, "BROADCAST_QUERY_ROWS", 10)
    monkeypatch.setattr(K, "QUERY_BLOCK_ROWS", 120)
    monkeypatch.setattr(K, "PACK_ROWS", 50)
    df = knn(e, e, 10, qid="vec_id", iid="vec_id", exclude_self=True)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and "FlatMapCoGroupsInPandas" not in plan
    assert sorted(df.collect()) == base


def test_running_topk_is_exact_with_ties_repeats_and_zero_vectors():
    import numpy as np

    from rankframe.operators.knn import SCALE, _RunningTopK

    rng = np.random.default_rng(1)
    items = rng.integers(-1, 2, (5000, 16)).astype(float)
    items[::50] = 0
    norms = np.linalg.norm(items, axis=1, keepdims=True)
    items = np.where(norms > 0, items / np.where(norms > 0, norms, 1), 0)
    ids = rng.permutation(5000)
    ids[:20] = ids[20:40]
    queries, qids = np.concatenate([items[:100], np.zeros((3, 16))]), np.concatenate([ids[:100], [9001, 9002, 9003]])
    for exclude_self in (False, True):
        best = _RunningTopK(qids, queries, 40, exclude_self)
        for a in range(0, 5000, 700):
            best.add(ids[a:a + 700], items[a:a + 700])
        want = []
        for q, v in zip(qids, queries):
            fp = np.floor(np.einsum("ij,j->i", items, v) * SCALE + 0.5).astype(int)
            met = sorted((-f, i) for f, i in zip(fp, ids) if not (exclude_self and i == q))[:40]
            want += [(q, i, -f) for f, i in met]
        assert sorted(map(tuple, best.rows().to_numpy().tolist())) == sorted(want)


def test_bm25_scores_agree_however_many_query_terms(spark, monkeypatch):
    """Many query terms are cut to the vocabulary by a shuffle before a broadcast; the scores stay."""
    from rankframe.operators import bm25 as B

    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text")
    bench = spark.read.parquet(f"{SMALL}/benchmark.parquet")
    idx = bm25_index(docs, "doc_id", "text")
    base = sorted(bm25_scores(bench, idx, qid="item_id", qtext="text").collect())
    monkeypatch.setattr(B, "QUERY_TERMS_UNCUT", 10)
    for rows in (500_000, 300, 20):
        got = bm25_scores(bench, idx, qid="item_id", qtext="text", query_side_rows=rows)
        assert sorted(got.select("query_id", "item_id", "score").collect()) == base
