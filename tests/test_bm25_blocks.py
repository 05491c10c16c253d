"""Top-k by blocks equals top-k over all scores, and stop-word blocks are skipped."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from rankframe.operators import bm25_blocks as B
from rankframe.operators.bm25 import bm25_index, bm25_scores, bm25_topk


def corpus(spark, seed, n=400, words=60):
    r = random.Random(seed)
    word = lambda: f"w{min(int(r.expovariate(0.12)), words)}"
    docs = [(i, " ".join(word() for _ in range(r.choice((0, 1, 5, 20, 200))))) for i in range(n)]
    docs += [(n + i, docs[i % 7][1]) for i in range(60)] + [(n + 100, None)]
    queries = [(i, " ".join(word() for _ in range(r.choice((1, 2, 5, 30))))) for i in range(40)] + [(50, ""), (51, None), (52, "unknown")]
    return (spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(queries, "query_id long, query string"))


@pytest.mark.parametrize("seed, items, seeds, k", [(1, 4, 2, 5), (2, 16, 1, 40), (3, 2, 3, 1)])
def test_rows_are_those_of_all_scores(spark, monkeypatch, seed, items, seeds, k):
    monkeypatch.setattr(B, "BLOCK_ITEMS", items)
    monkeypatch.setattr(B, "SEED_BLOCKS", seeds)
    docs, queries = corpus(spark, seed)
    index = bm25_index(docs, "doc_id")
    want = bm25_topk(bm25_scores(queries, index), k)
    top, looked = B.topk_by_blocks(queries, B.block_index(index), k)
    assert sorted(top.select(*want.columns).collect()) == sorted(want.collect())
    told = looked.collect()
    assert all(r.scored + r.skipped == r.n_blocks and r.skipped >= 0 for r in told)
    assert {r.query_id for r in told} == {r.query_id for r in bm25_scores(queries, index).select("query_id").distinct().collect()}


def test_blocks_with_stop_words_alone_are_skipped(spark, monkeypatch):
    monkeypatch.setattr(B, "BLOCK_ITEMS", 8)
    docs = [(i, "the of and " * (1 + i % 5) + f"x{i}") for i in range(800)] + [(1000 + i, f"the rare find {i}") for i in range(10)]
    index = bm25_index(spark.createDataFrame(docs, "doc_id long, text string"), "doc_id")
    queries = spark.createDataFrame([(1, "the rare find")], "query_id long, query string")
    top, looked = B.topk_by_blocks(queries, B.block_index(index), 5)
    r = looked.first()
    assert r.n_blocks > 100 and r.skipped > 0.8 * r.n_blocks
    assert sorted(x.item_id for x in top.collect()) == [1000, 1001, 1002, 1003, 1004]


def test_negative_idf_and_empty_sides(spark, monkeypatch):
    monkeypatch.setattr(B, "BLOCK_ITEMS", 2)
    docs = spark.createDataFrame([(1, "a b"), (2, "a b"), (3, "a b c"), (4, "zzz")], "doc_id long, text string")
    queries = spark.createDataFrame([(1, "a"), (2, "zzz a"), (3, "c b")], "query_id long, query string")
    index = bm25_index(docs, "doc_id")
    blocks = B.block_index(index)
    for k in (1, 2, 9):
        top, _ = B.topk_by_blocks(queries, blocks, k)
        want = bm25_topk(bm25_scores(queries, index), k)
        assert sorted(top.select(*want.columns).collect()) == sorted(want.collect())
    top, looked = B.topk_by_blocks(queries.filter("false"), blocks, 3)
    assert top.count() == 0 and looked.count() == 0
    none = B.block_index(bm25_index(docs.filter("false"), "doc_id"))
    assert B.topk_by_blocks(queries, none, 3)[0].agg(F.count("*")).first()[0] == 0


@pytest.mark.parametrize("tokens", [1, 40, 1 << 17])
def test_block_rows_are_made_without_a_shuffle(spark, monkeypatch, tokens):
    monkeypatch.setattr(B, "BLOCK_ITEMS", 4)
    written, cut = {}, B.cut_lineage

    def kept(df, name):
        written[name] = df._jdf.queryExecution().executedPlan().toString()
        return cut(df, name)
    monkeypatch.setattr(B, "cut_lineage", kept)
    docs, _ = corpus(spark, 5, 90)
    index = bm25_index(docs, "doc_id")
    rows = B.block_index(index).blocks.collect()
    assert "Exchange" not in written["bm25-blocks"]
    assert len({(r.term, r.block) for r in rows}) == len(rows)
    assert sorted((r.term, i.item_id, i.tf, i.dl) for r in rows for i in r["items"]) == sorted(
        (p.term, p.item_id, p.tf, p.dl) for p in index.postings.collect())
    assert all(r.most == max(i.tf * 2.5 / (i.tf + 1.5 * (0.25 + 0.75 * i.dl / index.avgdl)) for i in r["items"]) for r in rows)
    given = index.packed.sort("item_id").collect()
    table = pa.table({"item_id": [r.item_id for r in given], "postings": pa.array([[dict(p.asDict()) for p in r.postings] for r in given], pa.list_(pa.struct([("term", pa.string()), ("tf", pa.int64())]))),
                      "block": pa.array([i // 4 for i in range(len(given))], pa.int64())})
    monkeypatch.setattr(B, "SLICE_TOKENS", tokens)
    parts = list(B._whole_blocks(table.to_batches(max_chunksize=7)))
    assert pa.concat_tables(parts).equals(table.combine_chunks()) or pa.concat_tables(parts).to_pylist() == table.to_pylist()
    blocks = [set(p.column("block").to_pylist()) for p in parts]
    assert not any(a & b for i, a in enumerate(blocks) for b in blocks[:i])
