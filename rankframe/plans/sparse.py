"""Registered queries: tokenizers and BM25 over ``documents`` (items) and ``benchmark`` (queries).

Items are whole documents, queries are whole benchmark passages; the truth for recall is every
document that contains the passage text.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from rankframe.functions.text import tokenize_ascii, tokenize_words
from rankframe.operators.bm25 import bm25_index, bm25_scores, bm25_topk, bm25_topk_padded
from rankframe.operators.bm25_blocks import block_index, topk_by_blocks
from rankframe.operators.bm25_segments import create, open_index, update
from rankframe.operators.containment import passage_matches
from rankframe.operators.evaluate import mean_recall, recall_at_k
from rankframe.plans.common import index_artifact, r6, sql_tok_ascii, sql_tok_words, t
from rankframe.session import cut_lineage, scratch_path
from rankframe.sources.tables import read_ground_truth, write_truth_csv

K_SPARSE = 40
K_RECALL = 10


def _index(spark, sf):
    return index_artifact(spark, ("bm25", sf, "documents"),
                          lambda: bm25_index(t(spark, sf, "documents"), "doc_id", "text"))


def _scores(spark, sf):
    idx = _index(spark, sf)
    return idx, bm25_scores(t(spark, sf, "benchmark"), idx, qid="item_id", qtext="text")


def q_tokenize(spark, sf):
    d = t(spark, sf, "documents").select("doc_id", tokenize_ascii("text").alias("toks"))
    return d.select("doc_id", F.size("toks").alias("n_tokens"), F.array_join("toks", " ").alias("tokens"))


def q_tokenize_words(spark, sf):
    d = t(spark, sf, "documents").select("doc_id", tokenize_words("text").alias("toks"))
    return d.select("doc_id", F.size("toks").alias("n_tokens"), F.array_join("toks", " ").alias("tokens"))


def q_bm25_term_stats(spark, sf):
    ts = _index(spark, sf).term_stats
    return ts.select("term", "df", F.round("idf", 6).alias("idf"))


def q_bm25_scores(spark, sf):
    _, s = _scores(spark, sf)
    return s.select("query_id", F.col("item_id").alias("doc_id"), "score")


def q_bm25_topk(spark, sf):
    _, s = _scores(spark, sf)
    return bm25_topk(s, K_SPARSE).select("query_id", F.col("item_id").alias("doc_id"), "rank",
                                         "score")


def _by_blocks(spark, sf):
    blocks = index_artifact(spark, ("bm25-blocks", f"{sf}/documents.parquet"), lambda: block_index(_index(spark, sf)))
    return topk_by_blocks(t(spark, sf, "benchmark"), blocks, K_SPARSE, qid="item_id", qtext="text")


def q_bm25_topk_blocks(spark, sf):
    """The rows of ``bm25_topk``, without scoring blocks of items that cannot be among them."""
    top, _ = _by_blocks(spark, sf)
    return top.select("query_id", F.col("item_id").alias("doc_id"), "rank", "score")


def q_bm25_blocks_skipped(spark, sf):
    """Per query: blocks with one of its terms, those scored and those skipped; they add up, and k rows' blocks are scored."""
    top, looked = _by_blocks(spark, sf)
    n = top.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_rows"))
    told = looked.join(n, "query_id", "left")
    fine = (F.col("scored") + F.col("skipped") == F.col("n_blocks")) & (F.col("skipped") >= 0) & (F.col("scored") > 0)
    return told.select("query_id", F.coalesce("n_rows", F.lit(0)).alias("n_rows"), fine.alias("adds_up"))


def _updated(spark, sf):
    """An index of an earlier state of ``documents``, brought up to date.

    The earlier state is a stand-in: one document in twenty had another text, one was not there yet, and
    for one there was a row that has gone since.
    """
    def build():
        docs, path, kind = t(spark, sf, "documents").select("doc_id", "text"), scratch_path(spark, "bm25-segments"), F.pmod("doc_id", F.lit(20))
        gone = docs.filter(kind == 11).select((-1 - F.col("doc_id")).alias("doc_id"), "text")
        before = docs.filter(kind != 3).withColumn("text", F.when(kind == 7, F.reverse("text")).otherwise(F.col("text")))
        create(before.union(gone), path, "doc_id")
        update(spark, path, docs.filter(kind.isin(3, 7)), gone, "doc_id")
        return open_index(spark, path)
    return index_artifact(spark, ("bm25-segments", f"{sf}/documents.parquet"), build)


def q_bm25_updated_terms(spark, sf):
    """Term statistics kept by difference through an update: those of an index built anew."""
    return _updated(spark, sf).term_stats.select("term", "df", F.round("idf", 6).alias("idf"))


def q_bm25_updated_topk(spark, sf):
    """Top-k over the updated index: that of an index built anew."""
    scores = bm25_scores(t(spark, sf, "benchmark"), _updated(spark, sf), qid="item_id", qtext="text")
    return bm25_topk(scores, K_SPARSE).select("query_id", F.col("item_id").alias("doc_id"), "rank", "score")


def q_bm25_topk_padded(spark, sf):
    _, s = _scores(spark, sf)
    r = bm25_topk_padded(s, t(spark, sf, "benchmark").withColumnRenamed("item_id", "query_id"),
                         t(spark, sf, "documents"), "doc_id", K_SPARSE)
    return r.select("query_id", F.col("item_id").alias("doc_id"), "rank", "score")


def passage_truth(spark, sf, idx=None):
    idx = idx or _index(spark, sf)
    return passage_matches(t(spark, sf, "benchmark"), t(spark, sf, "documents"), idx,
                           "item_id", "text", "doc_id", "text")


def q_passage_truth(spark, sf):
    return passage_truth(spark, sf).select("query_id", F.col("item_id").alias("doc_id"))


def q_recall_at_k_bm25(spark, sf):
    idx, s = _scores(spark, sf)
    pred = bm25_topk(s, K_SPARSE)
    r = recall_at_k(pred, passage_truth(spark, sf, idx), K_RECALL)
    return r.select("query_id", F.round("recall", 6).alias("recall"))


def q_mean_recall_bm25(spark, sf):
    idx, s = _scores(spark, sf)
    truth = cut_lineage(passage_truth(spark, sf, idx), "truth")  # read twice below
    r = recall_at_k(bm25_topk(s, K_SPARSE), truth, K_RECALL)
    m = mean_recall(r, truth)
    return m.select(F.round("mean_recall", 6).alias("mean_recall"), "n_queries")


def q_truth_csv_roundtrip(spark, sf):
    """The truth as a ground-truth CSV (passage text, document URL), written and read back."""
    truth = passage_truth(spark, sf).join(t(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), "text"),
                                          "query_id")
    rows = truth.select(F.col("text").alias("Query"),
                        F.concat(F.lit("https://x.example/view/doc-"), F.col("item_id").cast("string"),
                                 F.lit("/")).alias("Assessment_url"))
    path = scratch_path(spark, "truth-csv")
    write_truth_csv(rows, path)
    return read_ground_truth(spark, path)


QUERIES = {
    "truth_csv_roundtrip": q_truth_csv_roundtrip,
    "tokenize": q_tokenize,
    "tokenize_words": q_tokenize_words,
    "bm25_term_stats": q_bm25_term_stats,
    "bm25_scores": q_bm25_scores,
    "bm25_topk": q_bm25_topk,
    "bm25_topk_blocks": q_bm25_topk_blocks,
    "bm25_blocks_skipped": q_bm25_blocks_skipped,
    "bm25_updated_terms": q_bm25_updated_terms,
    "bm25_updated_topk": q_bm25_updated_topk,
    "bm25_topk_padded": q_bm25_topk_padded,
    "passage_truth": q_passage_truth,
    "recall_at_k_bm25": q_recall_at_k_bm25,
    "mean_recall_bm25": q_mean_recall_bm25,
}

# ---------------------------------------------------------------- DuckDB oracle SQL
BM25_CTE = f"""
toks as (select doc_id, {sql_tok_ascii('text')} as t from documents),
post as (select doc_id, dl, term, count(*) as tf
         from (select doc_id, len(t) as dl, unnest(t) as term from toks) group by doc_id, dl, term),
nn as (select count(*) as n_items from documents),
tot as (select sum(tf) as total from post),
raw as (select term, count(*) as df,
               cast(floor((ln(min(n_items) - count(*) + 0.5) - ln(count(*) + 0.5)) * 1e9 + 0.5) as bigint) as raw_fp
        from post, nn group by term),
avgi as (select sum(raw_fp) / count(*) as avg_fp from raw),
ts as (select term, df, case when raw_fp < 0 then floor(0.25 * avg_fp + 0.5) else raw_fp end / 1e9 as idf from raw, avgi),
qt as (select query_id, term, count(*) as qf
       from (select item_id as query_id, unnest({sql_tok_ascii('text')}) as term from benchmark)
       group by query_id, term),
sc as (select qt.query_id, post.doc_id,
              sum(floor(qf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / (total / n_items))) * 1e9 + 0.5)) / 1e9 as score
       from qt join ts using (term) join post using (term), nn, tot group by qt.query_id, post.doc_id),
top as (select query_id, doc_id, score,
               row_number() over (partition by query_id order by score desc, doc_id) as rank
        from sc where score > 0),
ptok as (select item_id as query_id, text as ptext, {sql_tok_ascii('text')} as pt from benchmark),
truth as (select distinct p.query_id, d.doc_id from ptok p, documents d where contains(d.text, p.ptext))
"""

SQL = {
    "tokenize": f"""select doc_id, len(t) as n_tokens, array_to_string(t, ' ') as tokens
        from (select doc_id, {sql_tok_ascii('text')} as t from documents)""",
    "tokenize_words": f"""select doc_id, len(t) as n_tokens, array_to_string(t, ' ') as tokens
        from (select doc_id, {sql_tok_words('text')} as t from documents)""",
    "bm25_term_stats": f"with {BM25_CTE} select term, df, {r6('idf')} as idf from ts",
    "bm25_scores": f"with {BM25_CTE} select query_id, doc_id, score from sc",
    "bm25_topk": f"with {BM25_CTE} select query_id, doc_id, rank, score from top where rank <= 40",
    "bm25_updated_terms": f"with {BM25_CTE} select term, df, {r6('idf')} as idf from ts",
    "bm25_updated_topk": f"with {BM25_CTE} select query_id, doc_id, rank, score from top where rank <= 40",
    "bm25_topk_blocks": f"with {BM25_CTE} select query_id, doc_id, rank, score from top where rank <= 40",
    "bm25_blocks_skipped": f"""with {BM25_CTE}
        select query_id, count(*) filter (where score > 0 and rank <= 40) as n_rows, true as adds_up
        from sc left join top using (query_id, doc_id, score) group by query_id""",
    "bm25_topk_padded": f"""with {BM25_CTE},
        allsc as (select b.item_id as query_id, d.doc_id, coalesce(sc.score, 0.0) as score
                  from benchmark b cross join documents d
                  left join sc on sc.query_id = b.item_id and sc.doc_id = d.doc_id),
        r as (select *, row_number() over (partition by query_id order by score desc, doc_id) as rank
              from allsc)
        select query_id, doc_id, rank, score from r where rank <= 40""",
    "passage_truth": f"with {BM25_CTE} select query_id, doc_id from truth",
    "truth_csv_roundtrip": f"""with {BM25_CTE}
        select b.text as "Query", concat('https://x.example/view/doc-', cast(t.doc_id as varchar), '/') as "Assessment_url"
        from truth t join benchmark b on b.item_id = t.query_id""",
    "recall_at_k_bm25": f"""with {BM25_CTE},
        p as (select distinct query_id, doc_id from top where rank <= 10)
        select t.query_id, {r6('count(p.doc_id) / count(*)')} as recall
        from truth t left join p on p.query_id = t.query_id and p.doc_id = t.doc_id group by t.query_id""",
    "mean_recall_bm25": f"""with {BM25_CTE},
        p as (select distinct query_id, doc_id from top where rank <= 10),
        r as (select t.query_id, count(p.doc_id) / count(*) as recall
              from truth t left join p on p.query_id = t.query_id and p.doc_id = t.doc_id group by t.query_id)
        select {r6('coalesce(avg(recall), 0.0)')} as mean_recall, count(*) as n_queries from r""",
}
