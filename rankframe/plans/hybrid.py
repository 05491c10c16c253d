"""Registered queries: hybrid retrieval of every benchmark passage against every document.

Dense side: hashed text vectors (no model needed) and exact blocked kNN, top 40.  Sparse side:
BM25 top 40 (positive scores; the padded form for the URL-keyed merge, as in the BM25-hybrid
experiment).  Documents have no URL, so the keyed merge uses the document's content digest
``md5(text)`` as its key: exact copies collapse to one entry.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankframe.operators.bm25 import bm25_topk, bm25_topk_padded
from rankframe.operators.hybrid import attach_items, merge_by_key, merge_first
from rankframe.operators.knn import hash_embed, knn
from rankframe.plans import sparse
from rankframe.plans.common import index_artifact, sql_tok_ascii, t
from rankframe.session import broadcast_if_small, cut_lineage

K = 40
DIM = 64
RERANK_K = 20
LISTED_ROWS = 1_000_000


def doc_vectors(spark, sf):
    return index_artifact(spark, ("hashvec", sf, "documents"), lambda: cut_lineage(
        hash_embed(t(spark, sf, "documents"), "doc_id", "text", DIM), "doc-vectors"))


def dense_list(spark, sf):
    d = doc_vectors(spark, sf)
    b = hash_embed(t(spark, sf, "benchmark"), "item_id", "text", DIM)
    return knn(b, d, K, qid="item_id", iid="doc_id", normalize=False)


def sparse_list(spark, sf, padded=False):
    _, s = sparse._scores(spark, sf)
    if padded:
        return bm25_topk_padded(s, t(spark, sf, "benchmark").withColumnRenamed("item_id", "query_id"),
                                t(spark, sf, "documents"), "doc_id", K)
    return bm25_topk(s, K)


def _merged(spark, sf, mode):
    return merge_first([dense_list(spark, sf), sparse_list(spark, sf)], mode)


def q_dense_hashed(spark, sf):
    return dense_list(spark, sf).select("query_id", F.col("item_id").alias("doc_id"), "rank", "sim")


def q_hybrid_dense_first(spark, sf):
    return _merged(spark, sf, "dense_first").select("query_id", F.col("item_id").alias("doc_id"), "rank", "source", "pos")


def q_hybrid_interleave(spark, sf):
    return _merged(spark, sf, "interleave").select("query_id", F.col("item_id").alias("doc_id"), "rank", "source", "pos")


def q_hybrid_rrf(spark, sf):
    return _merged(spark, sf, "rrf").select("query_id", F.col("item_id").alias("doc_id"), "rank",
                                            F.round("score", 9).alias("score"))


def q_merge_by_url(spark, sf):
    """Both lists keyed by their documents' hashes; the texts of listed documents alone are hashed, each once."""
    lists = [dense_list(spark, sf), sparse_list(spark, sf, padded=True)]
    both = cut_lineage(reduce(DataFrame.union, [l.select("query_id", "item_id", "rank", F.lit(n).alias("list")) for n, l in enumerate(lists)]), "merge-lists")
    listed = broadcast_if_small(both.select("item_id").distinct(), LISTED_ROWS)
    keys = t(spark, sf, "documents").withColumnRenamed("doc_id", "item_id").join(listed, "item_id", "left_semi")
    both = both.join(cut_lineage(keys.select("item_id", F.md5("text").alias("url")), "merge-keys"), "item_id")
    merged = merge_by_key([both.filter(F.col("list") == n) for n in range(len(lists))], "url")
    return merged.select("query_id", "url", F.col("item_id").alias("doc_id"), "rank")


def q_attach_items(spark, sf):
    m = _merged(spark, sf, "dense_first").where(F.col("rank") <= RERANK_K).select("query_id", "item_id", "rank")
    a = attach_items(m, t(spark, sf, "documents"), "doc_id", ["lang", "source", "n_chars"])
    return a.select("query_id", F.col("item_id").alias("doc_id"), "rank", "lang",
                    F.col("source").alias("doc_source"), "n_chars")


QUERIES = {
    "dense_hashed": q_dense_hashed,
    "hybrid_dense_first": q_hybrid_dense_first,
    "hybrid_interleave": q_hybrid_interleave,
    "hybrid_rrf": q_hybrid_rrf,
    "merge_by_url": q_merge_by_url,
    "attach_items": q_attach_items,
}


def _hash_cte(name, table, idc):
    return f"""
{name}_tk as (select {idc} as id, unnest({sql_tok_ascii('text')}) as term from {table}),
{name}_h as (select id, cast(concat('0x', substr(md5(term), 1, 8)) as bigint) % {DIM} as slot,
        case when cast(concat('0x', substr(md5(term), 9, 8)) as bigint) % 2 = 0 then 1 else -1 end as sgn from {name}_tk),
{name}_s as (select id, slot, cast(sum(sgn) as double) as val from {name}_h group by id, slot),
{name}_n as (select id, sqrt(sum(val * val)) as nrm from {name}_s group by id),
{name}_v as (select s.id, s.slot, case when nrm > 0 then val / nrm else val end as val from {name}_s s join {name}_n using (id))"""


DENSE_CTE = (_hash_cte("dd", "documents", "doc_id") + "," + _hash_cte("bb", "benchmark", "item_id") + """,
dots as (select b.id as query_id, d.id as item_id, sum(b.val * d.val) as dot
         from bb_v b join dd_v d on b.slot = d.slot group by b.id, d.id),
dall as (select b.item_id as query_id, d.doc_id as item_id, floor(coalesce(dots.dot, 0.0) * 1e9 + 0.5) as sim_fp
         from benchmark b cross join documents d
         left join dots on dots.query_id = b.item_id and dots.item_id = d.doc_id),
dense as (select * from (select query_id, item_id, sim_fp / 1e9 as sim,
            row_number() over (partition by query_id order by sim_fp desc, item_id) as rank from dall) where rank <= 40),
sparse as (select query_id, doc_id as item_id, rank from top where rank <= 40),
u as (select query_id, item_id, rank as pos, 0 as source from dense
      union all select query_id, item_id, rank as pos, 1 as source from sparse)
""")

WITH = f"with {sparse.BM25_CTE}, {DENSE_CTE}"

SQL = {
    "dense_hashed": f"{WITH} select query_id, item_id as doc_id, rank, sim from dense",
    "hybrid_dense_first": f"""{WITH},
        f as (select * from (select *, row_number() over (partition by query_id, item_id order by source, pos) as n from u) where n = 1)
        select query_id, item_id as doc_id, row_number() over (partition by query_id order by source, pos) as rank, source, pos from f""",
    "hybrid_interleave": f"""{WITH},
        f as (select * from (select *, row_number() over (partition by query_id, item_id order by pos, source) as n from u) where n = 1)
        select query_id, item_id as doc_id, row_number() over (partition by query_id order by pos, source) as rank, source, pos from f""",
    "hybrid_rrf": f"""{WITH},
        s as (select query_id, item_id, sum(1.0e0 / (60 + pos)) as score from u group by query_id, item_id)
        select query_id, item_id as doc_id, row_number() over (partition by query_id order by floor(score * 1e9 + 0.5) desc, item_id) as rank,
               round(score, 9) as score from s""",
    "merge_by_url": f"""{WITH},
        allsc as (select b.item_id as query_id, d.doc_id, coalesce(sc.score, 0.0) as score
                  from benchmark b cross join documents d
                  left join sc on sc.query_id = b.item_id and sc.doc_id = d.doc_id),
        pad as (select * from (select query_id, doc_id as item_id,
                row_number() over (partition by query_id order by score desc, doc_id) as rank from allsc) where rank <= 40),
        uu as (select query_id, item_id, rank as pos, 0 as source from dense
               union all select query_id, item_id, rank as pos, 1 as source from pad),
        k as (select uu.*, md5(d.text) as url from uu join documents d on d.doc_id = uu.item_id),
        g as (select query_id, url, min(struct_pack(source := source, pos := pos)) as first, arg_max(item_id, struct_pack(source := source, pos := pos)) as item_id
              from k group by query_id, url)
        select query_id, url, item_id as doc_id,
               row_number() over (partition by query_id order by first.source, first.pos) as rank from g""",
    "attach_items": f"""{WITH},
        f as (select * from (select *, row_number() over (partition by query_id, item_id order by source, pos) as n from u) where n = 1),
        r as (select query_id, item_id, row_number() over (partition by query_id order by source, pos) as rank from f)
        select r.query_id, r.item_id as doc_id, r.rank, d.lang, d.source as doc_source, d.n_chars
        from r join documents d on d.doc_id = r.item_id where r.rank <= 20""",
}
