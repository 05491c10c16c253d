"""Recall@k and its mean (A1-A3, J6), as joins and aggregates over long tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankframe.functions.text import url_slug


def group_truth(truth: DataFrame, query_col: str = "Query", url_col: str = "Assessment_url", pos_col: str | None = None) -> DataFrame:
    """A1: truth entries per query in the order of ``pos_col`` (without it, of the entries); for
    display (lists are bounded by the labels per query)."""
    pairs = F.sort_array(F.collect_list(F.struct(F.col(pos_col or url_col).alias("at"), F.col(url_col).alias("url"))))
    return truth.groupBy(query_col).agg(F.transform(pairs, lambda p: p["url"]).alias("urls"))


def recall_at_k(pred: DataFrame, truth: DataFrame, k: int, key_col: str = "item_id",
                query_col: str = "query_id", rank_col: str = "rank", slug: bool = False) -> DataFrame:
    """A2: per truth query, |distinct top-k predictions ∩ distinct truth| / |distinct truth|.

    ``pred(query, key, rank)`` is cut to ``rank <= k`` *before* de-duplication (as the reference
    does); ``slug=True`` compares URL slugs instead of raw keys.  A query with no predictions gets 0.
    """
    kp = (lambda c: url_slug(F.col(c))) if slug else (lambda c: F.col(c))
    t = truth.select(F.col(query_col).alias("q"), kp(key_col).alias("key")).where("key is not null").distinct()
    p = (pred.where(F.col(rank_col) <= k)
         .select(F.col(query_col).alias("q"), kp(key_col).alias("key")).distinct()
         .withColumn("hit", F.lit(1)))
    return (t.join(p, ["q", "key"], "left")
            .groupBy("q")
            .agg((F.count("hit") / F.count(F.lit(1))).alias("recall"))
            .withColumnRenamed("q", query_col))


def mean_recall(per_query: DataFrame, truth_queries: DataFrame | None = None,
                query_col: str = "query_id") -> DataFrame:
    """A3: mean of per-query recall; a truth query missing from ``per_query`` counts 0; none -> 0.0."""
    r = per_query
    if truth_queries is not None:
        r = (truth_queries.select(query_col).distinct()
             .join(per_query, query_col, "left").fillna({"recall": 0.0}))
    return r.agg(F.coalesce(F.avg("recall"), F.lit(0.0)).alias("mean_recall"),
                 F.count(F.lit(1)).alias("n_queries"))
