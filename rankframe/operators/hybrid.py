"""Merging ranked lists from several retrievers (R3, U1, U2) and attaching item columns.

Every input is a long table ``(query_id, item_id, rank)``; ``source`` is the list's position in
the merge (0 = dense, 1 = sparse, ...).  All merges are windows partitioned by query: at most
(sources x k) rows per query, so no group grows with the corpus.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rankframe.session import broadcast_if_small

RRF_K = 60
CAND_BROADCAST_ROWS = 2_000_000


def _tagged(lists) -> DataFrame:
    parts = [l.select("query_id", "item_id", F.col("rank").alias("pos"), F.lit(s).alias("source"))
             for s, l in enumerate(lists)]
    return reduce(lambda a, b: a.unionByName(b), parts)


def merge_first(lists, mode: str = "dense_first") -> DataFrame:
    """Ordered union, distinct by item, first occurrence wins.

    ``dense_first``: every item of list 0, then unseen items of list 1, ... (order (source, pos));
    ``interleave``: round-robin over the lists (order (pos, source));
    ``rrf``: reciprocal-rank fusion, score = sum over lists of 1 / (60 + pos) (ordered at 1e-9
    fixed point), ties by item id.
    Output ``(query_id, item_id, rank, source, pos)`` (``score`` too for rrf).
    """
    u = _tagged(lists)
    if mode == "rrf":
        s = (u.groupBy("query_id", "item_id")
             .agg(F.sum(F.lit(1.0) / (F.lit(RRF_K) + F.col("pos"))).alias("score"),
                  F.min_by(F.struct("source", "pos"), F.struct("pos", "source")).alias("first")))
        w = Window.partitionBy("query_id").orderBy(
            F.floor(F.col("score") * F.lit(1e9) + F.lit(0.5)).desc(), F.col("item_id").asc())
        return s.select("query_id", "item_id", F.row_number().over(w).alias("rank"),
                        F.col("first.source").alias("source"), F.col("first.pos").alias("pos"), "score")
    order = [F.col("source"), F.col("pos")] if mode == "dense_first" else [F.col("pos"), F.col("source")]
    first = (u.withColumn("_n", F.row_number().over(Window.partitionBy("query_id", "item_id").orderBy(*order)))
             .where("_n = 1").drop("_n"))
    w = Window.partitionBy("query_id").orderBy(*order)
    return first.select("query_id", "item_id", F.row_number().over(w).alias("rank"), "source", "pos")


def merge_by_key(lists, key_col: str = "url") -> DataFrame:
    """Union keyed by ``key_col`` (e.g. URL): the first *position* of a key, the *last* value.

    Each input carries ``(query_id, item_id, rank, key_col)``; the output has one row per
    ``(query_id, key)``, placed where the key first appeared and holding the item of its last
    appearance (a dict keyed by URL filled in list order).
    """
    parts = [l.select("query_id", "item_id", key_col, F.col("rank").alias("pos"), F.lit(s).alias("source"))
             for s, l in enumerate(lists)]
    u = reduce(lambda a, b: a.unionByName(b), parts)
    g = (u.groupBy("query_id", key_col)
         .agg(F.min(F.struct("source", "pos")).alias("first"),
              F.max_by("item_id", F.struct("source", "pos")).alias("item_id")))
    w = Window.partitionBy("query_id").orderBy(F.col("first.source"), F.col("first.pos"))
    return g.select("query_id", key_col, "item_id", F.row_number().over(w).alias("rank"))


def attach_items(cands: DataFrame, items: DataFrame, item_key: str, cols) -> DataFrame:
    """Candidate rows get item columns by an equi join on the item key (never by position).

    Applied after top-k, so only surviving candidates are joined.  The candidate side (k rows per
    query) is broadcast after a size check, so the item table is read in place; beyond the bound
    both sides are shuffled on the key.
    """
    it = items.select(F.col(item_key).alias("item_id"), *cols)
    return it.join(broadcast_if_small(cands, CAND_BROADCAST_ROWS, materialize=True), "item_id", "inner")
