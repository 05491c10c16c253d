"""Exact "text contains passage" pairs without a passages x documents product.

If passage P occurs in document D then every *interior* token of P (every token but the first and
the last, which may be cut parts of longer words in D) is also a whole token of D: the lower-casing
and the tokenizer work character by character.  So each passage is joined, through its
rarest interior token (lowest document frequency), to the postings of that one token; only those
candidate documents are checked with ``contains`` on the whole texts.  Passages with fewer than
three tokens have no interior token and are checked against every document (bounded, size-checked
broadcast of those few passages).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankframe.functions.text import tokenize_ascii
from rankframe.operators.bm25 import Bm25Index
from rankframe.session import broadcast_if_small, cut_lineage

SHORT_PASSAGE_BROADCAST_ROWS = 100_000
CANDIDATE_BROADCAST_ROWS = 1_000_000


def passage_matches(passages: DataFrame, docs: DataFrame, index: Bm25Index, pid: str, ptext: str,
                    did: str, dtext: str) -> DataFrame:
    """``(query_id, item_id)`` for every document whose text contains the passage text."""
    p = passages.select(F.col(pid).alias("query_id"), F.col(ptext).alias("ptext"),
                        tokenize_ascii(F.col(ptext)).alias("ptoks"))
    interior = (p.where(F.size("ptoks") >= 3)
                .select("query_id", F.explode(F.slice("ptoks", 2, F.size("ptoks") - 2)).alias("term"))
                .distinct())
    # rarest interior token per passage (ties: smallest term); an unknown token means no match at all
    interior = cut_lineage(interior, "interior-terms")
    # an inner join, so that the side of the passages is the one that can be broadcast; a passage with
    # a token that no document has cannot match
    tokens = interior.groupBy("query_id").agg(F.count(F.lit(1)).alias("tokens"))
    found = (index.term_stats.select("term", "df").join(interior, "term").groupBy("query_id")
             .agg(F.min_by("term", F.struct("df", "term")).alias("anchor"), F.min("df").alias("anchor_df"), F.count(F.lit(1)).alias("known")))
    anchored = found.join(tokens, "query_id").where("known = tokens").select("query_id", "anchor", "anchor_df")
    cand = (anchored.join(index.postings.select(F.col("term").alias("anchor"), "item_id"), "anchor")
            .select("query_id", "item_id"))
    texts = docs.select(F.col(did).alias("item_id"), F.col(dtext).alias("dtext"))
    # the candidate side is small (rarest-token postings): broadcast it after a size check so the
    # document texts are scanned in place, never shuffled; beyond the bound a shuffle join on item
    # (ids only: 16 bytes a pair); passage texts come from the passages table, itself size-checked.
    # The candidate count is known exactly without touching the postings: the sum of anchor dfs.
    n_cand = anchored.agg(F.coalesce(F.sum("anchor_df"), F.lit(0))).first()[0]
    pairs = F.broadcast(cand) if n_cand <= CANDIDATE_BROADCAST_ROWS else cand
    # one count of the passages bounds both passage-side broadcasts below (short ones are a subset)
    few = passages.limit(SHORT_PASSAGE_BROADCAST_ROWS + 1).count() <= SHORT_PASSAGE_BROADCAST_ROWS
    ptexts = p.select("query_id", "ptext")
    ptexts = F.broadcast(ptexts) if few else ptexts
    long_hits = (texts.join(pairs, "item_id").join(ptexts, "query_id")
                 .where(F.col("dtext").contains(F.col("ptext")))
                 .select("query_id", "item_id"))
    short = p.where(F.size("ptoks") < 3).select("query_id", "ptext")
    if short.isEmpty():
        return long_hits
    short = F.broadcast(short) if few else broadcast_if_small(short, SHORT_PASSAGE_BROADCAST_ROWS)
    short_hits = (texts.join(short, F.col("dtext").contains(F.col("ptext")))
                  .select("query_id", "item_id"))
    return long_hits.unionByName(short_hits)
