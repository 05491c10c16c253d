"""Okapi BM25 as plain tables: postings, term statistics, corpus statistics, scores, top-k.

Plan shape (see ``explain``):

* postings  = per item, its terms with their counts, counted where the text is read (an item is one
  row), then shuffled by item in that packed form and written once as a table bucketed by item.  No
  raw text is shuffled.
* term stats = postings -> partial count -> shuffle on term -> df, idf (on a 1e-9 fixed-point grid).
  A very common term is one row here, never a hot partition: the count is pre-aggregated map-side.
* corpus stats = item count, token total and mean idf: one row, folded in as literals.
* scores = query terms (small, size-checked broadcast; else a shuffle join with AQE skew split on
  hot terms) joined to postings on term -> sum per (query, item), with no shuffle: a bucket holds
  all postings of its items.
* top-k = row_number per query; Catalyst's WindowGroupLimit keeps only k rows per query and
  bucket before the one shuffle, on query id.
"""

from __future__ import annotations

import contextlib
import math
import weakref
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rankframe import schemas as S
from rankframe.functions.text import tokenize_ascii
from rankframe.session import cut_lineage, join_unbroadcast, scratch_path

QUERY_SIDE_BROADCAST_ROWS = 500_000
#: Query terms beyond this are cut to those of the vocabulary by a shuffle before any of them is broadcast.
QUERY_TERMS_UNCUT = 100_000
MAX_SCORING_PASSES = 4
#: Tokens whose terms are counted at a time in a task, however long the items of an Arrow batch are.
SLICE_TOKENS = 1 << 17


@dataclass
class Bm25Index:
    postings: DataFrame      # (item_id, dl, term, tf); all rows of one item in one partition
    term_stats: DataFrame    # (term, df, idf)
    n_items: int
    total_tokens: int
    avg_idf: float
    id_col: str
    k1: float = S.BM25_K1
    b: float = S.BM25_B
    packed: DataFrame | None = None  # (item_id, dl, postings): one row per item

    @property
    def avgdl(self) -> float:
        return self.total_tokens / self.n_items if self.n_items else 0.0


def _token_slices(batch):
    """Slices of an Arrow batch (item_id, tokens) with about SLICE_TOKENS tokens, one row at least."""
    ends = np.cumsum(pc.fill_null(pc.list_value_length(batch.column(1)), 0).to_numpy(zero_copy_only=False))
    begin = 0
    while begin < batch.num_rows:
        done = ends[begin - 1] if begin else 0
        stop = max(begin + 1, int(np.searchsorted(ends, done + SLICE_TOKENS, "right")))
        yield batch.slice(begin, stop - begin)
        begin = stop


def _count_terms(batches):
    """Arrow batches (item_id, tokens) -> (item_id, dl, postings): each item's distinct terms with their counts."""
    for batch in (part for whole in batches for part in _token_slices(whole)):
        tokens = batch.column(1)
        flat = pa.table({"row": pc.list_parent_indices(tokens), "term": pc.list_flatten(tokens)})
        counted = flat.group_by(["row", "term"]).aggregate([([], "count_all")]).sort_by("row")
        per_row = np.bincount(counted.column("row").to_numpy(), minlength=batch.num_rows)
        pairs = pa.StructArray.from_arrays([counted.column("term").combine_chunks(), counted.column("count_all").combine_chunks()], ["term", "tf"])
        lists = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(per_row)]).astype(np.int32), pairs)
        dl = pc.fill_null(pc.list_value_length(tokens), 0).cast(pa.int32())
        yield pa.RecordBatch.from_arrays([batch.column(0), dl, lists], names=["item_id", "dl", "postings"])


def packed_postings(items: DataFrame, id_col: str, text_col: str, tokenizer=tokenize_ascii) -> DataFrame:
    """``(item_id, dl, postings)``: each item's token count and distinct terms with their counts, counted where the text is read."""
    kind = items.schema[id_col].dataType.simpleString()
    toks = items.select(F.col(id_col).alias("item_id"), tokenizer(F.col(text_col)).alias("tokens"))
    return toks.mapInArrow(_count_terms, f"item_id {kind}, dl int, postings array<struct<term:string,tf:bigint>>")


def term_statistics(df: DataFrame, n_items: int, epsilon: float = S.BM25_EPSILON, materialize: bool = True) -> tuple[DataFrame, float]:
    """``(term, df, idf)`` from ``(term, df)``, and the mean idf before the floor.

    idf lies on the 1e-9 fixed-point grid: the only transcendental step (log) is rounded once per term,
    so every later product and sum has bit-identical inputs on any engine and partitioning; the mean for
    the epsilon floor is then an exact integer sum over the vocabulary.
    """
    raw = df.withColumn("raw_fp", F.floor((F.log(F.lit(n_items) - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)) * F.lit(1e9) + F.lit(0.5)))
    if materialize:
        raw = cut_lineage(raw, "bm25-terms")
    agg = raw.agg(F.sum("raw_fp").alias("s"), F.count(F.lit(1)).alias("c")).first()
    avg_fp = (agg["s"] / agg["c"]) if agg["c"] else 0.0
    floor_fp = math.floor(epsilon * avg_fp + 0.5)
    idf = F.when(F.col("raw_fp") < 0, F.lit(floor_fp)).otherwise(F.col("raw_fp")) / F.lit(1e9)
    return raw.select("term", "df", idf.alias("idf")), float(avg_fp / 1e9)


def bm25_index(items: DataFrame, id_col: str, text_col: str = "text", tokenizer=tokenize_ascii,
               epsilon: float = S.BM25_EPSILON, k1: float = S.BM25_K1, b: float = S.BM25_B,
               materialize: bool = True) -> Bm25Index:
    """A4: build the index tables from ``items(id_col, text_col)``; item ids must be unique.

    The packed postings are written once to the shared checkpoint folder, bucketed by item, so the
    text is tokenised exactly once however many statistics and queries read the index.  The corpus
    statistics are three numbers (item count, token total, mean raw idf) read back as one row.
    """
    spark = items.sparkSession
    n_items, n_ids = items.agg(F.count(F.lit(1)), F.count_distinct(id_col)).first()
    if n_items != n_ids:
        raise ValueError(f"{id_col} must identify an item: {n_items} items, {n_ids} ids")
    packed = packed_postings(items, id_col, text_col, tokenizer)
    if materialize:
        buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        path = scratch_path(spark, "bm25-postings")
        name = "bm25_" + path.rsplit("-", 1)[-1]
        (packed.repartition(buckets, "item_id").write.bucketBy(buckets, "item_id").option("path", path)
         .format("parquet").saveAsTable(name))
        packed = spark.table(name)
    postings = packed.select("item_id", "dl", F.inline("postings"))
    total = packed.agg(F.coalesce(F.sum("dl"), F.lit(0))).first()[0]
    term_stats, avg_idf = term_statistics(postings.groupBy("term").agg(F.count(F.lit(1)).alias("df")), n_items, epsilon, materialize)
    index = Bm25Index(postings, term_stats, n_items, int(total), avg_idf, id_col, k1, b, packed)
    if materialize:
        weakref.finalize(index, _forget_table, spark, name)  # its files go with the scratch folder
    return index


def _forget_table(spark, name: str) -> None:
    with contextlib.suppress(Exception):  # the session may have ended
        spark.sql(f"DROP TABLE IF EXISTS {name}")


def query_terms(queries: DataFrame, qid: str, qtext: str, tokenizer=tokenize_ascii) -> DataFrame:
    """Distinct query terms with their repeat count ``qf`` (a repeated term counts again)."""
    return (queries.select(F.col(qid).alias("query_id"), F.explode(tokenizer(F.col(qtext))).alias("term"))
            .groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("qf")))


def bm25_scores(queries: DataFrame, index: Bm25Index, qid: str = "query_id", qtext: str = "query",
                tokenizer=tokenize_ascii, query_side_rows: int = QUERY_SIDE_BROADCAST_ROWS) -> DataFrame:
    """``(query_id, item_id, score)`` for every item sharing at least one term with the query."""
    # query terms are written once and size-checked; when small they are broadcast into the join with
    # the vocabulary-sized term table and the (no larger) result is broadcast into the postings
    # join, so neither the term table nor the postings are shuffled
    qterms = cut_lineage(query_terms(queries, qid, qtext, tokenizer), "query-terms")
    terms = index.term_stats.select("term", "idf")
    n_qt = qterms.count()
    if n_qt > QUERY_TERMS_UNCUT:
        qterms = cut_lineage(join_unbroadcast(qterms, terms, "term"), "query-terms-known")
        n_qt = qterms.count()

    def valued(qt: DataFrame) -> DataFrame:
        return qt if "idf" in qt.columns else terms.join(F.broadcast(qt), "term")

    if n_qt <= query_side_rows:
        return _score_block(index, F.broadcast(valued(qterms)))
    # a few broadcastable blocks (split by query, so a query's terms stay together): each block is
    # one pass over the postings read in place, which beats shuffling every posting by term
    n_blocks = -(-n_qt * 2 // query_side_rows)  # ~half the bound per block leaves room for hash skew
    if n_blocks <= MAX_SCORING_PASSES:
        blocks = qterms.withColumn("_blk", F.pmod(F.xxhash64("query_id"), F.lit(n_blocks)))
        largest = blocks.groupBy("_blk").count().agg(F.max("count")).first()[0]
        if largest <= query_side_rows:
            parts = [_score_block(index, F.broadcast(valued(blocks.where(F.col("_blk") == i).drop("_blk")))) for i in range(n_blocks)]
            return reduce(lambda x, y: x.unionByName(y), parts)
    return _score_block(index, qterms if "idf" in qterms.columns else qterms.join(terms, "term"))


def _score_block(index: Bm25Index, qt: DataFrame) -> DataFrame:
    """Join query terms (with idf) to the postings and sum the fixed-point contributions."""
    k1, b = index.k1, index.b
    tf, dl = F.col("tf"), F.col("dl")
    avgdl = F.lit(index.avgdl)
    contrib = (F.col("qf") * F.col("idf") * tf * F.lit(k1 + 1)
               / (tf + F.lit(k1) * (F.lit(1 - b) + F.lit(b) * dl / avgdl)))
    return (index.postings.join(qt, "term")
            .groupBy("query_id", "item_id").agg(F.sum(fixed_point(contrib)).alias("score_fp"))
            .select("query_id", "item_id", (F.col("score_fp") / F.lit(SCALE)).alias("score")))


# Scores are accumulated as integers at 1e-9 resolution: the sum is then exact and independent of
# the order in which partitions and terms are added, so every engine and every partitioning gives
# bit-identical scores and a stable total order.
SCALE = 1_000_000_000


def fixed_point(x):
    return F.floor(x * F.lit(float(SCALE)) + F.lit(0.5))


def order_key(score_col: str = "score"):
    """Total order for ranked lists: score descending (ties broken by the caller's id column)."""
    return F.col(score_col).desc()


def topk(df: DataFrame, k: int, part: str = "query_id", order=None, rank_col: str = "rank") -> DataFrame:
    """Per-``part`` top-k by ``order`` (list of sort expressions) with a ``rank`` column from 1."""
    w = Window.partitionBy(part).orderBy(*order)
    return df.withColumn(rank_col, F.row_number().over(w)).where(F.col(rank_col) <= k)


def bm25_topk(scores: DataFrame, k: int = S.TOP_K_RETRIEVAL, positive_only: bool = True) -> DataFrame:
    """R2(a): top-k items per query, only positive scores, ties by item id."""
    if positive_only:
        scores = scores.where(F.col("score") > 0)
    return topk(scores, k, order=[order_key(), F.col("item_id").asc()])


def id_ranks(items: DataFrame, id_col: str) -> DataFrame:
    """``(item_id, nth)``: each id with its place among all ids, from 1, without one task holding them all.

    Ids are dealt into ranges by their quantiles; a range's places begin after the rows of those before.
    """
    spark = items.sparkSession
    ids = items.select(F.col(id_col).alias("item_id"))
    n = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = ids.agg(F.percentile_approx("item_id", [i / n for i in range(1, n)], 10 * n)).first()[0] or []
    cuts = sorted(set(cuts))
    at = F.size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: c <= F.col("item_id"))) if cuts else F.lit(0)
    ids = ids.withColumn("range", at)
    before = ids.groupBy("range").agg(F.count(F.lit(1)).alias("rows")).select(
        F.col("range").alias("b_range"),
        F.coalesce(F.sum("rows").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    within = F.row_number().over(Window.partitionBy("range").orderBy("item_id"))
    return (ids.withColumn("own", within).join(before, F.col("range") == F.col("b_range"))
            .select("item_id", (F.col("before") + F.col("own")).alias("nth")))


def bm25_topk_padded(scores: DataFrame, queries: DataFrame, items: DataFrame, id_col: str, k: int,
                     qid: str = "query_id") -> DataFrame:
    """R2(b): top-k over *all* items, items without a shared term scoring 0 (ties by item id).

    Scores may be negative (the idf floor takes the sign of the mean idf): those rank behind the
    items without a shared term.  Without a Q x N product: only a query with fewer than k positive
    items needs others, and with m scored items its k first unscored ids are among the k + m
    smallest ids, so what is looked at is in proportion to the scores themselves.
    """
    per = scores.groupBy("query_id").agg(F.count(F.lit(1)).alias("m"), F.count_if(F.col("score") > 0).alias("positive"))
    need = (queries.select(F.col(qid).alias("query_id")).distinct().join(per, "query_id", "left").fillna(0, ["m", "positive"])
            .where(F.col("positive") < k))
    places = need.select("query_id", F.explode(F.sequence(F.lit(1).cast("long"), F.col("m") + k)).alias("nth"))
    pads = (places.join(id_ranks(items, id_col), "nth")
            .join(scores.select("query_id", "item_id"), ["query_id", "item_id"], "left_anti")
            .select("query_id", "item_id", F.lit(0.0).alias("score")))
    both = scores.select("query_id", "item_id", "score").unionByName(pads)
    return topk(both, k, order=[order_key(), F.col("item_id").asc()])
