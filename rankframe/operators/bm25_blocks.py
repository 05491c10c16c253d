"""R2/A5 without scoring every document: postings in blocks of items, blocks skipped that cannot reach the top k.

Items are dealt into blocks of BLOCK_ITEMS neighbours by their most frequent term and length, so that
a block's items are alike and its bounds tight.  The index has a row per term and
block: the items' counts, and the largest contribution (per unit of idf) that any of them makes; a
block's items are neighbours in one task, so its rows are made there and nothing is shuffled.  For
a query, the sum of its terms' largest contributions bounds every score in a block from above.

1. Bounds per (query, block), from the block rows' maxima alone.
2. The SEED_BLOCKS with the highest bounds are scored in full: the k-th best score found is a
   threshold that the true k-th best score reaches at least.
3. Of the other blocks, those whose bound reaches the threshold are scored, the rest are skipped.

So the rows are those of :func:`rankframe.operators.bm25.bm25_topk` over all scores.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rankframe.functions.text import tokenize_ascii
from rankframe.operators.bm25 import QUERY_SIDE_BROADCAST_ROWS, SCALE, SLICE_TOKENS, Bm25Index, bm25_topk, fixed_point, query_terms
from rankframe.session import broadcast_if_small, cut_lineage

#: Items of a block (a power of two).
BLOCK_ITEMS = 32
SEED_BLOCKS = 8


@dataclass
class BlockIndex:
    blocks: DataFrame       # (term, block, most, items): items are (item_id, tf, dl)
    index: Bm25Index


def _weight(index: Bm25Index, tf: np.ndarray, dl: np.ndarray) -> np.ndarray:
    """tf (k1 + 1) / (tf + k1 (1 - b + b dl / avgdl)): the contribution per unit of idf."""
    return tf * (index.k1 + 1) / (tf + index.k1 * ((1 - index.b) + index.b * dl / index.avgdl))


def _rows_of(index: Bm25Index):
    """For items (item_id, dl, postings, block): their rows (term, block, most, items)."""
    weigh = Bm25Index(None, None, index.n_items, index.total_tokens, index.avg_idf, index.id_col, index.k1, index.b)

    def run(items: pa.Table) -> pa.RecordBatch:
        items = items.combine_chunks()
        postings = items.column("postings").combine_chunks()
        row, flat = pc.list_parent_indices(postings).to_numpy(), pc.list_flatten(postings)
        terms, tf = flat.field("term").dictionary_encode(), flat.field("tf").to_numpy(zero_copy_only=False)
        dl, block = items.column("dl").to_numpy()[row], items.column("block").to_numpy()[row]
        order = np.lexsort((terms.indices.to_numpy(), block))
        code, block = terms.indices.to_numpy()[order], block[order]
        first = np.flatnonzero(np.concatenate([[True], (np.diff(code) != 0) | (np.diff(block) != 0)])) if len(order) else np.zeros(0, np.int64)
        tf, dl, row = tf[order], dl[order], row[order]
        most = np.maximum.reduceat(_weight(weigh, tf, dl), first) if len(first) else np.zeros(0)
        each = pa.StructArray.from_arrays([items.column("item_id").combine_chunks().take(pa.array(row)), pa.array(tf), pa.array(dl)], ["item_id", "tf", "dl"])
        lists = pa.ListArray.from_arrays(pa.array(np.append(first, len(order)).astype(np.int32)), each)
        return pa.RecordBatch.from_arrays([terms.dictionary.take(pa.array(code[first])), pa.array(block[first]), pa.array(most), lists], names=["term", "block", "most", "items"])
    return run


def _whole_blocks(batches):
    """Tables of whole blocks with about SLICE_TOKENS postings, one block at least, of batches whose rows are in the order of blocks."""
    held = []
    for batch in batches:
        given = pa.Table.from_batches([*held, batch])
        block = given.column("block").to_numpy()
        ends = np.flatnonzero(np.diff(block)) + 1
        size = np.cumsum(pc.list_value_length(given.column("postings")).to_numpy())
        begin = 0
        while (later := ends[ends > begin]).size:
            full = np.searchsorted(size[later - 1], (size[begin - 1] if begin else 0) + SLICE_TOKENS, "right")
            stop = int(later[max(full - 1, 0)])
            yield given.slice(begin, stop - begin)
            begin = stop
        held = given.slice(begin).to_batches()
    if held:
        yield pa.Table.from_batches(held)


def block_index(index: Bm25Index) -> BlockIndex:
    """Deal the items of ``index`` into blocks and write the block rows, block by block."""
    # a partition's rows are numbered one after the other, so neighbours in their order share a block
    row, likeness = F.monotonically_increasing_id(), F.array_max(F.transform("postings", lambda p: F.struct(p["tf"], p["term"])))["term"]
    placed = index.packed.withColumn("likeness", likeness).sortWithinPartitions("likeness", "dl", "item_id").withColumn("block", F.shiftright(row, BLOCK_ITEMS.bit_length() - 1))
    kind, rows_of = index.packed.schema["item_id"].dataType.simpleString(), _rows_of(index)

    def run(batches):
        yield from map(rows_of, _whole_blocks(batches))
    rows = placed.select("item_id", "dl", "postings", "block").mapInArrow(run, f"term string, block long, most double, items array<struct<item_id:{kind},tf:bigint,dl:int>>")
    return BlockIndex(cut_lineage(rows, "bm25-blocks"), index)


def topk_by_blocks(queries: DataFrame, blocks: BlockIndex, k: int, qid: str = "query_id", qtext: str = "query",
                   tokenizer=tokenize_ascii) -> tuple[DataFrame, DataFrame]:
    """The rows of ``bm25_topk`` (query_id, item_id, score, rank), and what was looked at (query_id, n_blocks, scored, skipped).

    n_blocks counts blocks with a term of the query.  Only positive scores; ties by item id.  Queries
    without a known term have no rows.
    """
    index = blocks.index
    terms = index.term_stats.select("term", "idf").join(broadcast_if_small(query_terms(queries, qid, qtext, tokenizer), QUERY_SIDE_BROADCAST_ROWS, True), "term")
    terms = broadcast_if_small(terms, QUERY_SIDE_BROADCAST_ROWS, True)
    met = blocks.blocks.join(terms, "term")
    # an item of a block may lack a term, so a term of negative idf bounds by 0; one more unit covers the rounding of each term
    most = F.greatest(fixed_point(F.col("qf") * F.col("idf") * F.col("most")) + 1, F.lit(0).cast("long"))
    bounds = cut_lineage(met.select("query_id", "block", most.alias("most")).groupBy("query_id", "block").agg(F.sum("most").alias("bound")), "bm25-bounds")
    highest = Window.partitionBy("query_id").orderBy(F.desc("bound"), "block")
    seeds = bounds.withColumn("nth", F.row_number().over(highest)).filter(F.col("nth") <= SEED_BLOCKS).select("query_id", "block")
    seeds = cut_lineage(seeds, "bm25-seeds")
    first = cut_lineage(_scores(met, seeds, index), "bm25-first")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "item_id")
    reached = first.withColumn("nth", F.row_number().over(best)).filter(F.col("nth") == k)
    # a row per query, and SEED_BLOCKS: the bounds, a row per query and block, are read in place
    reached = broadcast_if_small(reached.select("query_id", (F.col("score") * SCALE).alias("least")), QUERY_SIDE_BROADCAST_ROWS, True)
    others = bounds.join(reached, "query_id", "left").join(broadcast_if_small(seeds, QUERY_SIDE_BROADCAST_ROWS), ["query_id", "block"], "left_anti")
    # half a unit below the threshold, so that its way back from a double cannot skip an equal score
    others = cut_lineage(others.filter(F.col("bound") > F.coalesce(F.col("least") - 0.5, F.lit(0.0))).select("query_id", "block"), "bm25-others")
    top = bm25_topk(first.unionByName(_scores(met, others, index)), k)
    looked = (bounds.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_blocks"))
              .join(seeds.unionByName(others).groupBy("query_id").agg(F.count(F.lit(1)).alias("scored")), "query_id"))
    return top, looked.withColumn("skipped", F.col("n_blocks") - F.col("scored"))


def _scores(met: DataFrame, wanted: DataFrame, index: Bm25Index) -> DataFrame:
    """Exact scores of all items in the wanted (query_id, block)s that have a term of the query."""
    rows = met.drop("most").join(broadcast_if_small(wanted, QUERY_SIDE_BROADCAST_ROWS), ["query_id", "block"])
    rows = rows.select("query_id", "qf", "idf", F.inline("items"))
    k1, b, tf = index.k1, index.b, F.col("tf")
    # as bm25_scores has it, factor by factor, so that both round alike
    part = F.col("qf") * F.col("idf") * tf * F.lit(k1 + 1) / (tf + F.lit(k1) * (F.lit(1 - b) + F.lit(b) * F.col("dl") / F.lit(index.avgdl)))
    return (rows.groupBy("query_id", "item_id").agg(F.sum(fixed_point(part)).alias("score_fp"))
            .select("query_id", "item_id", (F.col("score_fp") / F.lit(SCALE)).alias("score")))
