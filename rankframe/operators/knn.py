"""Exact dense top-k (R1/J3) and the embedding operators.

Four exact plans, equal results (tested):

* ``method="broadcast"`` (chosen by ``auto`` when the query side is small, checked by count and
  dimension): the query matrix is broadcast once and ``mapInPandas`` scores each item partition in
  place -- items are never shuffled -- keeping a running top-k per query across the partition's
  Arrow batches, so one partition emits at most k rows per query.
* ``method="crossed"`` (chosen for more queries than a block): vectors are packed, thousands to a row, and a
  cartesian product brings every pack of items past every block of queries.  A task holds one block of queries
  with their running top-k and reads the items as a stream, so neither side is copied by a shuffle and k rows
  per query (times the item parts, few) leave the tasks.
* ``method="blocked"``: items are hashed into item blocks and queries into query
  blocks; each item row is copied once per query block and each query row once per item block, and
  ``cogroup(...).applyInPandas`` multiplies one query block by one item block with numpy and keeps
  a local top-k per query.  A final window keeps the global top-k (<= k x item-blocks rows per
  query reach it).  Block counts come from two cheap counts, so every cell is bounded in memory and
  the Q x N similarity matrix is never materialised anywhere.
* ``method="sql"``: a size-checked broadcast of the query side, a nested-loop join with the dot
  product as a higher-order function, and a row_number window (WindowGroupLimit pushes the cut
  below the shuffle).  Only for small query tables.

Similarities are cut to 1e-9 fixed point before ordering, ties by item id: a total order that is
the same in every partitioning.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rankframe.functions.text import tokenize_ascii
from rankframe.functions.vectors import dot, l2_normalize
from rankframe.session import broadcast_if_small, cut_lineage

SCALE = 1_000_000_000
ITEM_BLOCK_ROWS = 20_000
QUERY_BLOCK_ROWS = 20_000
QUERY_CHUNK = 256
ITEM_CHUNK = 2048
RESCORED = 16_384
PACK_ROWS = 4096
SQL_QUERY_ROWS = 10_000
BROADCAST_QUERY_ROWS = 16_384
BROADCAST_QUERY_BYTES = 16 * 1024 * 1024
MAX_KNN_PASSES = 4
EXCLUDED_FP = -(1 << 40)  # below any fixed-point similarity, small enough to shift without overflow


class _RunningTopK:
    """The k most similar items of each of a block of queries, over chunks of items that arrive one after another.

    A product in single precision finds the pairs that may reach a query's k-th similarity (its rounding error is
    allowed for); only these are computed again in double precision, cut to fixed point and merged, so the result
    is exact and little beside the products grows with queries x items.
    """

    def __init__(self, qids: np.ndarray, qmat: np.ndarray, k: int, exclude_self: bool):
        self.qids, self.q, self.q32, self.k, self.exclude_self = qids, qmat, qmat.astype(np.float32), k, exclude_self
        self.fp = np.full((len(qids), k), EXCLUDED_FP)  # best first, ties by id
        self.iid = np.full((len(qids), k), np.iinfo(np.int64).max)
        self.least = np.full(len(qids), -np.inf)  # similarities below cannot enter
        self.slack = np.linalg.norm(qmat, axis=1) * (qmat.shape[1] + 4) * 2.0 ** -23
        self.found, self.n_found = [], 0

    def add(self, iids: np.ndarray, imat: np.ndarray) -> None:
        for a in range(0, len(iids), ITEM_CHUNK):
            ids, x = iids[a:a + ITEM_CHUNK], imat[a:a + ITEM_CHUNK]
            order = np.argsort(ids, kind="stable")
            ids, x = ids[order], x[order]
            turned, reach = np.ascontiguousarray(x.astype(np.float32).T), np.linalg.norm(x, axis=1).max()
            for s in range(0, len(self.qids), QUERY_CHUNK):
                self._meet(slice(s, s + QUERY_CHUNK), ids, x, turned, reach)
            if self.n_found > self.fp.size // 2:
                self._merge()

    def _meet(self, at: slice, ids, x, turned, reach) -> None:
        sims, n = self.q32[at] @ turned, len(ids)
        if self.exclude_self:
            first, end = np.searchsorted(ids, self.qids[at], "left"), np.searchsorted(ids, self.qids[at], "right")
            for r in np.flatnonzero(end > first):
                sims[r, first[r]:end[r]] = -np.inf
        slack = self.slack[at] * reach
        least, unfilled = self.least[at] - slack, np.isneginf(self.least[at])
        if unfilled.any() and n > self.k:
            least[unfilled] = np.partition(sims[unfilled], n - self.k, axis=1)[:, n - self.k] - 2 * slack[unfilled]
        least = np.nextafter(np.maximum(least, -1e38).astype(np.float32), np.float32(-np.inf))
        may = (sims >= least[:, None]).ravel()
        if may.size % 8:
            hit = np.flatnonzero(may)
        else:  # nearly all are false: look at eight together
            words = np.flatnonzero(may.view(np.uint64))
            hit = (words[:, None] * 8 + np.arange(8))[may.reshape(-1, 8)[words]]
        for a in range(0, len(hit), RESCORED):
            row, col = hit[a:a + RESCORED] // n + at.start, hit[a:a + RESCORED] % n
            fp = np.floor(np.einsum("ij,ij->i", self.q[row], x[col]) * SCALE + 0.5).astype(np.int64)
            last, own = self.fp[row, -1], ids[col]
            enters = (fp > last) | ((fp == last) & (own < self.iid[row, -1]))
            self.found.append((row[enters], fp[enters], own[enters]))
            self.n_found += int(enters.sum())
            if self.n_found > 2 * self.fp.size + RESCORED:
                self._merge()

    def _merge(self) -> None:
        if not self.n_found:
            self.found = []
            return
        row, fp, iid = (np.concatenate(c) for c in zip(*self.found))
        self.found, self.n_found = [], 0
        own = np.unique(row)
        row = np.concatenate([np.repeat(own, self.k), row])
        fp, iid = np.concatenate([self.fp[own].ravel(), fp]), np.concatenate([self.iid[own].ravel(), iid])
        order = np.lexsort((iid, -fp, row))
        row = row[order]
        begin = np.searchsorted(row, own)
        keep = order[(begin[:, None] + np.arange(self.k)).ravel()]
        self.fp[own], self.iid[own] = fp[keep].reshape(-1, self.k), iid[keep].reshape(-1, self.k)
        full = own[self.fp[own, -1] != EXCLUDED_FP]
        self.least[full] = (self.fp[full, -1] - 0.5) / SCALE - 1e-12

    def rows(self) -> pd.DataFrame:
        self._merge()
        r, c = np.nonzero(self.fp != EXCLUDED_FP)
        return pd.DataFrame({"query_id": self.qids[r], "item_id": self.iid[r, c], "sim_fp": self.fp[r, c]})


def _doubles(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.float64)


def _local_topk_fn(k: int, exclude_self: bool):
    def fn(qpdf: pd.DataFrame, ipdf: pd.DataFrame) -> pd.DataFrame:
        if len(qpdf) == 0 or len(ipdf) == 0:
            return pd.DataFrame({"query_id": pd.Series([], dtype="int64"),
                                 "item_id": pd.Series([], dtype="int64"),
                                 "sim_fp": pd.Series([], dtype="int64")})
        best = _RunningTopK(qpdf["qid"].to_numpy(dtype=np.int64), _doubles(qpdf["v"]), k, exclude_self)
        best.add(ipdf["iid"].to_numpy(dtype=np.int64), _doubles(ipdf["v"]))
        return best.rows()
    return fn


def _partition_topk_fn(qids: np.ndarray, qmat_bc, k: int, exclude_self: bool):
    """mapInPandas body: items of one partition against the broadcast query matrix, keeping a
    running top-k per query across the partition; emitted once at the end."""
    def run(it):
        best = None
        for pdf in it:
            if len(pdf):
                best = best or _RunningTopK(qids, qmat_bc.value, k, exclude_self)
                best.add(pdf["iid"].to_numpy(dtype=np.int64), _doubles(pdf["v"]))
        if best:
            yield best.rows()
    return run


def _packed(df: DataFrame, id_col: str) -> DataFrame:
    """(pack, ids, m): the rows (id, v) as packs of at most PACK_ROWS, numbered in their partition, ids and vectors as bytes."""
    def run(it):
        n = 0
        for pdf in it:
            for a in range(0, len(pdf), PACK_ROWS):
                part = pdf.iloc[a:a + PACK_ROWS]
                yield pd.DataFrame({"pack": [n], "ids": [part[id_col].to_numpy(dtype=np.int64).tobytes()], "m": [_doubles(part["v"]).tobytes()]})
                n += 1
    return df.select(id_col, "v").mapInPandas(run, "pack long, ids binary, m binary")


def _crossed_topk_fn(k: int, exclude_self: bool):
    """mapInPandas body: all packs of items that pass, each with every pack of queries of the task."""
    def run(it):
        kept: dict[int, _RunningTopK] = {}
        for pdf in it:
            for pack, qids, qm, iids, im in zip(pdf["pack"], pdf["qids"], pdf["qm"], pdf["iids"], pdf["im"]):
                if pack not in kept:
                    ids = np.frombuffer(qids, np.int64).copy()
                    kept[pack] = _RunningTopK(ids, np.frombuffer(qm).reshape(len(ids), -1).copy(), k, exclude_self)
                ids = np.frombuffer(iids, np.int64)
                kept[pack].add(ids, np.frombuffer(im).reshape(len(ids), -1))
        for best in kept.values():
            yield best.rows()
    return run


def knn(queries: DataFrame, items: DataFrame, k: int, qid: str = "query_id", iid: str = "item_id",
        qvec: str = "embedding", ivec: str = "embedding", exclude_self: bool = False,
        method: str = "auto", normalize: bool = True) -> DataFrame:
    """``(query_id, item_id, rank, sim)`` — the k most similar items per query, exact.

    Vectors are L2-normalised first (``normalize=True``), so ``sim`` is the cosine / inner product
    of unit vectors.  ``exclude_self`` drops the pair ``query_id == item_id`` (self-search).
    ``method``: ``auto`` picks ``broadcast`` when the query matrix is under BROADCAST_QUERY_BYTES
    (checked from the row count and dimension), a few passes of it, ``blocked`` for one block of queries,
    else ``crossed``; ``sql`` for small query sides.
    """
    q = queries.select(F.col(qid).alias("qid"), F.col(qvec).alias("v"))
    i = items.select(F.col(iid).alias("iid"), F.col(ivec).alias("v"))
    if normalize:
        q, i = l2_normalize(q, "v"), l2_normalize(i, "v")
    if method in ("auto", "passes"):
        # the row bound follows from the vector dimension, so at most BROADCAST_QUERY_BYTES of query
        # vectors ever reach the driver per block
        first = q.select(F.size("v").alias("d")).limit(1).collect()
        dim = max(1, first[0]["d"]) if first else 1
        bound = max(1, min(BROADCAST_QUERY_ROWS, BROADCAST_QUERY_BYTES // (8 * dim)))
    if method == "auto":
        method = "broadcast" if q.select("qid").limit(bound + 1).count() <= bound else "passes"
    if method == "passes":
        # a query side a few times the bound: split it by query into blocks that each fit, and run
        # one broadcast pass per block over the items read in place (items are never shuffled)
        nq = q.count()
        n_blocks = -(-2 * nq // bound)
        blocks = []
        if n_blocks <= MAX_KNN_PASSES:
            keyed = q.withColumn("_blk", F.pmod(F.xxhash64("qid"), F.lit(n_blocks)))
            for b_i in range(n_blocks):
                part = keyed.where(F.col("_blk") == b_i).drop("_blk").limit(bound + 1).toPandas()
                if len(part) > bound:
                    blocks = []
                    break
                blocks.append(part)
        if blocks:
            cands = []
            for part in blocks:
                if len(part) == 0:
                    continue
                bc = queries.sparkSession.sparkContext.broadcast(np.stack(part["v"].to_numpy()).astype(np.float64))
                cands.append(i.mapInPandas(_partition_topk_fn(part["qid"].to_numpy(dtype=np.int64), bc, k, exclude_self),
                                           schema="query_id long, item_id long, sim_fp long"))
            cand = reduce(lambda x, y: x.unionByName(y), cands)
            method = "done"
        else:
            # one block of queries: items are shuffled once; more of them would copy the items for each
            method = "blocked" if nq <= QUERY_BLOCK_ROWS else "crossed"
    if method == "broadcast":
        qp = q.toPandas()
        if len(qp) == 0:
            return queries.sparkSession.createDataFrame([], "query_id long, item_id long, rank int, sim double")
        qids = qp["qid"].to_numpy(dtype=np.int64)
        qmat = np.stack(qp["v"].to_numpy()).astype(np.float64)
        bc = queries.sparkSession.sparkContext.broadcast(qmat)
        cand = i.mapInPandas(_partition_topk_fn(qids, bc, k, exclude_self),
                             schema="query_id long, item_id long, sim_fp long")
    elif method == "sql":
        pairs = i.crossJoin(broadcast_if_small(q.withColumnRenamed("v", "qv"), SQL_QUERY_ROWS))
        if exclude_self:
            pairs = pairs.where(F.col("qid") != F.col("iid"))
        cand = pairs.select(F.col("qid").alias("query_id"), F.col("iid").alias("item_id"),
                            F.floor(dot("qv", "v") * F.lit(float(SCALE)) + F.lit(0.5)).alias("sim_fp"))
    elif method == "done":
        pass
    elif method == "blocked":
        nq, ni = q.count(), i.count()
        if nq == 0 or ni == 0:
            return queries.sparkSession.createDataFrame(
                [], "query_id long, item_id long, rank int, sim double")
        par = queries.sparkSession.sparkContext.defaultParallelism
        bq = max(1, math.ceil(nq / QUERY_BLOCK_ROWS))
        bi = max(math.ceil(ni / ITEM_BLOCK_ROWS), min(ni, max(1, par // bq)))
        qb = (q.withColumn("qb", F.pmod(F.xxhash64("qid"), F.lit(bq)))
              .withColumn("ib", F.explode(F.sequence(F.lit(0), F.lit(bi - 1)))))
        ib = (i.withColumn("ib", F.pmod(F.xxhash64("iid"), F.lit(bi)))
              .withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(bq - 1)))))
        cand = (qb.groupBy("qb", "ib").cogroup(ib.groupBy("qb", "ib"))
                .applyInPandas(_local_topk_fn(k, exclude_self),
                               schema="query_id long, item_id long, sim_fp long"))
    elif method == "crossed":
        spark = queries.sparkSession
        nq, width = q.count(), spark.sparkContext.defaultParallelism
        blocks = max(1, math.ceil(nq / QUERY_BLOCK_ROWS))
        packs = cut_lineage(_packed(i, "iid"), "knn-items").select(F.col("ids").alias("iids"), F.col("m").alias("im"))
        # a task holds one block of queries and reads the items past it, all or (with few blocks) a part of them
        packs = packs.repartition(-(-2 * width // blocks)) if blocks < 2 * width else packs.coalesce(1)
        asked = _packed(q.repartition(blocks, F.xxhash64("qid")), "qid")
        asked = asked.select("pack", F.col("ids").alias("qids"), F.col("m").alias("qm"))
        cand = (packs.hint("shuffle_replicate_nl").crossJoin(asked)
                .mapInPandas(_crossed_topk_fn(k, exclude_self), schema="query_id long, item_id long, sim_fp long"))
    else:
        raise ValueError(f"unknown method {method!r}")
    w = Window.partitionBy("query_id").orderBy(F.col("sim_fp").desc(), F.col("item_id").asc())
    return (cand.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
            .select("query_id", "item_id", "rank", (F.col("sim_fp") / F.lit(float(SCALE))).alias("sim")))


def hash_embed(df: DataFrame, id_col: str, text_col: str, dim: int = 64, tokenizer=tokenize_ascii,
               out: str = "embedding") -> DataFrame:
    """Signed feature hashing of the tokens, L2-normalised; needs no model.

    slot = (first 8 hex digits of md5(term)) mod dim; sign = +1 when the next 8 hex digits are even.
    One vector per row, also where ids repeat.  The per-(row, slot) sum is pre-aggregated where the text is read (a text of any length leaves
    its task as at most ``dim`` rows), then the row's list, bounded by ``dim``, becomes the vector.
    An item without tokens gets the zero vector (``explode_outer``; no join back to the ids).
    """
    h1 = F.conv(F.substring(F.md5("term"), 1, 8), 16, 10).cast("long")
    h2 = F.conv(F.substring(F.md5("term"), 9, 8), 16, 10).cast("long")
    src = df.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.col(text_col).alias("_t"))
    toks = (src.select("row", "id", F.explode_outer(tokenizer(F.col("_t"))).alias("term"))
            .select("row", "id", F.pmod(h1, F.lit(dim)).alias("slot"),
                    F.when(F.pmod(h2, F.lit(2)) == 0, F.lit(1)).otherwise(F.lit(-1)).alias("sgn")))
    slots = toks.groupBy("row", "id", "slot").agg(F.sum("sgn").cast("double").alias("val"))
    m = slots.groupBy("row", "id").agg(F.map_from_entries(F.collect_list(
        F.when(F.col("slot").isNotNull(), F.struct("slot", "val")))).alias("m"))
    vec = m.select(F.col("id").alias(id_col),
                   F.transform(F.sequence(F.lit(0), F.lit(dim - 1)),
                               lambda s: F.coalesce(F.try_element_at(F.col("m"), s.cast("long")),
                                                    F.lit(0.0))).alias(out))
    return l2_normalize(vec, out)


def embed_batches(df: DataFrame, fn, id_col: str, text_col: str, batch_rows: int = 100,
                  task_type: str = "RETRIEVAL_DOCUMENT") -> DataFrame:
    """Batched embedding map with a user-supplied ``fn(texts, task_type) -> vectors``.

    Calls ``fn`` on ``batch_rows`` texts at a time (the reference's batch size 100), order kept;
    ``task_type`` tells a model whether it embeds documents or queries.  Output
    ``(id_col, embedding ARRAY<DOUBLE>)``.
    """
    def run(it):
        for pdf in it:
            for s in range(0, len(pdf), batch_rows):
                part = pdf.iloc[s:s + batch_rows]
                vecs = fn(part[text_col].fillna("").tolist(), task_type)
                yield pd.DataFrame({id_col: part[id_col].to_numpy(), "embedding": [list(map(float, v)) for v in vecs]})
    return df.select(id_col, text_col).mapInPandas(run, schema=f"{id_col} long, embedding array<double>")


def hashing_embedder(dim: int = 64):
    """A model-free ``fn`` for :func:`embed_batches`: the same signed feature hashing as
    :func:`hash_embed`, computed in the task with numpy (a stand-in for a hosted model)."""
    import hashlib
    import re

    tok = re.compile(r"[a-z0-9]+")

    def fn(texts, task_type="RETRIEVAL_DOCUMENT"):
        out = np.zeros((len(texts), dim))
        for r, t in enumerate(texts):
            for term in tok.findall(t.lower()):
                h = hashlib.md5(term.encode("utf-8")).hexdigest()
                out[r, int(h[:8], 16) % dim] += 1.0 if int(h[8:16], 16) % 2 == 0 else -1.0
        n = np.sqrt((out * out).sum(axis=1, keepdims=True))
        return np.where(n > 0, out / np.where(n > 0, n, 1.0), out)
    return fn
