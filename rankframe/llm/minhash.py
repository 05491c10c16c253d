"""Near-duplicates by improved consistent weighted sampling over TF-IDF shingles.

A text is the weighted set of its five-word shingles: count times inverse document frequency.
Frequencies are counted over all documents in a sketch of fixed size; a shingle's idf is
``log(1 + 1 / (share of documents + SMOOTH))``.  The sketch's error is a share of the documents, far
below SMOOTH, at any corpus size, and so is the idf's.  Each sample of a text is a shingle and a
quantised weight, equal for two texts with the probability of their weighted Jaccard similarity.
Samples are banded; texts that share a band are candidates, and links are those of at least the
wanted weighted Jaccard similarity, computed on the whole texts.

A bucket of any size gives one pair per member: with its leader, the member whose buckets are the
fullest over all bands.  In a group of copies with edits of their own that is the common original.
Members of buckets that still hold several classes are then told apart by their rare shingles: two
texts of similarity t share a shingle among the rarest ones of either, those after which less weight
than t of the text is left.  Texts that share one, in different classes, are compared unless what
follows the shingle is too light for a link.  This misses no link of theirs, and texts that only
share what a large group shares never meet.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankframe.llm.common import NEAR, add_by_text, arrow_slices, cut_lineage, in_bitmap, key_bitmap, shuffle_width, text_of, without
from rankframe.llm.shingles import mix64, shingles

BANDS, ROWS = 16, 4
SAMPLES = BANDS * ROWS
SLOT_BITS = 16
#: A shingle of all texts weighs log(1.5) / log(2) = 0.58 of a rare one, so that a group's size hardly moves its pairs' similarity.
SMOOTH = 1.0
#: Rows of the table of random draws; a shingle's draws are those of its hash's row.
DRAW_BITS = 15
SEED = 41
#: At most so many pairs of one text meet in one task of the verification.
_PAIRS_PER_SALT = 64
#: Counters of the sketch that orders the shingles of texts in buckets of several classes.
_ORDER_BITS = 18
#: Sums of weights in another order may differ by this share.
_SLACK = 1e-9
_CHUNK = 4096


def document_frequencies(texts: DataFrame, bits: int = SLOT_BITS) -> tuple[np.ndarray, int]:
    """Documents per slot of shingle hashes, and the number of documents; each task sends 2**bits numbers at most."""
    def run(batches):
        total, n = np.zeros(1 << bits, np.int64), 0
        for batch in batches:
            for part in arrow_slices(batch, [0], 1 << 19):
                _, hashed, _ = shingles(part.column(0))
                total += np.bincount((hashed & np.uint64((1 << bits) - 1)).astype(np.int64), minlength=1 << bits)
            n += batch.num_rows
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(used, -1)), pa.array(np.append(total[used], n))], names=["slot", "n"])

    rows = texts.mapInArrow(run, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    total = np.zeros(1 << bits, np.int64)
    slot, n = rows.column("slot").to_numpy(), rows.column("n").to_numpy()
    total[slot[slot >= 0]] = n[slot >= 0]
    return total, int(n[slot < 0].sum())


def idf_table(total: np.ndarray, documents: int) -> np.ndarray:
    """idf per slot; what other shingles put into a slot on average is taken off."""
    share = np.maximum(total - total.mean(), 0) / max(documents, 1)
    return np.log1p(1 / (share + SMOOTH))


class Sampler:
    """Improved consistent weighted sampling with draws from a table of fixed size."""

    def __init__(self, idf: np.ndarray, seed: int = SEED):
        rng = np.random.default_rng(seed)
        shape = (1 << DRAW_BITS, SAMPLES)
        self.idf, self.r = idf, rng.gamma(2.0, 1.0, shape).astype(np.float32)
        self.beta = rng.random(shape, np.float32)
        self.base = np.log(rng.gamma(2.0, 1.0, shape)).astype(np.float32) - self.r

    def weights(self, hashed: np.ndarray, count: np.ndarray) -> np.ndarray:
        return count * self.idf[(hashed & np.uint64((1 << SLOT_BITS) - 1)).astype(np.int64)]

    def samples(self, text: np.ndarray, hashed: np.ndarray, count: np.ndarray, n: int) -> np.ndarray:
        """n x SAMPLES numbers, each standing for a shingle and its quantised weight; 0 for texts without shingles."""
        log_w = np.log(self.weights(hashed, count)).astype(np.float32)
        draw = ((hashed >> np.uint64(SLOT_BITS)) & np.uint64((1 << DRAW_BITS) - 1)).astype(np.int64)
        best = np.full((n, SAMPLES), np.iinfo(np.int64).max)
        for a in range(0, len(text), _CHUNK):
            part = slice(a, a + _CHUNK)
            r, beta = self.r[draw[part]], self.beta[draw[part]]
            t = np.floor(log_w[part, None] / r + beta)
            rank = (self.base[draw[part]] - r * (t - beta)).view(np.int32)
            rank ^= (rank >> 31) & np.int32(0x7FFFFFFF)  # integers in the order of the floats
            packed = (rank.astype(np.int64) << 32) | np.arange(a, a + len(r))[:, None]
            where = np.flatnonzero(np.diff(text[part], prepend=-1))
            at = text[part][where]
            best[at] = np.minimum(best[at], np.minimum.reduceat(packed, where))
        out = np.zeros((n, SAMPLES), np.uint64)
        some = best[:, 0] != np.iinfo(np.int64).max
        won = best[some] & 0xFFFFFFFF
        column = np.arange(SAMPLES)[None]
        t = np.floor(log_w[won] / self.r[draw[won], column] + self.beta[draw[won], column])
        out[some] = mix64(hashed[won] * np.uint64(SAMPLES) + t.astype(np.int64).astype(np.uint64))
        return out

    def bands(self, texts: pa.Array) -> np.ndarray:
        """n x BANDS bucket keys."""
        s = self.samples(*shingles(texts), len(texts)).reshape(len(texts), BANDS, ROWS)
        key = np.zeros(s.shape[:2], np.uint64)
        for j in range(ROWS):
            key = mix64(key + s[:, :, j])
        return key.view(np.int64)

    def similarities(self, left: pa.Array, right: pa.Array) -> np.ndarray:
        """Weighted Jaccard similarity of each pair of texts; 1 for two without shingles."""
        n, sides = len(left), []
        for texts in (left, right):
            text, hashed, count = shingles(texts)
            sides.append((text, (text.astype(np.uint64) << np.uint64(50)) | hashed, self.weights(hashed, count)))
        (ta, ka, wa), (_, kb, wb) = sides
        at = np.minimum(np.searchsorted(kb, ka), max(len(kb) - 1, 0))
        same = kb[at] == ka if len(kb) else np.zeros(len(ka), bool)
        shared = np.bincount(ta[same], np.minimum(wa[same], wb[at[same]]) if len(kb) else None, n)
        whole = np.bincount(ta, wa, n) + np.bincount(sides[1][0], wb, n) - shared
        return np.where(whole > 0, shared / np.where(whole > 0, whole, 1), 1.0)

    def rare(self, texts: pa.Array, order: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(text, shingle, left, whole): each text's rarest shingles by ``order``, as far as the weight ``left`` from
        one on, itself included, is at least ``least`` of the ``whole`` text's.  Two texts of that similarity share one."""
        text, hashed, count = shingles(texts)
        weight = self.weights(hashed, count)
        by = np.lexsort((hashed, order[(hashed & np.uint64(len(order) - 1)).astype(np.int64)], text))
        text, hashed, weight = text[by], hashed[by], weight[by]
        whole = np.bincount(text, weight, len(texts))
        before = np.cumsum(weight) - weight
        first = np.flatnonzero(np.diff(text, prepend=-1))
        left = whole[text] - (before - np.repeat(before[first], np.diff(np.append(first, len(text)))))
        keep = left >= (least - _SLACK) * whole[text] if len(text) else np.zeros(0, bool)
        return text[keep], hashed[keep].view(np.int64), left[keep], whole[text[keep]]


def _table(rows: DataFrame, name: str) -> DataFrame:
    """A written table of keys, ranks or links: far smaller than the texts, so a task takes eight shuffle partitions."""
    return cut_lineage(rows.coalesce(max(8, shuffle_width(rows.sparkSession) // 8)), name)


def _bucket_rows(nodes: DataFrame) -> DataFrame:
    """(bucket, node) for every band; texts without shingles are in none."""
    keys = F.transform("bands", lambda b, i: F.xxhash64(b, i))
    return nodes.filter("has_shingles").select(F.explode(keys).alias("bucket"), "node")


def _fullness(buckets: DataFrame) -> DataFrame:
    """Buckets of two members or more, with each member's fullness: members it shares buckets with, over all buckets.

    Most buckets hold one text; a bitmap of fixed size keeps those that surely do out of the shuffles.
    """
    size = buckets.groupBy("bucket").agg(F.count("*").alias("members")).filter("members > 1")
    size = _table(size, "near-sizes")
    some = in_bitmap(buckets, key_bitmap(size, F.col("bucket")), F.col("bucket"), "maybe").filter("maybe").drop("maybe")
    shared = _table(some.join(size, "bucket"), "near-shared")
    per = shared.groupBy("node").agg(F.sum("members").alias("fullness")).withColumnRenamed("node", "f_node")
    return shared.join(per, F.col("node") == F.col("f_node")).select("bucket", "node", "fullness")


def _leaders(members: DataFrame) -> DataFrame:
    """(t_bucket, a): per bucket the member with the greatest fullness, ties to the smallest node."""
    top = members.groupBy("bucket").agg(F.min(F.struct((-F.col("fullness")).alias("f"), "node")).alias("top"))
    return top.select(F.col("bucket").alias("t_bucket"), F.col("top.node").alias("a"))


def _leader_pairs(members: DataFrame, leaders: DataFrame) -> DataFrame:
    """Distinct (a, b), a the leader of a bucket of b."""
    pairs = members.join(leaders, F.col("bucket") == F.col("t_bucket")).filter("a <> node")
    return pairs.select("a", F.col("node").alias("b")).distinct()


def _open_members(members: DataFrame, labels: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, rep, class): the texts of buckets that hold two classes or more."""
    own = labels.select(F.col("node").alias("c_node"), "label")
    classed = members.select("bucket", "node").join(own, F.col("node") == F.col("c_node"), "left").select("bucket", "node", F.xxhash64(F.coalesce("label", "node")).alias("class"))
    classed = _table(classed, "near-classed")
    mixed = classed.groupBy("bucket").agg(F.min("class").alias("lo"), F.max("class").alias("hi")).filter("lo <> hi").select(F.col("bucket").alias("m_bucket"))
    found = classed.join(mixed, F.col("bucket") == F.col("m_bucket"), "left_semi").select(F.col("node").alias("o_node"), "class").distinct()
    return nodes.select("node", "rep").join(found, F.col("node") == F.col("o_node")).select("node", "rep", "class")


def _texts_of(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """Rows of ``texts`` that may be the text of a (node, rep) of ``wanted``: nearly all others are left out."""
    key = F.xxhash64("node", F.col("rep"))
    return in_bitmap(texts, key_bitmap(wanted, key), F.xxhash64("node", "id"), "maybe").filter("maybe").select("node", "id", "text")


def _rare_pairs(members: DataFrame, texts: DataFrame, sampler, least: float) -> DataFrame:
    """Distinct (a, b) of different classes of ``members`` (node, rep, class) that share a rare shingle and may be linked.

    Shingles of one class alone are left out first.  Members of the class that holds most of a
    shingle's texts are never paired with each other, so a large class costs no pairs of its own.
    """
    some = _texts_of(texts, members)
    order, _ = document_frequencies(some.select("text"), _ORDER_BITS)
    order = members.sparkSession.sparkContext.broadcast(order)

    def run(batches):
        model = _sampler(sampler.value)
        for batch in batches:
            for part in arrow_slices(batch, [2], 1 << 19):
                text, shingle, left, whole = model.rare(part.column(2), order.value, least)
                at = pa.array(text)
                yield pa.RecordBatch.from_arrays([part.column(0).take(at), part.column(1).take(at), pa.array(shingle), pa.array(left), pa.array(whole)],
                                                 names=["node", "id", "shingle", "remains", "whole"])

    kind = some.schema["id"].dataType.simpleString()
    rare = some.mapInArrow(run, f"node binary, id {kind}, shingle long, remains double, whole double")
    own = members.select(F.col("node").alias("o_node"), "rep", "class")
    rare = rare.join(own, (F.col("node") == F.col("o_node")) & F.col("id").eqNullSafe(F.col("rep"))).select("node", "class", "shingle", "remains", "whole")
    rare = cut_lineage(rare, "near-rare")
    per = rare.groupBy("shingle", "class").agg(F.count("*").alias("n"))
    home = per.groupBy("shingle").agg(F.max(F.struct("n", "class")).alias("most"), F.count("*").alias("classes")).filter("classes > 1")
    home = _table(home.select(F.col("shingle").alias("h_shingle"), F.col("most.class").alias("home")), "near-home")
    held = in_bitmap(rare, key_bitmap(home, F.xxhash64("h_shingle")), F.xxhash64("shingle"), "maybe").filter("maybe")
    held = held.join(home, F.col("shingle") == F.col("h_shingle")).withColumn("away", F.col("class") != F.col("home"))
    held = _table(held.select("node", "class", "shingle", "remains", "whole", "away"), "near-held")
    left, right = held.filter("away").alias("l"), held.alias("r")
    sum_ = F.col("l.whole") + F.col("r.whole")
    enough = F.least("l.remains", "r.remains") >= least / (1 + least) * (1 - _SLACK) * sum_
    sized = F.least("l.whole", "r.whole") >= least * (1 - _SLACK) * F.greatest("l.whole", "r.whole")
    once = ~F.col("r.away") | (F.col("l.node") < F.col("r.node"))
    both = left.join(right, (F.col("l.shingle") == F.col("r.shingle")) & (F.col("l.class") != F.col("r.class")) & enough & sized & once)
    return both.select(F.col("l.node").alias("a"), F.col("r.node").alias("b")).distinct()


def _verified(pairs: DataFrame, nodes: DataFrame, texts: DataFrame, sampler) -> DataFrame:
    """The pairs with their texts' similarity.  Only texts of candidates are shuffled, in shares per leader."""
    reps = nodes.select(F.col("node").alias("r_node"), "rep")
    load = pairs.groupBy("a").agg(F.ceil(F.count("*") / _PAIRS_PER_SALT).alias("salts")).withColumnRenamed("a", "l_a")
    load = _table(load.join(reps, F.col("l_a") == F.col("r_node")).select("l_a", "salts", "rep"), "near-load")
    dealt = pairs.join(load.drop("rep"), F.col("a") == F.col("l_a")).join(reps, F.col("b") == F.col("r_node"))
    dealt = _table(dealt.select("a", "b", "rep", F.pmod(F.xxhash64("b"), F.col("salts")).alias("salt")), "near-dealt")
    right = _texts_of(texts, dealt.select(F.col("b").alias("node"), "rep")).withColumnRenamed("text", "b_text")
    right = right.join(dealt, (F.col("node") == F.col("b")) & F.col("id").eqNullSafe(F.col("rep"))).select("a", "b", "salt", "b_text")
    left = _texts_of(texts, load.select(F.col("l_a").alias("node"), "rep")).join(load, (F.col("node") == F.col("l_a")) & F.col("id").eqNullSafe(F.col("rep")))
    left = left.select(F.col("node").alias("a_node"), F.col("text").alias("a_text"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)).alias("a_salt"))
    both = right.join(left, (F.col("a") == F.col("a_node")) & (F.col("salt") == F.col("a_salt"))).select("a", "b", "a_text", "b_text")

    def run(batches):
        model = _sampler(sampler.value)
        for batch in batches:
            for part in arrow_slices(batch, [2, 3], 1 << 20):
                like = model.similarities(part.column(2), part.column(3))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(like)], names=["a", "b", "similarity"])

    return both.mapInArrow(run, "a binary, b binary, similarity double").dropDuplicates(["a", "b"])


_SAMPLERS: dict = {}


def _sampler(idf: np.ndarray) -> Sampler:
    """The worker's sampler of an idf table; its draws are made once per worker."""
    key = hash(idf.tobytes())
    if key not in _SAMPLERS:
        _SAMPLERS.clear()
        _SAMPLERS[key] = Sampler(idf)
    return _SAMPLERS[key]


def components(links: DataFrame) -> DataFrame:
    """(node, label): the smallest node each node of ``links`` (a, b) is connected with.

    In each round a node hears the labels of its neighbours and of the node its own label names, and
    takes the smallest, until nothing changes: about as many rounds as the logarithm of the longest
    path, each one join, one aggregation and one written table.
    """
    edges = _table(links.select("a", "b").union(links.select(F.col("b"), F.col("a"))).distinct(), "near-edges")
    labels = edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("label"))
    labels = _table(labels, "near-labels")
    while True:
        hears = edges.select("a", "b").union(labels.select(F.col("label"), F.col("node")))
        heard = hears.join(labels.select(F.col("node").alias("n_node"), "label"), F.col("a") == F.col("n_node"))
        every = heard.select(F.col("b").alias("node"), "label", F.lit(None).cast("binary").alias("own")).union(
            labels.select("node", "label", F.col("label").alias("own")))
        now = _table(every.groupBy("node").agg(F.min("label").alias("label"), F.max("own").alias("old")), "near-labels")
        labels = now.select("node", "label")
        if now.filter("label <> old").isEmpty():
            return labels


def joined_labels(labels: DataFrame, links: DataFrame) -> DataFrame:
    """``labels`` after further links between nodes that have one or none yet: only the classes they touch are worked on."""
    ends = [links.join(labels.select(F.col("node").alias("n_node"), F.col("label").alias(to)), F.col(end) == F.col("n_node"), "left")
            .select("a", "b", F.coalesce(to, end).alias(to)) for end, to in (("a", "la"), ("b", "lb"))]
    both = ends[0].join(ends[1], ["a", "b"])
    merged = components(both.select(F.col("la").alias("a"), F.col("lb").alias("b")))
    merged = merged.select(F.col("node").alias("old_label"), F.col("label").alias("new_label"))
    named = labels.union(both.select(F.col("a").alias("node"), F.col("la").alias("label"))).union(both.select(F.col("b").alias("node"), F.col("lb").alias("label"))).distinct()
    named = named.join(merged, F.col("label") == F.col("old_label"), "left")
    return _table(named.select("node", F.coalesce("new_label", "label").alias("label")), "near-labels")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = NEAR) -> DataFrame:
    """One row per row of ``docs``: the id, class_id (smallest id of the class), class_size, found_links, kept, node (hash of the text).

    Equal texts are one node, whatever their number.  Texts without words (null, empty, blank) are
    alike only when equal; null counts as empty.  ``found_links`` counts the links found with
    the row's text: at least one in a class of several texts, not all of a large class.  The smallest id of a class is kept (a null one only where it has no other);
    rows that repeat an id and text are both kept or both not.  An empty table gives no rows; other columns of ``docs`` are ignored.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"))
    total, documents = document_frequencies(texts.select("text"))
    shared = spark.sparkContext.broadcast(idf_table(total, documents))

    def start():
        model = _sampler(shared.value)

        def make(column):
            keys = model.bands(column)
            lists = pa.ListArray.from_arrays(np.arange(0, keys.size + 1, BANDS, dtype=np.int32), keys.ravel())
            return [lists]
        return make

    texts = texts.withColumn("node", F.unhex(F.md5("text")))
    signed = texts.withColumn("has_shingles", F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    signed = add_by_text(signed, "text", {"bands": "array<bigint>"}, start, 1 << 19, keep_text=False)
    nodes = signed.groupBy("node").agg(F.min("id").alias("rep"), F.count("*").alias("copies"), F.first("bands").alias("bands"), F.first("has_shingles").alias("has_shingles"))
    nodes = _table(nodes, "near-nodes")
    members = _table(_fullness(_bucket_rows(nodes)), "near-buckets")
    leaders = _table(_leaders(members), "near-leaders")
    pairs = _table(_leader_pairs(members, leaders), "near-pairs")
    links = _table(_verified(pairs, nodes, texts, shared).filter(F.col("similarity") >= least), "near-links")
    labels = components(links)
    rest = _table(_open_members(members, labels, nodes), "near-open")
    if not rest.isEmpty():
        more = _table(_rare_pairs(rest, texts, shared, least), "near-more")
        new = _table(_verified(more, nodes, texts, shared).filter(F.col("similarity") >= least), "near-links")
        if not new.isEmpty():
            links = links.union(new).distinct()
            labels = joined_labels(labels, new.select("a", "b"))
    ends = links.select(F.col("a").alias("e_node"), F.col("b").alias("other")).union(links.select("b", "a")).distinct()
    degree = ends.groupBy("e_node").agg(F.count("*").alias("links"))
    labels = labels.withColumnRenamed("node", "c_node")
    classed = (nodes.join(labels, F.col("node") == F.col("c_node"), "left").join(degree, F.col("node") == F.col("e_node"), "left")
               .select("node", "rep", "copies", F.coalesce("label", "node").alias("label"), F.coalesce("links", F.lit(0)).cast("long").alias("found_links")))
    classed = _table(classed, "near-classes")
    whole = classed.groupBy(F.col("label").alias("w_label")).agg(
        F.min(F.struct(F.col("rep").isNull().alias("none"), "rep", F.col("node").alias("w_node"))).alias("first"), F.sum("copies").alias("class_size"))
    found = classed.join(whole, F.col("label") == F.col("w_label")).select(
        F.col("node").alias("d_node"), "found_links", "class_size", F.col("first.rep").alias("class_id"), F.col("first.w_node").alias("first_node"))
    rows = texts.select("id", "node").join(found, F.col("node") == F.col("d_node"))
    kept = (F.col("node") == F.col("first_node")) & F.col("id").eqNullSafe(F.col("class_id"))
    return rows.select(F.col("id").alias(id_col), "class_id", "class_size", "found_links", kept.alias("kept"), "node")


def drop_near(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = NEAR) -> DataFrame:
    """``docs`` with one document of each class of :func:`near_duplicates`; all columns stay as they are."""
    found = near_duplicates(docs, id_col, text_col, least).filter("class_size > 1")
    touched = (found.groupBy(F.col(id_col).alias("id"), F.col("node").alias("hash")).agg(F.max("kept").alias("stays"), F.count("*").alias("n"))
               .filter("NOT stays OR n > 1").drop("n"))
    return without(docs, _table(touched, "near-touched"), id_col, text_col, lambda text: F.unhex(F.md5(text)))
