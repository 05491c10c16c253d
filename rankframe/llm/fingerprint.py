"""Document fingerprints: bottom-k sketches of word-shingle hashes, in DataFrame functions alone.

A sketch is the sorted array of the ``k`` smallest distinct 64-bit hashes of a text's five-word
shingles (a shorter text is one shingle).  Sketches of parts merge into the sketch of the whole, and
estimate resemblance, containment and the number of distinct shingles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankframe.llm.common import SHINGLE_WORDS, shuffle_width, text_of

K = 128
_SPACE = r"[\x20\x09-\x0D]+"


def word_hashes(text: Column) -> Column:
    words = F.filter(F.split(text, _SPACE), lambda w: w != "")
    return F.transform(words, lambda w: F.xxhash64(w))


def sketch(text: Column, k: int = K) -> Column:
    """Sorted ``k`` smallest distinct shingle hashes; empty for a null, empty or blank text."""
    def of(h: Column) -> Column:
        starts = F.sequence(F.lit(0), F.greatest(F.size(h) - SHINGLE_WORDS, F.lit(0)))
        shingles = F.transform(starts, lambda i: F.xxhash64(*[F.get(h, i + j) for j in range(SHINGLE_WORDS)]))
        kept = F.slice(F.array_distinct(F.sort_array(shingles)), 1, k)
        return F.when(F.size(h) > 0, kept).otherwise(F.array().cast("array<bigint>"))
    # a one-element array binds the word hashes to a variable, so that they are made once per text
    return F.get(F.transform(F.array(word_hashes(F.coalesce(text, F.lit("")))), of), F.lit(0))


def merge(a: Column, b: Column, k: int = K) -> Column:
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated Jaccard similarity of the shingle sets; 1 for two empty sketches, 0 for one."""
    both, joined = F.array_intersect(a, b), merge(a, b, k)
    return F.when(F.size(joined) == 0, 1.0).otherwise(F.size(F.array_intersect(joined, both)) / F.size(joined))


def distinct_shingles(a: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles; exact below ``k``."""
    span = (F.element_at(a, -1).cast("double") + 2.0**63) / 2.0**64
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise((k - 1) / span)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of a's shingles that b has; 1 where a has none."""
    shared = resemblance(a, b, k) * distinct_shingles(merge(a, b, k), k)
    return F.when(F.size(a) == 0, 1.0).otherwise(F.least(F.lit(1.0), shared / distinct_shingles(a, k)))


def as_text(a: Column) -> Column:
    return F.lower(F.array_join(F.transform(a, lambda x: F.lpad(F.hex(x), 16, "0")), ""))


def merge_parts(parts: DataFrame, key: str, sketch_col: str = "sketch", k: int = K) -> DataFrame:
    """One sketch per key from the sketches of its parts; each task keeps ``k`` hashes a key before the shuffle.

    Keys with empty sketches alone get none; null sketches count as empty.
    """
    hashes = parts.select(F.col(key), F.explode(sketch_col).alias("hash")).distinct()
    ranked = hashes.withColumn("at", F.row_number().over(Window.partitionBy(key).orderBy("hash"))).filter(F.col("at") <= k)
    return ranked.groupBy(key).agg(F.sort_array(F.collect_list("hash")).alias(sketch_col))


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K) -> DataFrame:
    """id, text, sketch, next_text, next_sketch: each row beside the next by ascending id, the last beside the first.

    Null ids come first, rows of one id in the order of their texts' hashes.  Ids are dealt into
    ranges by their quantiles; a row's successor is the next one in its range, or the first of the
    next range with rows: one row per range crosses over.
    """
    spark = docs.sparkSession
    base = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"))
    n = 4 * shuffle_width(spark)
    cuts = base.agg(F.percentile_approx("id", [i / n for i in range(1, n)], 10 * n)).first()[0] or []
    cuts = sorted(set(cuts))
    at = F.size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: c <= F.col("id"))) if cuts else F.lit(0)
    base = base.withColumn("range", F.coalesce(at, F.lit(0))).withColumn("order", F.xxhash64("text"))
    firsts = base.groupBy("range").agg(F.min(F.struct("id", "order")).alias("first"))
    firsts = firsts.select(F.col("range").alias("f_range"), F.col("first.id").alias("f_id"), F.col("first.order").alias("f_order"))
    heads = base.join(F.broadcast(firsts), (F.col("range") == F.col("f_range")) & F.col("id").eqNullSafe(F.col("f_id")) & (F.col("order") == F.col("f_order")))
    heads = heads.groupBy("range").agg(F.first("text").alias("text")).withColumn("sketch", sketch(F.col("text"), k))
    onward, whole = Window.orderBy("range"), Window.orderBy("range").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    head = F.struct("text", "sketch")
    heads = heads.select(F.col("range").alias("h_range"), F.coalesce(F.lead(head).over(onward), F.first(head).over(whole)).alias("head"))
    own = base.withColumn("sketch", sketch(F.col("text"), k))
    within = Window.partitionBy("range").orderBy("id", "order")
    own = own.withColumn("follows", F.lead(F.struct("text", "sketch")).over(within))
    own = own.join(heads, F.col("range") == F.col("h_range"), "left").withColumn("after", F.coalesce("follows", "head"))
    return own.select(F.col("id").alias(id_col), "text", "sketch", F.col("after.text").alias("next_text"), F.col("after.sketch").alias("next_sketch"))
