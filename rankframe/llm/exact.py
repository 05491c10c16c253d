"""Exact deduplication by progressive refinement: length, prefix hash, full hash.

Level 1 and 2 read only the length and a short prefix of each text; one aggregation over
``(length, prefix hash)`` serves both, because a prefix group lies within one length.  The keys of
groups with more than one row survive, as a bitmap of fixed size (no surviving key is missed; a
clash only lets a row through to level 3).  Level 3 hashes the whole text of rows whose key is in
the bitmap and groups those.  Only fixed-width keys are ever shuffled, never a text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankframe.llm.common import cut_lineage, in_bitmap, key_bitmap, text_of, without

PREFIX_CHARS = 64


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hash_all: bool = False) -> DataFrame:
    """One row per row of ``docs``: the id, keep_id, group_size, kept, full_hash (lowercase hex SHA-256).

    The row with the largest id of each group of equal texts stays; of rows repeated with that id,
    one.  A null text counts as empty, a null id as smaller than any id, and an empty table gives no
    rows.  Other columns of ``docs`` are not read, whatever their names.  ``full_hash`` is null where
    the full text needed no hashing, unless ``hash_all``.
    """
    base = docs.select(F.monotonically_increasing_id().alias("row_id"), F.col(id_col).alias("id"), text_of(text_col).alias("text"))
    length, prefix = F.octet_length("text"), F.xxhash64(F.substring("text", 1, PREFIX_CHARS))
    groups = base.groupBy(length.alias("len"), prefix.alias("ph")).agg(F.count("*").alias("n")).filter("n > 1")
    key = F.xxhash64("len", "ph")
    keyed = base.withColumn("len", length).withColumn("ph", prefix)
    probed = in_bitmap(keyed, key_bitmap(groups, key), key, "maybe")
    full = F.sha2("text", 256)
    hashed = probed.select("row_id", "id", "len", "maybe", (full if hash_all else F.when(F.col("maybe"), full)).alias("full_hash"))
    hashed = cut_lineage(hashed, "exact-keys")
    copies = (hashed.filter("maybe").groupBy("len", "full_hash")
              .agg(F.max(F.struct("id", "row_id")).alias("keep"), F.count("*").alias("n")).filter("n > 1")
              .withColumnRenamed("len", "g_len").withColumnRenamed("full_hash", "g_hash"))
    found = hashed.join(copies, F.col("maybe") & (F.col("len") == F.col("g_len")) & (F.col("full_hash") == F.col("g_hash")), "left")
    return found.select(
        F.col("id").alias(id_col), F.when(F.col("n").isNull(), F.col("id")).otherwise(F.col("keep.id")).alias("keep_id"),
        F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
        F.coalesce(F.col("keep.row_id") == F.col("row_id"), F.lit(True)).alias("kept"), "full_hash")


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that :func:`exact_groups` drops; all columns stay as they are."""
    found = exact_groups(docs, id_col, text_col).filter("group_size > 1")
    touched = (found.groupBy(F.col(id_col).alias("id"), F.col("full_hash").alias("hash")).agg(F.max("kept").alias("stays"), F.count("*").alias("n"))
               .filter("NOT stays OR n > 1").drop("n"))
    return without(docs, cut_lineage(touched, "exact-touched"), id_col, text_col, lambda text: F.sha2(text, 256))
