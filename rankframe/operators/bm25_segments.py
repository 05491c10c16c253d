"""A4/S11 kept up to date: versioned segments of packed postings, deletions as bitmaps, statistics by difference.

A folder holds the index:

* ``segments/segment=S/bucket=B``: items added by one update, dealt into buckets by their id's crc32, with
  the item's place (``slot``) in its bucket of that segment, its length and packed postings;
* ``deleted/D``: bitmaps of the slots that an update took out, by segment and bucket;
* ``df/F``: by how much an update changed each term's document frequency;
* ``versions/N``: the names that make up version N, with its item count and token total.

An update reads the changed texts and, in the buckets of changed items alone, the segments; it writes one
new segment with those buckets, bitmaps and differences, and at last its version.  A version is complete
with its ``_SUCCESS`` mark, and names only whole writes, so a failed update leaves the one before as it
was, and readers of an older version go on.  Past MAX_SEGMENTS the live items are merged into one.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rankframe import schemas as S
from rankframe.functions.text import tokenize_ascii
from rankframe.operators.bm25 import Bm25Index, packed_postings, term_statistics
from rankframe.session import broadcast_if_small, cut_lineage

MAX_SEGMENTS = 8
#: Bits of a bitmap row, and rows (4 KB each) up to which the bitmaps are broadcast.
_ROW_BITS = 15
DELETED_ROWS = 4096
_VERSION = "version long, segments array<string>, deleted array<string>, df array<string>, n_items long, total_tokens long, buckets int, id_kind string"


def _folder(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def versions(spark: SparkSession, path: str) -> list[int]:
    """The complete versions of the index in ``path``, rising."""
    where, files = _folder(spark, f"{path}/versions")
    if not files.exists(where):
        return []
    names = [f.getPath().getName() for f in files.listStatus(where)]
    return sorted(int(n) for n in names if n.isdigit() and files.exists(_folder(spark, f"{path}/versions/{n}/_SUCCESS")[0]))


def _state(spark: SparkSession, path: str, version: int | None) -> dict:
    known = versions(spark, path)
    if not known or version not in (None, *known):
        raise ValueError(f"{path} has no version {version if version is not None else 'at all'}")
    return spark.read.schema(_VERSION).parquet(f"{path}/versions/{version or known[-1]}").first().asDict()


def _commit(spark: SparkSession, path: str, state: dict) -> int:
    """Writes a version; fails if another update wrote the same one meanwhile."""
    n = state["version"]
    where, files = _folder(spark, f"{path}/versions/{n}")
    if files.exists(where) and n not in versions(spark, path):
        files.delete(where, True)  # left by an update that failed
    names = [f.split()[0] for f in _VERSION.split(", ")]
    spark.createDataFrame([tuple(state[x] for x in names)], _VERSION).coalesce(1).write.mode("errorifexists").parquet(f"{path}/versions/{n}")
    return n


def _bucketed(rows: DataFrame, buckets: int) -> DataFrame:
    return rows.withColumn("bucket", F.pmod(F.crc32(F.col("item_id").cast("string").cast("binary")), F.lit(buckets)).cast("int"))


def _write_segment(packed: DataFrame, path: str, buckets: int) -> str:
    """A new segment of the items (item_id, dl, postings); its name."""
    name = uuid.uuid4().hex[:12]
    slot = F.row_number().over(Window.partitionBy("bucket").orderBy("item_id")).cast("long") - 1
    placed = _bucketed(packed, buckets).withColumn("slot", slot)
    placed.write.partitionBy("bucket").parquet(f"{path}/segments/segment=s{name}")
    return f"s{name}"


def _rows(spark: SparkSession, path: str, state: dict) -> DataFrame:
    """(item_id, dl, postings, slot, segment, bucket) of all segments, deleted ones too."""
    schema = f"item_id {state['id_kind']}, dl int, postings array<struct<term:string,tf:bigint>>, slot long, segment string, bucket int"
    read = spark.read.schema(schema).option("basePath", f"{path}/segments")
    return read.parquet(*[f"{path}/segments/segment={s}" for s in state["segments"]])


def live_rows(spark: SparkSession, path: str, state: dict, buckets: list[int] | None = None) -> DataFrame:
    """The rows of items that no later update took out, in ``buckets`` or all."""
    rows = _rows(spark, path, state)
    if buckets is not None:
        rows = rows.filter(F.col("bucket").isin(buckets))
    if not state["deleted"]:
        return rows
    dead = spark.read.schema("segment string, bucket int, part long, bits binary").parquet(*[f"{path}/deleted/{d}" for d in state["deleted"]])
    dead = dead.groupBy("segment", "bucket", "part").agg(F.bitmap_or_agg("bits").alias("bits"))
    rows = rows.withColumn("part", F.shiftright("slot", _ROW_BITS)).join(broadcast_if_small(dead, DELETED_ROWS), ["segment", "bucket", "part"], "left")
    bit = F.col("slot").bitwiseAND((1 << _ROW_BITS) - 1)
    byte = F.conv(F.hex(F.substring("bits", (F.shiftright(bit, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    out = F.coalesce(F.getbit(byte, bit.bitwiseAND(F.lit(7).cast("long")).cast("int")) == 1, F.lit(False))
    return rows.filter(~out).drop("part", "bits")


def _write_df(added: DataFrame | None, removed: DataFrame | None, path: str) -> str:
    """Differences of document frequencies by items (postings) that came and went."""
    terms = [r.select(F.explode("postings.term").alias("term"), F.lit(n).alias("n")) for r, n in ((added, 1), (removed, -1)) if r is not None]
    both = terms[0] if len(terms) == 1 else terms[0].union(terms[1])
    name = uuid.uuid4().hex[:12]
    both.groupBy("term").agg(F.sum("n").cast("long").alias("n")).filter("n <> 0").write.parquet(f"{path}/df/{name}")
    return name


def _counted(rows: DataFrame) -> tuple[int, int]:
    n, total = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("dl"), F.lit(0))).first()
    return n, int(total)


def _need_ids(rows: DataFrame, what: str) -> None:
    n, ids = rows.agg(F.count(F.lit(1)), F.count_distinct("item_id")).first()
    if n != ids:
        raise ValueError(f"{what}: {n} rows, {ids} different ids")


def create(items: DataFrame, path: str, id_col: str, text_col: str = "text", buckets: int | None = None, tokenizer=tokenize_ascii) -> int:
    """Write version 1 of an index of ``items`` to the empty folder ``path``; ids must be unique and not null."""
    spark = items.sparkSession
    if versions(spark, path):
        raise ValueError(f"{path} holds an index already")
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    packed = cut_lineage(packed_postings(items, id_col, text_col, tokenizer), "segment-items")
    _need_ids(packed, "items")
    n, total = _counted(packed)
    return _commit(spark, path, {"version": 1, "segments": [_write_segment(packed, path, buckets)], "deleted": [], "df": [_write_df(packed, None, path)],
                                 "n_items": n, "total_tokens": total, "buckets": buckets, "id_kind": items.schema[id_col].dataType.simpleString()})


def update(spark: SparkSession, path: str, upserts: DataFrame | None = None, deletes: DataFrame | None = None, id_col: str = "item_id",
           text_col: str = "text", tokenizer=tokenize_ascii) -> int:
    """The next version: ``upserts`` (id, text) replace or add items, ``deletes`` (id) take items out; its number.

    An id may be named once in both together.  Deleting an unknown id changes nothing.
    """
    state = _state(spark, path, None)
    kind = state["id_kind"]
    none = spark.createDataFrame([], f"{id_col} {kind}, {text_col} string")
    packed = cut_lineage(packed_postings(none if upserts is None else upserts, id_col, text_col, tokenizer), "segment-changes")
    gone = (none if deletes is None else deletes).select(F.col(id_col).cast(kind).alias("item_id"))
    touched = cut_lineage(_bucketed(packed.select("item_id").union(gone), state["buckets"]), "segment-touched")
    _need_ids(touched, "changes")
    here = [r["bucket"] for r in touched.select("bucket").distinct().collect()]  # one per bucket at most
    old = cut_lineage(live_rows(spark, path, state, here).join(touched, ["bucket", "item_id"], "left_semi"), "segment-old")
    n_new, new_tokens = _counted(packed)
    n_old, old_tokens = _counted(old)
    state["version"] += 1
    if n_new:
        state["segments"].append(_write_segment(packed, path, state["buckets"]))
    if n_old:
        name, slot = uuid.uuid4().hex[:12], F.col("slot")
        bits = old.groupBy("segment", "bucket", F.shiftright("slot", _ROW_BITS).alias("part")).agg(F.bitmap_construct_agg(slot.bitwiseAND((1 << _ROW_BITS) - 1)).alias("bits"))
        bits.write.parquet(f"{path}/deleted/{name}")
        state["deleted"].append(name)
    if n_new or n_old:
        state["df"].append(_write_df(packed, old, path))
    state["n_items"] += n_new - n_old
    state["total_tokens"] += new_tokens - old_tokens
    _commit(spark, path, state)
    return compact(spark, path) if len(state["segments"]) > MAX_SEGMENTS else state["version"]


def _df(spark: SparkSession, path: str, state: dict) -> DataFrame:
    read = spark.read.schema("term string, n long").parquet(*[f"{path}/df/{d}" for d in state["df"]])
    return read.groupBy("term").agg(F.sum("n").alias("df")).filter("df > 0")


def compact(spark: SparkSession, path: str) -> int:
    """The next version with the same items in one segment, without bitmaps; its number."""
    state = _state(spark, path, None)
    segment = _write_segment(live_rows(spark, path, state).select("item_id", "dl", "postings"), path, state["buckets"])
    name = uuid.uuid4().hex[:12]
    _df(spark, path, state).withColumnRenamed("df", "n").write.parquet(f"{path}/df/{name}")
    return _commit(spark, path, state | {"version": state["version"] + 1, "segments": [segment], "deleted": [], "df": [name]})


def open_index(spark: SparkSession, path: str, version: int | None = None, epsilon: float = S.BM25_EPSILON) -> Bm25Index:
    """The index as of a version (the last one), in this or a later session; for ``bm25_scores`` and ``block_index``."""
    state = _state(spark, path, version)
    packed = live_rows(spark, path, state).select("item_id", "dl", "postings")
    term_stats, avg_idf = term_statistics(_df(spark, path, state), state["n_items"], epsilon)
    return Bm25Index(packed.select("item_id", "dl", F.inline("postings")), term_stats, state["n_items"], state["total_tokens"], avg_idf, "item_id", packed=packed)
