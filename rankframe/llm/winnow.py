"""Benchmark decontamination by winnowing: shared fingerprints are joined, their hits extended to whole windows.

A text's fingerprints are the least K-gram hashes of every WINDOW consecutive K-grams (of equal ones
the last).  Any span of SPAN = K + WINDOW - 1 words that a document shares with an item holds a
K-gram chosen in both, so no shared span of SPAN words is missed.  An item of fewer words is one
fingerprint of its own length, for which documents are read at every word.

Documents are read once.  A bitmap of the items' fingerprints (at most 2**MOST_BITS bits) leaves
those that an item may have; each hit is extended to the windows of SPAN words around it, and only
these windows' hashes are joined with the items' windows.  The join is one row per window and
place, never a pair of document and item; windows that hold many rows are dealt over several tasks.
The items of a document follow from the classes of its windows (windows with the same items are one
class), once per distinct set of classes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankframe.llm.common import arrow_slices, cut_lineage, shuffle_width
from rankframe.llm.shingles import mix64, text_bytes, words

SPAN = 10
K = 5
WINDOW = SPAN - K + 1
LEAST_BITS, MOST_BITS = 23, 27
_ROW_BITS = 15
#: A key with fewer rows than this is never dealt over several tasks.
LEAST_HOT = 1000
_BASE = np.uint64(0xD6E8FEB86659FD93)
#: Word bytes are 0-9, a-z and all from 0x80 on; A-Z count as a-z, any other byte as a blank.
_AS_READ = np.full(256, 32, np.uint8)
for _a, _b, _to in ((48, 58, 48), (97, 123, 97), (65, 91, 97), (128, 256, 128)):
    _AS_READ[_a:_b] = np.arange(_to, _to + _b - _a)


# ------------------------------------------------------------------ texts
def read_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words, and at which word each text begins and the last ends."""
    data, bounds = text_bytes(texts)
    hashed, _, _, at = words(_AS_READ[data], bounds, fold=False)
    return hashed, at


def gram_hashes(hashed: np.ndarray, n: int, at: np.ndarray | None = None) -> np.ndarray:
    """Hashes of the ``n`` words from every place (or those ``at``) on that has so many behind it."""
    at = np.arange(len(hashed) - n + 1) if at is None else at
    total = np.full(len(at), n, np.uint64)
    for j in range(n):
        total = total * _BASE + hashed[at + j]
    return mix64(total)


def starts(bounds: np.ndarray, n: int) -> np.ndarray:
    """Places from which ``n`` words of one text follow."""
    size = np.maximum(np.diff(bounds) - n + 1, 0)
    return np.arange(size.sum()) + np.repeat(bounds[:-1] - (np.cumsum(size) - size), size)


def chosen(hashed: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place, hash) of the fingerprints of all texts of SPAN words or more."""
    at = starts(bounds, SPAN)
    if not len(at):
        return at, np.zeros(0, np.uint64)
    grams = gram_hashes(hashed, K)
    best, where = grams[at], at.copy()
    for j in range(1, WINDOW):
        other = grams[at + j]
        less = other <= best
        best[less], where[less] = other[less], at[less] + j
    keep = np.zeros(len(grams), bool)
    keep[where] = True
    place = np.flatnonzero(keep)
    return place, grams[place]


def item_rows(texts: pa.Array) -> list[pa.Array]:
    """Per item: words in a window, hashes of its windows, of its fingerprints; a text without words has none."""
    hashed, bounds = read_words(texts)
    place, prints = chosen(hashed, bounds)
    size = np.minimum(np.diff(bounds), SPAN)
    windows, kept = [], []
    for t, (a, b) in enumerate(zip(bounds[:-1], bounds[1:])):
        if size[t] == SPAN:
            windows.append(np.unique(gram_hashes(hashed[a:b], SPAN)))
            kept.append(np.unique(prints[np.searchsorted(place, a):np.searchsorted(place, b)]))
        else:
            windows.append(gram_hashes(hashed[a:b], size[t]) if size[t] else np.zeros(0, np.uint64))
            kept.append(windows[-1])
    lists = [_lists(np.array([len(x) for x in part]), np.concatenate([np.zeros(0, np.uint64), *part])) for part in (windows, kept)]
    return [pa.array(size, pa.int32()), *lists]


def _lists(sizes: np.ndarray, values: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32), pa.array(values.view(np.int64)))


def has_bit(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    at = hashes & np.uint64(8 * len(bits) - 1)
    return (bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1


def document_rows(texts: pa.Array, bits: np.ndarray, short: list[int]) -> list[pa.Array]:
    """Per document: its words, and place, size and hash of each window that an item may have."""
    hashed, bounds = read_words(texts)
    place, prints = chosen(hashed, bounds)
    place = place[has_bit(bits, prints)]
    around = np.zeros(len(hashed) + 1, bool)
    for j in range(WINDOW):  # the windows of SPAN words that hold this K-gram, where the text has them
        at = place - j
        around[at[at >= 0]] = True
    able = starts(bounds, SPAN)
    found = [(able[around[able]], SPAN)]
    for n in short:
        at = starts(bounds, n)
        found.append((at[has_bit(bits, gram_hashes(hashed, n, at))], n))
    at = np.concatenate([a for a, _ in found])
    size = np.concatenate([np.full(len(a), n, np.int32) for a, n in found])
    key = np.concatenate([gram_hashes(hashed, n, a) for a, n in found])
    text = np.searchsorted(bounds, at, "right") - 1
    order = np.argsort(text, kind="stable")
    text, at, size, key = text[order], at[order], size[order], key[order]
    rows = pa.StructArray.from_arrays([pa.array(at - bounds[text], pa.int64()), pa.array(size), pa.array(key.view(np.int64))], ["at", "size", "key"])
    per = np.searchsorted(text, np.arange(len(texts) + 1)).astype(np.int32)
    return [pa.array(np.diff(bounds), pa.int64()), pa.ListArray.from_arrays(per, rows)]


def _by_text(rows: DataFrame, id_kind: str, outputs: dict[str, str], run) -> DataFrame:
    """(id, the outputs) of rows (id, text), in Arrow slices of about 1 MB of text."""
    def batches(given):
        for batch in given:
            for part in arrow_slices(batch, [1], 1 << 20):
                yield pa.RecordBatch.from_arrays([part.column(0), *run(part.column(1))], names=["id", *outputs])

    return rows.mapInArrow(batches, ", ".join([f"id {id_kind}", *[f"{n} {t}" for n, t in outputs.items()]]))


# ------------------------------------------------------------------ tables
def item_index(items: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Fingerprints (hash), windows (size, key, class) and the items of each class (class, item), as written tables.

    Windows with the same items are of one class, named by the least key among them.
    """
    rows = items.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).cast("string").alias("text"))
    read = cut_lineage(_by_text(rows, "string", {"size": "int", "windows": "array<bigint>", "prints": "array<bigint>"}, item_rows), "winnow-items")
    prints = read.select(F.explode("prints").alias("hash")).distinct()
    pairs = cut_lineage(read.select("id", "size", F.explode("windows").alias("key")).distinct(), "winnow-windows")
    told = pairs.groupBy("size", "key").agg(F.bit_xor(F.xxhash64("id")).alias("a"), F.bit_xor(F.xxhash64(F.lit("items"), "id")).alias("b"), F.count("id").alias("n"))
    told = cut_lineage(told, "winnow-keys")
    classes = told.groupBy("a", "b", "n").agg(F.min("key").alias("class"))
    known = cut_lineage(told.join(classes, ["a", "b", "n"]).select("size", "key", "class"), "winnow-known")
    named = known.filter(F.col("key") == F.col("class")).select("size", "key", "class")
    members = cut_lineage(pairs.join(named, ["size", "key"]).select("class", F.col("id").alias("item")).filter("item IS NOT NULL").distinct(), "winnow-members")
    return prints, known, members


def bitmap(spark: SparkSession, prints: DataFrame) -> np.ndarray:
    """Bits of the fingerprints as bytes, 64 or more each and 2**LEAST_BITS in all (1 MB), up to 2**MOST_BITS (16 MB)."""
    bits = min(MOST_BITS, max(LEAST_BITS, (64 * prints.count()).bit_length()))
    at = prints.select(F.col("hash").bitwiseAND((1 << bits) - 1).alias("at"))
    rows = at.groupBy(F.shiftright("at", _ROW_BITS).alias("row")).agg(F.bitmap_construct_agg(F.col("at").bitwiseAND((1 << _ROW_BITS) - 1)).alias("bits"))
    out = np.zeros(1 << (bits - 3), np.uint8)
    for r in rows.collect():
        out[r["row"] << (_ROW_BITS - 3):][:len(r["bits"])] = np.frombuffer(bytes(r["bits"]), np.uint8)
    return out


def join_spread(many: DataFrame, one: DataFrame, on: list[str]) -> DataFrame:
    """Inner join of ``many`` with ``one`` (a row per key), the rows of frequent keys dealt over several tasks.

    A key with more than a quarter of a task's even share is split; of those there are fewer than
    four per task, a bound that lets them be broadcast.
    """
    counts = cut_lineage(many.groupBy(*on).agg(F.count("*").alias("n")), "winnow-counts")
    width = shuffle_width(many.sparkSession)
    limit = max(LEAST_HOT, (counts.agg(F.sum("n")).first()[0] or 0) // (4 * width))
    hot = F.broadcast(counts.filter(F.col("n") > limit).select(*on, F.ceil(F.col("n") / limit).cast("long").alias("_parts")))
    parts = F.coalesce("_parts", F.lit(1))
    many = many.join(hot, on, "left").withColumn("_part", F.pmod(F.xxhash64(*[c for c in many.columns if c not in on]), parts)).drop("_parts")
    one = one.join(hot, on, "left").withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1))).drop("_parts")
    return many.join(one, [*on, "_part"]).drop("_part")


def decontaminate(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  item_id: str = "item_id", item_text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Documents (id, n_words, n_hit, places, item_set) and item sets (item_set, items).

    One row per row of ``docs``, whatever its id: number of words, of words inside an occurrence of an
    item's window, the windows' places (at, size) in order, and the set of items whose windows
    occur (null: no window does).  ``items`` are the distinct ids of a set as strings, sorted.  A window is SPAN
    consecutive words of an item, or all of them if there are fewer.  Null and empty texts have no
    words and no windows; windows of an item without an id count as hits, but name no item.  Repeated
    rows are rows of their own; other columns are not read.  An empty table of items gives no hits.
    """
    spark = docs.sparkSession
    prints, known, members = item_index(items, item_id, item_text)
    bits = spark.sparkContext.broadcast(bitmap(spark, prints))
    short = [r[0] for r in known.filter(F.col("size") < SPAN).select("size").distinct().collect()]
    kind = docs.select(id_col).schema[0].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    read = _by_text(rows, kind, {"n_words": "bigint", "windows": "array<struct<at:bigint,size:int,key:bigint>>"},
                    lambda texts: document_rows(texts, bits.value, short))
    read = cut_lineage(read.withColumn("row_id", F.monotonically_increasing_id()), "winnow-read")
    hits = join_spread(read.select("row_id", F.inline("windows")), known, ["size", "key"])
    hits = hits.groupBy("row_id").agg(F.sort_array(F.collect_list(F.struct("at", "size"))).alias("places"), F.array_sort(F.collect_set("class")).alias("classes"))

    def covered(so_far, x):  # words covered up to an end
        end = F.greatest(so_far["end"], x["at"] + x["size"])
        return F.struct(end.alias("end"), (so_far["n"] + end - F.greatest(so_far["end"], F.least(x["at"], end))).alias("n"))

    hits = hits.withColumn("item_set", F.md5(F.array_join(F.transform("classes", lambda c: c.cast("string")), ",").cast("binary")))
    zero = F.struct(F.lit(0).cast("long").alias("end"), F.lit(0).cast("long").alias("n"))
    hits = cut_lineage(hits.withColumn("n_hit", F.reduce("places", zero, covered, lambda x: x["n"])), "winnow-hits")
    sets = hits.groupBy("item_set").agg(F.first("classes").alias("classes")).select("item_set", F.explode("classes").alias("class"))
    sets = sets.join(members, "class", "left").groupBy("item_set").agg(F.array_sort(F.collect_set("item")).alias("items"))
    may, none, places = read.filter(F.size("windows") > 0), read.filter(F.size("windows") == 0), "array<struct<at:bigint,size:int>>"
    found = may.join(hits, "row_id", "left").select("id", "n_words", F.coalesce("n_hit", F.lit(0)).alias("n_hit"), F.coalesce("places", F.array().cast(places)).alias("places"), "item_set")
    clean = none.select("id", "n_words", F.lit(0).cast("long").alias("n_hit"), F.array().cast(places).alias("places"), F.lit(None).cast("string").alias("item_set"))
    return found.union(clean).withColumnRenamed("id", id_col), cut_lineage(sets, "winnow-sets")
