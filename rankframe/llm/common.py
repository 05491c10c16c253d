"""What the operators of this subpackage share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rankframe.session import SLICE_ROWS, arrow_slices, cut_lineage, ensure_checkpoint_dir, ship_package  # noqa: F401

#: Words of the mixing and scoring contracts.
WORD = r"[^\x20\x09-\x0D]+"
SHINGLE_WORDS = 5
NEAR = 0.8


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def prepare(spark: SparkSession) -> None:
    """The shared folder is set and this package can be imported by Python workers."""
    ensure_checkpoint_dir(spark)
    ship_package(spark)


def text_of(name: str = "text") -> Column:
    """The text, a null as the empty one."""
    return F.coalesce(F.col(name), F.lit(""))


def crc_bucket(id_col: str, mod: int) -> Column:
    """crc32 of the id as text, modulo ``mod``; null ids give null."""
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(mod))


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def free_name(names, wanted: str) -> str:
    """``wanted``, made longer until no column has the name."""
    taken = {n.lower() for n in names}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted


def add_by_text(rows: DataFrame, text_col: str, outputs: dict[str, str], start, slice_bytes: int = 1 << 20, keep_text: bool = True) -> DataFrame:
    """``rows`` with new columns computed from one text column, in Arrow slices of about ``slice_bytes``.

    ``start()`` runs once per task and returns a function from an Arrow string array to one array per
    new column (``outputs``: name to SQL type); its attribute ``end``, if any, is called when the task is done.  Columns of ``rows`` named like a new one are
    replaced; without ``keep_text`` the text column is not returned.
    """
    import pyarrow as pa

    gone = {n.lower() for n in outputs} | ({text_col.lower()} if not keep_text else set())
    kept = [c for c in rows.columns if c.lower() not in gone]
    names = [c.lower() for c in kept]
    given, at = rows.select(*[F.col(f"`{c}`") for c in kept]), names.index(text_col.lower()) if text_col.lower() in names else len(kept)
    if at == len(kept):
        given = rows.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{text_col}`").alias(free_name(kept, "_text_of_row")))

    def run(batches):
        make = start()
        try:
            for batch in batches:
                for part in arrow_slices(batch, [at], slice_bytes):
                    yield pa.RecordBatch.from_arrays([*part.columns[:len(kept)], *make(part.column(at))], names=[*kept, *outputs])
        finally:
            getattr(make, "end", lambda: None)()

    types = [f"`{f.name}` {f.dataType.simpleString()}" for f in given.schema[:len(kept)]]
    return given.mapInArrow(run, ", ".join([*types, *[f"`{n}` {t}" for n, t in outputs.items()]]))


#: Bits of a key bitmap: 2**23 bits are 1 MB, broadcast as 256 rows of 4 KB.
BITMAP_BITS = 23
_ROW_BITS = 15


def key_bitmap(keys: DataFrame, key: Column) -> DataFrame:
    """A bitmap of fixed size that misses no key: rows (_bitmap_row, _bits)."""
    pos = keys.select(F.pmod(key, F.lit(1 << BITMAP_BITS)).alias("pos"))
    return (pos.groupBy(F.shiftright("pos", _ROW_BITS).alias("_bitmap_row"))
            .agg(F.bitmap_construct_agg(F.col("pos").bitwiseAND((1 << _ROW_BITS) - 1)).alias("_bits")))


def in_bitmap(rows: DataFrame, bitmap: DataFrame, key: Column, out: str) -> DataFrame:
    """``rows`` with a column that is false only where ``key`` (64-bit hashes) is surely not among the bitmap's keys."""
    rows = rows.withColumn("_pos", F.pmod(key, F.lit(1 << BITMAP_BITS)))
    rows = rows.join(F.broadcast(bitmap), F.shiftright("_pos", _ROW_BITS) == F.col("_bitmap_row"), "left")
    bit = F.col("_pos").bitwiseAND((1 << _ROW_BITS) - 1)
    byte = F.conv(F.hex(F.substring("_bits", (F.shiftright(bit, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    found = F.coalesce(F.getbit(byte, bit.bitwiseAND(7).cast("int")) == 1, F.lit(False))
    return rows.withColumn(out, found).drop("_pos", "_bitmap_row", "_bits")


def without(docs: DataFrame, touched: DataFrame, id_col: str, text_col: str, hash_of) -> DataFrame:
    """``docs`` without the rows that ``touched`` (id, hash, stays) names; of rows that repeat one that stays, one.

    Only rows whose id may be among the touched ones are shuffled: a bitmap of fixed size tells.
    """
    ids, row = F.xxhash64(F.col("id")), F.col("row")
    kept = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(id_col).alias("_id_of_row"))  # apart from the columns added below
    marked = in_bitmap(kept, key_bitmap(touched, ids), F.xxhash64(F.col("_id_of_row")), "_maybe")
    names = [row.getField(c).alias(c) for c in docs.columns]
    rest = marked.filter("_maybe").withColumn("_hash_of_row", hash_of(F.coalesce(row.getField(text_col), F.lit(""))))
    keys = touched.select(F.col("id").alias("_t_id"), F.col("hash").alias("_t_hash"), F.col("stays").alias("_t_stays"))
    rest = rest.join(keys, F.col("_id_of_row").eqNullSafe(F.col("_t_id")) & (F.col("_hash_of_row") == F.col("_t_hash")), "left")
    once = rest.filter("_t_stays").dropDuplicates(["_id_of_row", "_hash_of_row"])
    return marked.filter("NOT _maybe").select(*names).union(rest.filter("_t_stays IS NULL").select(*names)).union(once.select(*names))
