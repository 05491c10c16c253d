"""S3/S6/S7 with bad records: a typed scan whose good rows go on and whose others are kept with their reason.

Nothing is dropped and nothing turns into silent NULLs: good rows and rejects add up to all records.  The
scan is written once, so that the two sides are of one reading.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from rankframe.session import cut_lineage

_RECORD, _FILE = "_record", "_file"


def read_with_rejects(spark: SparkSession, path: str, schema: StructType, fmt: str = "json", required: tuple = (), options: dict | None = None) -> tuple[DataFrame, DataFrame]:
    """(good rows with ``schema``, rejects (file, record, reason)) of JSON lines or CSV (header) files.

    ``malformed``: a record that does not parse, or a value that does not fit its type.  ``missing c``: a
    required column that is null, the first in the order of ``required``.  The record is the text as it
    was read, or for a missing value the typed row as JSON.
    """
    if fmt not in ("json", "csv"):
        raise ValueError(f"{fmt} records cannot be told apart")
    wide = StructType([*schema.fields]).add(_RECORD, "string")
    read = spark.read.schema(wide).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", _RECORD)
    if fmt == "csv":
        read = read.option("header", True).option("escape", '"').option("multiLine", True)
    for name, value in (options or {}).items():
        read = read.option(name, value)
    rows = cut_lineage(read.format(fmt).load(path).withColumn(_FILE, F.input_file_name()), "records")
    reason = F.when(F.col(_RECORD).isNotNull(), F.lit("malformed"))
    for c in required:
        reason = reason.when(F.col(f"`{c}`").isNull(), F.lit(f"missing {c}"))
    names = [F.col(f"`{f.name}`") for f in schema.fields]
    rows = rows.withColumn("_reason", reason)
    good = rows.filter("_reason IS NULL").select(*names)
    rejects = rows.filter("_reason IS NOT NULL").select(F.col(_FILE).alias("file"), F.coalesce(F.col(_RECORD), F.to_json(F.struct(*names))).alias("record"), F.col("_reason").alias("reason"))
    return good, rejects


def quarantine(rejects: DataFrame, path: str) -> None:
    """Append the rejects to the quarantine folder, a sub-folder per reason."""
    rejects.write.mode("append").partitionBy("reason").json(path)


def told(good: DataFrame, rejects: DataFrame) -> DataFrame:
    """(reason, n): good rows (null) and rejects by reason."""
    return good.select(F.lit(None).cast("string").alias("reason")).union(rejects.select("reason")).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))
