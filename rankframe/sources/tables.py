"""Table scans and sinks (parquet / JSON / CSV), all with declared schemas where we own the format."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankframe import schemas as S

DRIVER_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
                 "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's parquet tables; Catalyst prunes columns and pushes filters into the scan."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def require_columns(df: DataFrame, cols, what: str = "input") -> DataFrame:
    """Raise ``ValueError`` when a required column is missing (checked on the schema, no job)."""
    missing = [c for c in cols if c not in df.columns]
    if missing:
        raise ValueError(f"{what} must contain columns {list(cols)}; missing {missing}")
    return df


def read_catalog(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """S3: typed catalogue scan."""
    return spark.read.schema(S.CATALOG).format(fmt).load(path)


def write_table(df: DataFrame, path: str, mode: str = "overwrite", partition_by=None) -> None:
    """Table sink."""
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)


def write_catalog_json(df: DataFrame, path: str) -> None:
    """Canonical JSON sink, one record per line."""
    df.write.mode("overwrite").json(path)


def read_catalog_json(spark: SparkSession, path: str, schema=None, array: bool = False) -> DataFrame:
    """JSON scan: one record per line, or (``array``) files that each hold one JSON array.

    A file of the other kind, or a broken record, fails the read instead of giving NULL rows.
    """
    return (spark.read.schema(schema or S.CATALOG).option("multiLine", array).option("mode", "FAILFAST").json(path))


def read_ground_truth(spark: SparkSession, path: str) -> DataFrame:
    """CSV with header; required columns ``Query, Assessment_url``."""
    df = (spark.read.option("header", True).option("escape", '"').option("multiLine", True)
          .schema(S.GROUND_TRUTH).csv(path))
    return require_columns(df, ["Query", "Assessment_url"], "ground truth CSV")


def write_submission(rows: DataFrame, path: str) -> None:
    """Submission CSV, header ``Query,Assessment_url``, ordered by query position then rank.

    The sort is a range-partitioned global sort, so the write stays parallel; files come out in
    order (part-00000 … part-N) and concatenate to the ordered submission.
    """
    (rows.orderBy("query_pos", "rank").select("Query", "Assessment_url")
     .write.mode("overwrite").option("header", True).option("escape", '"').csv(path))


def write_truth_csv(rows: DataFrame, path: str) -> None:
    """Ground-truth CSV sink ``Query,Assessment_url`` with header (quoted, multi-line safe)."""
    (rows.select("Query", "Assessment_url").write.mode("overwrite").option("header", True)
     .option("escape", '"').csv(path))


def write_vectors(df: DataFrame, path: str) -> None:
    """Vector table sink ``(catalog_idx, embedding ARRAY<FLOAT>)``."""
    df.select("catalog_idx", F.col("embedding").cast("array<float>")).write.mode("overwrite").parquet(path)


def read_vectors(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(S.VECTORS).parquet(path)
