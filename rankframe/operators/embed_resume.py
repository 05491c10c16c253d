"""D1 over many runs: a batched embedding job that goes on where an earlier run stopped.

The texts are dealt into batches once, in a written plan.  A run takes the batches that have no result
yet (an anti-join), a task for each (up to MAX_TASKS), and every task's results are final when the task ends (Hadoop's
output committer, version 2, moves them at task commit).  So whatever ends a run, the batches of finished
tasks are kept; only those of tasks then running are sent again.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

MAX_TASKS = 100_000
_COMMIT = "mapreduce.fileoutputcommitter.algorithm.version"


def _exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def plan_batches(texts: DataFrame, path: str, id_col: str, text_col: str, batch_rows: int = 100) -> DataFrame:
    """The plan (batch, id, text) of ``path``, written by the first run: batches of at most ``batch_rows`` rows."""
    spark = texts.sparkSession
    if not _exists(spark, f"{path}/plan/_SUCCESS"):
        row = F.monotonically_increasing_id()  # partition number above 33 bits of row number
        batch = F.shiftleft(F.shiftright(row, 33), 33) + F.floor(row.bitwiseAND((1 << 33) - 1) / batch_rows)
        texts.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).withColumn("batch", batch).write.mode("overwrite").parquet(f"{path}/plan")
    return spark.read.parquet(f"{path}/plan")


def results(spark: SparkSession, path: str, id_kind: str = "bigint") -> DataFrame:
    """(batch, id, embedding) of all batches done so far."""
    schema = f"batch bigint, id {id_kind}, embedding array<double>"
    return spark.read.schema(schema).parquet(f"{path}/results") if _exists(spark, f"{path}/results") else spark.createDataFrame([], schema)


def _numbered(batches: DataFrame) -> DataFrame:
    """(batch, nth): batches numbered from 0, by numbering each plan partition's and adding those before it."""
    of = batches.withColumn("part", F.shiftright("batch", 33))
    before = of.groupBy("part").agg(F.count(F.lit(1)).alias("n"))  # a row per task that wrote the plan
    before = before.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    within = F.row_number().over(Window.partitionBy("part").orderBy("batch")) - 1
    return of.withColumn("own", within).join(before, "part").select("batch", (F.col("own") + F.col("before")).alias("nth"))


def embed_resumable(texts: DataFrame, fn, path: str, id_col: str, text_col: str, batch_rows: int = 100,
                    task_type: str = "RETRIEVAL_DOCUMENT", quota: int | None = None) -> DataFrame:
    """Send what has no embedding yet to ``fn(texts, task_type)``, a batch at a time; (id_col, embedding) of all done.

    ``path`` is the job's folder: a later run with the same folder goes on with the texts planned then.
    ``quota`` bounds the batches of this run (a daily limit of a hosted model).  A null text is sent
    as empty; ids may repeat, every row gets its vector.
    """
    spark = texts.sparkSession
    plan = plan_batches(texts, path, id_col, text_col, batch_rows)
    kind = plan.schema["id"].dataType.simpleString()
    pending = plan.select("batch").distinct().join(results(spark, path, kind).select("batch").distinct(), "batch", "left_anti")
    pending = pending if quota is None else pending.orderBy("batch").limit(quota)
    n = pending.count()
    if n:
        def run(parts):
            rest = None  # a task's rows come sorted by batch, cut anywhere into frames
            for pdf in parts:
                rest = pdf if rest is None else pd.concat([rest, pdf], ignore_index=True)
                last = rest["batch"].iloc[-1] if len(rest) else None
                for batch, rows in rest[rest["batch"] != last].groupby("batch", sort=False):
                    yield sent(batch, rows)
                rest = rest[rest["batch"] == last]
            if rest is not None and len(rest):
                yield sent(rest["batch"].iloc[0], rest)

        def sent(batch, rows):
            vectors = fn(rows["text"].fillna("").tolist(), task_type)
            return pd.DataFrame({"batch": batch, "id": rows["id"].to_numpy(), "embedding": [list(map(float, v)) for v in vectors]})

        tasks = min(n, MAX_TASKS)
        todo = plan.join(_numbered(pending), "batch").repartitionById(tasks, (F.col("nth") % tasks).cast("int")).sortWithinPartitions("batch")
        (todo.mapInPandas(run, f"batch bigint, id {kind}, embedding array<double>")
         .write.mode("append").option(_COMMIT, "2").parquet(f"{path}/results"))
    return results(spark, path, kind).select(F.col("id").alias(id_col), "embedding")
