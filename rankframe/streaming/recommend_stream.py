"""M1: recommendations for a stream of arriving queries (Structured Streaming).

``readStream`` over a folder of query files -> ``foreachBatch``: each micro-batch is a static
DataFrame, so the whole batch recommend plan (joins, windows, the applyInPandas reranker) runs on
it against item artifacts prepared once before the stream starts.  Output is written per batch id
(``batch_id=N`` folders, overwrite), so a batch replayed after a failure replaces its own output:
the sink is idempotent and the checkpoint gives exactly-once progress.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rankframe.session import scratch_scope

CONVERSATIONS = T.StructType([
    T.StructField("conv_id", T.LongType()),
    T.StructField("turn", T.LongType()),
    T.StructField("role", T.StringType()),
    T.StructField("text", T.StringType()),
])


def user_query_stream(spark: SparkSession, folder: str, glob: str = "conversations.parquet",
                      files_per_trigger: int = 1) -> DataFrame:
    """Arriving user turns as a stream ``(query_id, query)`` (schema declared, no inference).

    ``glob`` names files in ``folder``, or folders of files (a table written by Spark).
    """
    # as a pattern even without a wildcard: Spark takes a plain path to a file for its base folder and refuses it
    name = glob if any(c in glob for c in "*?[{") else f"{{{glob}}}"
    s = (spark.readStream.schema(CONVERSATIONS)
         .option("maxFilesPerTrigger", files_per_trigger).parquet(f"{folder.rstrip('/')}/{name}"))
    return (s.where(F.col("role") == "user")
            .select((F.col("conv_id") * 1_000_000 + F.col("turn")).alias("query_id"), F.col("text").alias("query")))


def recommend_stream(stream: DataFrame, catalog: DataFrame, sink: str, checkpoint: str,
                     available_now: bool = True, prepared: dict | None = None):
    """Start the streaming job; returns the ``StreamingQuery``."""
    from rankframe.plans.recommend import prepare_items, recommend

    prepared = prepared or prepare_items(catalog)

    def run_batch(batch: DataFrame, batch_id: int) -> None:
        # the micro-batch feeds several jobs (vectors, size checks, scoring): keep it for their
        # duration only (recomputable from the source offsets if an executor is lost)
        batch.persist()
        try:
            with scratch_scope(batch.sparkSession):
                recs = recommend(batch, catalog, prepared=prepared)
                recs.write.mode("overwrite").parquet(f"{sink}/batch_id={batch_id}")
        finally:
            batch.unpersist()

    w = stream.writeStream.foreachBatch(run_batch).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")
    return w.start()


def new_listing_pages(page_stream: DataFrame, base_url: str) -> DataFrame:
    """M2: the stream form of the seen-page check.  Each arriving listing page is parsed with its
    signature in one call; pages that are empty or whose signature was already seen are dropped
    (``dropDuplicates`` keeps the set of seen signatures as state, one entry per distinct page).
    Output: one row per listing row of every new page."""
    from rankframe.operators.extract import extract_listing_pages

    pages = extract_listing_pages(page_stream, base_url).where(F.col("n_rows") > 0)
    return (pages.dropDuplicates(["signature"])
            .select("page_id", "start", F.explode("rows").alias("r")).select("page_id", "start", "r.*"))
