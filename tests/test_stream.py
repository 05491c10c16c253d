"""The streaming job returns the batch job's answer."""

import __spark_entry__ as E
from conftest import SMALL


def test_stream_equals_batch(spark):
    q = E.queries()
    a = sorted(q["recommend_stream"](spark, SMALL).collect())
    b = sorted(q["recommend_cascade"](spark, SMALL).collect())
    assert a == b and len(a) > 0


def test_stream_restart_does_not_duplicate(spark):
    from rankframe.plans import catalog as CAT
    from rankframe.plans.recommend import prepare_items
    from rankframe.session import scratch_path
    from rankframe.streaming.recommend_stream import recommend_stream, user_query_stream

    cat = CAT.catalog_typed(spark, SMALL)
    prepared = prepare_items(cat)
    sink, ck = scratch_path(spark, "t-sink"), scratch_path(spark, "t-ckpt")
    recommend_stream(user_query_stream(spark, SMALL), cat, sink, ck, prepared=prepared).awaitTermination()
    first = spark.read.parquet(sink).count()
    # same checkpoint: the source offsets are committed, so a restart finds nothing new to do
    recommend_stream(user_query_stream(spark, SMALL), cat, sink, ck, prepared=prepared).awaitTermination()
    again = spark.read.parquet(sink)
    assert again.count() == first > 0
    assert again.groupBy("query_id", "rank").count().where("count > 1").count() == 0


def test_stream_over_a_table_of_several_files(spark):
    from rankframe.session import scratch_path
    from rankframe.streaming.recommend_stream import user_query_stream

    folder, sink, ck = (scratch_path(spark, n) for n in ("t-table", "t-turns", "t-ckpt"))
    rows = spark.createDataFrame([(c, t, "user" if t % 2 == 0 else "assistant", f"turn {t} of {c}") for c in range(9) for t in range(4)],
                                 "conv_id long, turn long, role string, text string")
    rows.repartition(3).write.parquet(f"{folder}/conversations.parquet")
    rows.write.parquet(f"{folder}/labels.parquet")
    stream = user_query_stream(spark, folder, files_per_trigger=2)
    stream.writeStream.format("parquet").option("path", sink).option("checkpointLocation", ck).trigger(availableNow=True).start().awaitTermination()
    got = sorted((r.query_id, r.query) for r in spark.read.parquet(sink).collect())
    assert got == [(c * 1_000_000 + t, f"turn {t} of {c}") for c in range(9) for t in (0, 2)]
