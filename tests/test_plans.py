"""Plan shapes: pruning and pushdown reach the scans, top-k is cut below the shuffle, small sides
are broadcast, and the kNN broadcast path never shuffles items."""

import __spark_entry__ as E
from conftest import SMALL


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_scan_reads_only_needed_columns(spark):
    p = plan(E.queries()["tokenize"](spark, SMALL))
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in p
    assert "n_chars" not in p


def test_filter_pushed_to_scan(spark):
    p = plan(E.queries()["intent_level"](spark, SMALL))
    assert "PushedFilters: [IsNotNull(role), EqualTo(role,user)]" in p


def test_bm25_topk_plan(spark):
    p = plan(E.queries()["bm25_topk"](spark, SMALL))
    assert "WindowGroupLimit" in p
    assert "BroadcastHashJoin" in p and "SortMergeJoin" not in p


def test_knn_broadcast_path_does_not_shuffle_items(spark):
    p = plan(E.queries()["knn_topk"](spark, SMALL))
    assert "MapInPandas" in p and "FlatMapCoGroupsInPandas" not in p


def test_knn_switches_to_passes_then_blocked_beyond_the_bound(spark, monkeypatch):
    from rankframe.operators import knn as K
    base = sorted(E.queries()["knn_topk"](spark, SMALL).collect())
    monkeypatch.setattr(K, "BROADCAST_QUERY_ROWS", 300)   # 500 queries: two broadcast passes
    df = E.queries()["knn_topk"](spark, SMALL)
    p = plan(df)
    assert "MapInPandas" in p and "Union" in p and "FlatMapCoGroupsInPandas" not in p
    assert sorted(df.collect()) == base
    monkeypatch.setattr(K, "BROADCAST_QUERY_ROWS", 10)    # too many passes: blocked cogroup
    df = E.queries()["knn_topk"](spark, SMALL)
    assert "FlatMapCoGroupsInPandas" in plan(df)
    assert sorted(df.collect()) == base


def test_every_customer_and_user_turn_is_searched_for(spark, tmp_path):
    """Whatever its key, among all parts; the SQL asks for the same rows."""
    from rankframe.plans import ranking as RK
    from rankframe.plans import recommend as RC

    spark.createDataFrame([(k, f"Customer#{k}", k % 25, 1.0, "BUILDING") for k in (1, 99, 100, 101, 300)],
                          "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string").write.parquet(f"{tmp_path}/customer.parquet")
    spark.createDataFrame([(k, f"ring {k} gear", "Brand#1", "STEEL", k % 50, 1.0) for k in range(1, 61)],
                          "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double").write.parquet(f"{tmp_path}/part.parquet")
    spark.createDataFrame([(c, n, "user" if n % 2 == 0 else "assistant", f"text {n}") for c in (0, 7, 100, 250, 400) for n in range(3)],
                          "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    pairs = RK.candidates(spark, str(tmp_path)).groupBy("query_id").count().collect()
    assert sorted((r["query_id"], r["count"]) for r in pairs) == [(k, 40) for k in (1, 99, 100, 101, 300)]
    told = {r.stage: r.n for r in RC.q_stage_counts(spark, str(tmp_path)).collect()}
    assert told["queries"] == told["queries_with_results"] == 10
    assert not any("% 100 = 0" in sql for sql in {**RK.SQL, **RC.SQL}.values())


def test_tables_that_grow_with_the_input_are_not_broadcast(spark):
    """The catalogue, vectors and queries may hold far more than their files' size lets Spark expect."""
    from rankframe.plans import catalog as CAT
    from rankframe.plans import recommend as RC

    cat = CAT.catalog_typed(spark, SMALL)
    recs = spark.createDataFrame([(1, 1, 5), (1, 2, 7)], "query_id long, rank int, catalog_idx long").repartition(2)
    queries = spark.createDataFrame([(1, "a", 0)], "query_id long, query string, query_pos long")
    for df in (RC.to_response(recs, cat), RC.submission(recs, queries, cat)):
        assert "BroadcastHashJoin" not in plan(df) and "SortMergeJoin" in plan(df)
        assert df.count() > 0
    r = RC.recommend(queries, cat, prepared=RC._prepared(spark, SMALL, cat))
    sides = [line for line in plan(r).split("\n") if "BroadcastHashJoin [catalog_idx" in line]
    assert all("BuildLeft" in line for line in sides)  # the window of a small batch alone
