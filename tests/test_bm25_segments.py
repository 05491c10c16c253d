"""An index kept up to date equals one built anew, and an update writes only the buckets it touches."""

import os
import random
import zlib

import pytest

from rankframe.operators import bm25_segments as G
from rankframe.operators.bm25 import bm25_index, bm25_scores, bm25_topk
from rankframe.session import scratch_path

KIND = "item_id long, text string"


def local(path):
    return path.removeprefix("file://")


def bucket(i, n=8):
    return zlib.crc32(str(i).encode()) % n


def same_as_rebuilt(spark, path, texts):
    index, new = G.open_index(spark, path), bm25_index(spark.createDataFrame(list(texts.items()), KIND), "item_id")
    assert (index.n_items, index.total_tokens, index.avg_idf) == (new.n_items, new.total_tokens, new.avg_idf)
    assert sorted(index.term_stats.collect()) == sorted(new.term_stats.collect())
    cols = ["item_id", "dl", "term", "tf"]
    assert sorted(index.postings.select(*cols).collect()) == sorted(new.postings.select(*cols).collect())
    queries = spark.createDataFrame([(1, "w1 w2 w9"), (2, "w0"), (3, "late")], "query_id long, query string")
    top = [sorted(bm25_topk(bm25_scores(queries, x), 5).collect()) for x in (index, new)]
    assert top[0] == top[1]


def test_updates_equal_a_rebuild(spark, monkeypatch):
    monkeypatch.setattr(G, "MAX_SEGMENTS", 3)  # so that the segments are merged on the way
    r = random.Random(1)
    text = lambda: " ".join(f"w{r.randint(0, 30)}" for _ in range(r.randint(0, 12)))
    texts = {i: text() for i in range(80)}
    path = scratch_path(spark, "t-segments")
    G.create(spark.createDataFrame(list(texts.items()), KIND), path, "item_id", buckets=8)
    same_as_rebuilt(spark, path, texts)
    for step in range(4):
        up = {r.randint(0, 110): text() + " late" * (step == 2) for _ in range(9)}
        gone = {r.randint(0, 110) for _ in range(6)} - set(up)
        G.update(spark, path, spark.createDataFrame(list(up.items()), KIND), spark.createDataFrame([(i,) for i in gone], "item_id long"))
        texts = {i: t for i, t in {**texts, **up}.items() if i not in gone}
        same_as_rebuilt(spark, path, texts)
    assert G.versions(spark, path)[-1] > 5  # a merge is a version too


def test_only_touched_buckets_are_written(spark):
    path = scratch_path(spark, "t-segments")
    G.create(spark.createDataFrame([(i, f"w{i % 5}") for i in range(200)], KIND), path, "item_id", buckets=8)
    before = {d: sorted(os.listdir(f"{local(path)}/segments/{d}")) for d in os.listdir(f"{local(path)}/segments")}
    G.update(spark, path, spark.createDataFrame([(7, "new"), (300, "new")], KIND), spark.createDataFrame([(9,)], "item_id long"))
    after = {d: sorted(os.listdir(f"{local(path)}/segments/{d}")) for d in os.listdir(f"{local(path)}/segments")}
    assert {d: after[d] for d in before} == before
    (new,) = set(after) - set(before)
    assert {d for d in after[new] if d.startswith("bucket=")} == {f"bucket={bucket(i)}" for i in (7, 300)}
    # the bitmaps name the buckets of what went: item 7's old text and item 9
    (deleted,) = os.listdir(f"{local(path)}/deleted")
    assert {r["bucket"] for r in spark.read.parquet(f"{path}/deleted/{deleted}").collect()} == {bucket(7), bucket(9)}


def test_versions_stay_readable_and_a_failed_update_changes_nothing(spark, monkeypatch):
    path = scratch_path(spark, "t-segments")
    G.create(spark.createDataFrame([(1, "a b"), (2, "c")], KIND), path, "item_id", buckets=8)

    def stopped(*_):
        raise RuntimeError("stopped")
    with monkeypatch.context() as m:
        m.setattr(G, "_commit", stopped)
        with pytest.raises(RuntimeError):
            G.update(spark, path, spark.createDataFrame([(1, "zzz")], KIND))
    os.makedirs(f"{local(path)}/versions/2")  # as a driver leaves it that is lost while writing the version
    same_as_rebuilt(spark, path, {1: "a b", 2: "c"})
    assert G.update(spark, path, spark.createDataFrame([(3, "a")], KIND), spark.createDataFrame([(1,), (77,)], "item_id long")) == 2
    same_as_rebuilt(spark, path, {2: "c", 3: "a"})
    first = G.open_index(spark, path, 1)
    assert first.n_items == 2 and {r["item_id"] for r in first.postings.collect()} == {1, 2}
    G.update(spark, path, None, spark.createDataFrame([(2,), (3,)], "item_id long"))
    assert G.open_index(spark, path).postings.count() == 0
    G.update(spark, path, spark.createDataFrame([(1, None), (2, "c c")], KIND))  # an id that was gone comes back
    same_as_rebuilt(spark, path, {1: None, 2: "c c"})


def test_ids_must_be_unique(spark):
    path = scratch_path(spark, "t-segments")
    with pytest.raises(ValueError):
        G.create(spark.createDataFrame([(1, "a"), (1, "b")], KIND), path, "item_id")
    with pytest.raises(ValueError):
        G.open_index(spark, path)
    G.create(spark.createDataFrame([(1, "a")], KIND), path, "item_id", buckets=2)
    with pytest.raises(ValueError):
        G.update(spark, path, spark.createDataFrame([(1, "b")], KIND), spark.createDataFrame([(1,)], "item_id long"))
    with pytest.raises(ValueError):
        G.create(spark.createDataFrame([(1, "a")], KIND), path, "item_id")
