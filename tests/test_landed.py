"""Page files, records with rejects, and an embedding job over several runs."""

import os
import time

import pytest
from pyspark.sql import types as T

from rankframe.operators.embed_resume import embed_resumable, results
from rankframe.session import scratch_path
from rankframe.sources import pages as P
from rankframe.sources import quarantine as Q


def local(path):
    return path.removeprefix("file://")


# ------------------------------------------------------------------ page files
def test_charsets():
    text = "<p>Grün – “ok” 中</p>"
    assert P.page_text(text.encode()) == text and P.page_text(None) is None and P.page_text(b"") == ""
    for mark, name in P._BOMS:
        assert P.page_text(mark + text.encode(name)) == text
    for head, name in (('<meta charset="windows-1252">', "windows-1252"), ("<META http-equiv='x' content='text/html; charset = ISO-8859-1'>", "windows-1252"),
                       ("<meta charset=koi8-r>", "koi8-r"), ("<meta charset=utf-16>", "utf-8"), ("<meta charset='no such'>", "utf-8")):
        said = head + ("<p>Привет</p>" if name == "koi8-r" else "<p>Grün – “ok”</p>")
        assert P.page_text(said.encode(name)) == said
    assert P.page_text(b"caf\xe9") == "caf�"


def test_files_of_any_depth_and_a_late_one(spark):
    folder, manifest = scratch_path(spark, "t-files"), scratch_path(spark, "t-manifest")
    rows = [(1, "u1", "<p>eins\r\n\x00zwei</p>"), (2, None, ""), (3, "u3", None)]
    table = spark.createDataFrame(rows, "page_id long, url string, html string")
    P.land_pages(table, folder)
    P.write_manifest(table.filter("page_id < 3"), manifest)
    os.makedirs(f"{local(folder)}/page_id=9")
    with open(f"{local(folder)}/page_id=9/raw.html", "wb") as f:
        f.write(b"<meta charset=latin1>caf\xe9")
    got = {r.page_id: (r.url, r.html, r.start) for r in P.read_page_files(spark, folder, manifest).collect()}
    assert got == {1: ("u1", rows[0][2] + "\n", None), 2: (None, "\n", None), 3: (None, "\n", None), 9: (None, "<meta charset=latin1>café", None)}
    sink, ck = scratch_path(spark, "t-sink"), scratch_path(spark, "t-ck")

    def read():
        stream = P.stream_page_files(spark, folder, manifest, files_per_trigger=1)
        stream.writeStream.format("parquet").option("path", sink).option("checkpointLocation", ck).trigger(availableNow=True).start().awaitTermination()
        return sorted((r.page_id, r.html) for r in spark.read.parquet(sink).collect())
    assert read() == sorted((k, v[1]) for k, v in got.items())
    P.land_pages(spark.createDataFrame([(10, "late")], "page_id long, html string"), folder)
    assert read() == sorted([*((k, v[1]) for k, v in got.items()), (10, "late\n")])


# ------------------------------------------------------------------ rejects
SCHEMA = T.StructType([T.StructField("id", T.LongType()), T.StructField("name", T.StringType()), T.StructField("tags", T.ArrayType(T.StringType()))])


def test_json_records_add_up(spark):
    lines = ['{"id": 1, "name": "a", "tags": ["x"]}', '{"id": 2, "name": "b"', '{"id": "x", "name": "c"}', '{"name": "d"}', '{"id": 5, "tags": []}', "nothing", '{"id": 6, "name": "f"}', '{"id": 1, "name": "a", "tags": ["x"]}']
    path, bad = scratch_path(spark, "t-json"), scratch_path(spark, "t-bad")
    spark.createDataFrame([(x,) for x in lines], "value string").write.text(path)
    good, rejects = Q.read_with_rejects(spark, path, SCHEMA, required=("id", "name"))
    assert good.schema.simpleString() == SCHEMA.simpleString()
    assert sorted((r.id, r.name) for r in good.collect()) == [(1, "a"), (1, "a"), (6, "f")]
    assert sorted((r.reason, r.record) for r in rejects.collect()) == sorted([
        ("malformed", lines[1]), ("malformed", lines[2]), ("malformed", lines[5]), ("missing id", '{"name":"d"}'), ("missing name", '{"id":5,"tags":[]}')])
    Q.quarantine(rejects, bad)
    Q.quarantine(rejects.filter("reason = 'malformed'"), bad)
    assert spark.read.json(bad).groupBy("reason").count().filter("reason = 'malformed'").first()["count"] == 6
    assert {r.reason: r.n for r in Q.told(good, rejects).collect()} == {None: 3, "malformed": 3, "missing id": 1, "missing name": 1}


def test_csv_records_add_up(spark):
    path = scratch_path(spark, "t-csv")
    os.makedirs(local(path))
    with open(f"{local(path)}/a.csv", "w") as f:
        f.write('id,name\n1,"a ""quoted"" name"\nx,b\n3\n,d\n5,"two\nlines"\n')
    schema = T.StructType(SCHEMA.fields[:2])
    good, rejects = Q.read_with_rejects(spark, path, schema, "csv", required=("id",))
    assert sorted((r.id, r.name) for r in good.collect()) == [(1, 'a "quoted" name'), (5, "two\nlines")]
    assert sorted(r.reason for r in rejects.collect()) == ["malformed", "malformed", "missing id"]
    with pytest.raises(ValueError):
        Q.read_with_rejects(spark, path, schema, "parquet")


# ------------------------------------------------------------------ embedding over several runs
def embedder(log, stop_at=None, wait=0):
    """Vectors by length; each batch leaves a file with its texts, or fails if it holds ``stop_at``."""
    def fn(texts, task_type):
        if stop_at in texts:
            time.sleep(wait)
            raise RuntimeError("stopped")
        import uuid
        with open(f"{log}/{uuid.uuid4().hex}", "w") as f:
            f.write("\n".join(texts))
        return [[float(len(t)), 1.0] for t in texts]
    return fn


def sent(log):
    return [t for name in os.listdir(log) for t in open(f"{log}/{name}").read().split("\n")]


def test_a_failed_run_goes_on_and_sends_each_text_once(spark, tmp_path):
    rows = [(i % 40, f"text {i}") for i in range(57)]  # ids repeat
    texts, path, log = spark.createDataFrame(rows, "id long, text string").repartition(3), scratch_path(spark, "t-embed"), str(tmp_path)
    with pytest.raises(Exception):
        embed_resumable(texts, embedder(log, "text 31", wait=6), path, "id", "text", batch_rows=5)
    first = sent(log)
    assert 0 < len(first) < 57 and sorted(first) == sorted(rows_of(spark, path, rows))
    got = embed_resumable(texts, embedder(log), path, "id", "text", batch_rows=5)
    assert sorted(sent(log)) == sorted(t for _, t in rows)
    assert sorted((r.id, r.embedding) for r in got.collect()) == sorted((i, [float(len(t)), 1.0]) for i, t in rows)
    assert all(len(open(f"{log}/{name}").read().split("\n")) <= 5 for name in os.listdir(log))
    embed_resumable(texts, embedder(log), path, "id", "text", batch_rows=5)
    assert len(sent(log)) == 57


def rows_of(spark, path, rows):
    """Texts of the batches with results."""
    done = results(spark, path).select("batch").distinct()
    return [r.text for r in spark.read.parquet(f"{path}/plan").join(done, "batch").collect()]


def test_quota_and_empty_input(spark, tmp_path):
    rows, path, log = [(i, None if i == 3 else f"t{i}") for i in range(20)], scratch_path(spark, "t-embed"), str(tmp_path)
    texts = spark.createDataFrame(rows, "id long, text string").coalesce(1)
    assert embed_resumable(texts, embedder(log), path, "id", "text", 4, quota=2).count() == 8
    assert embed_resumable(texts, embedder(log), path, "id", "text", 4, quota=2).count() == 16
    assert embed_resumable(texts, embedder(log), path, "id", "text", 4).count() == 20
    assert embed_resumable(texts.limit(0), embedder(log), scratch_path(spark, "t-embed"), "id", "text").count() == 0
