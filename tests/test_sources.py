"""Sources and sinks: typed catalogue parquet, vectors, required columns, ordered submission CSV."""

import csv
import glob

import pytest

from rankframe.plans import catalog as CAT
from rankframe.session import scratch_path
from rankframe.sources import tables as T
from conftest import SMALL


def test_catalog_parquet_round_trip(spark):
    cat = CAT.catalog_typed(spark, SMALL)
    path = scratch_path(spark, "t-cat")
    T.write_table(cat, path)
    back = T.read_catalog(spark, path)
    assert back.schema.fieldNames() == cat.schema.fieldNames()
    assert sorted(back.collect()) == sorted(cat.collect())


def test_vectors_round_trip(spark):
    v = spark.createDataFrame([(1, [0.5, -0.25]), (2, [1.0, 0.0])], "catalog_idx long, embedding array<double>")
    path = scratch_path(spark, "t-vec")
    T.write_vectors(v, path)
    back = T.read_vectors(spark, path).orderBy("catalog_idx").collect()
    assert [r.embedding for r in back] == [[0.5, -0.25], [1.0, 0.0]]


def test_require_columns(spark):
    df = spark.createDataFrame([("q",)], "Query string")
    with pytest.raises(ValueError):
        T.require_columns(df, ["Query", "Assessment_url"])
    assert T.require_columns(df, ["Query"]) is df


def test_submission_csv_is_ordered_and_quoted(spark):
    rows = spark.createDataFrame(
        [('say "hi", then\nleave', "u2", 2, 1), ("b", "u3", 1, 2), ("b", "u1", 1, 1), ('say "hi", then\nleave', "u4", 2, 2)],
        "Query string, Assessment_url string, query_pos long, rank int")
    path = scratch_path(spark, "t-sub")
    T.write_submission(rows.repartition(3), path)
    out = []
    for f in sorted(glob.glob(f"{path}/part-*.csv")):
        with open(f, newline="", encoding="utf-8") as fh:
            r = list(csv.reader(fh))
            if r:
                assert r[0] == ["Query", "Assessment_url"]
                out.extend(r[1:])
    assert [u for _, u in out] == ["u1", "u3", "u2", "u4"]
    assert out[2][0] == 'say "hi", then\nleave'


def test_json_array_needs_its_option(spark, tmp_path):
    (tmp_path / "c.json").write_text('[\n  {"catalog_idx": 1, "assessment_name": "a"},\n  {"catalog_idx": 2}\n]')
    path = str(tmp_path)
    assert [r.catalog_idx for r in T.read_catalog_json(spark, path, array=True).orderBy("catalog_idx").collect()] == [1, 2]
    with pytest.raises(Exception):
        T.read_catalog_json(spark, path).collect()
