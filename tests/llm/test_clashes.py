"""Columns named like an operator's own keep their values."""

import pytest

from rankframe.llm import exact, minhash, mixing

NAMES = ["row", "n", "time", "copies", "_maybe", "_bits", "_pos", "_bitmap_row", "_id_of_row", "_hash_of_row", "_t_id", "_row_of_docs", "_row_taken",
         "_time", "_copies", "row_id", "size", "bits", "id", "hash", "stays", "node", "bucket", "spread", "lang_pred", "lang_score", "_text_of_row"]
KIND = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{n} {'boolean' if i % 2 else 'string'}" for i, n in enumerate(NAMES))


def table(spark, texts):
    return spark.createDataFrame([(i, t, "en", "ab"[i % 2], 3, *[bool((i + k) % 2) if k % 2 else f"{n}{i}" for k, n in enumerate(NAMES)])
                                  for i, t in enumerate(texts)], KIND)


@pytest.mark.parametrize("stage", [exact.drop_copies, minhash.drop_near, mixing.mix])
def test_values_stay(spark, stage):
    words = [f"word{i}" for i in range(200)]
    near = " ".join(words)
    docs = table(spark, ["one two", "one two", "other text here", None, "", near, near + " more", "a b c", "a b c", "solo"])
    given = {r.doc_id: r for r in docs.collect()}
    left = stage(docs)
    assert left.columns == docs.columns
    rows = left.collect()
    assert rows and all(r == given[r.doc_id] for r in rows)


def test_language_stage_keeps_its_rows_values(spark):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    docs = table(spark, ["the quick brown fox jumps", "123 456", None, "of the and then he said so"])
    docs = docs.drop("lang").withColumnRenamed("_bits", "lang").selectExpr("doc_id", "text", "'en' lang", "source", "lang_pred", "lang_score", "_text_of_row")
    given = {r.doc_id: r for r in docs.collect()}
    rows = corpus_pipeline.language_id(spark, docs, "").collect()
    assert {r.doc_id for r in rows} == {0, 3} and all(r == given[r.doc_id] for r in rows)
