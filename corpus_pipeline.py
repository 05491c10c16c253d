"""The corpus pipeline: each stage works on what its predecessor kept, written as Parquet and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pyspark.sql import functions as F

from rankframe.llm import bpe, exact, langid, minhash, mixing
from rankframe.llm.common import crc_bucket, cut_lineage, free_name, prepare, table
from rankframe.llm.queries import word_bpe_path


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that have no language: null texts and texts without a letter."""
    prepare(spark)
    model = langid.train(docs.filter(crc_bucket("doc_id", 4) != 2))
    lang, score = free_name(docs.columns, "lang_pred"), free_name(docs.columns, "lang_score")
    found = langid.identify(docs, model, lang_out=lang, score_out=score)
    return found.filter(F.col(lang) != langid.UNDECIDED).select(*[F.col(f"`{c}`") for c in docs.columns])


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of equal texts."""
    prepare(spark)
    return exact.drop_copies(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each class of near-duplicates."""
    prepare(spark)
    return minhash.drop_near(docs)


def mixing_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes each document as often as the sources' target weights ask for: not at all, once or twice."""
    prepare(spark)
    return mixing.mix(docs, written=True)


def bpe_coding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Adds the ids of each text and their decoded text."""
    prepare(spark)
    return bpe.encode(docs, word_bpe_path())


STAGES = [("language_id", language_id), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup), ("mixing", mixing_sources), ("bpe", bpe_coding)]

#: Language, near copies, random rounding and subword ids are not for SQL; tests hold the stages against plain code.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
