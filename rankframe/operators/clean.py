"""Catalogue preparation (P1-P9): typed columns from the scraped text columns, then the canonical
shape.  Pure column expressions: one narrow projection, no shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rankframe.functions.text import (clean_text, map_test_types, parse_duration, parse_list_field,
                                      parse_test_types, yes_no_to_bool)


def prepare_catalog(enriched: DataFrame) -> DataFrame:
    """Clean the text fields, parse duration, map type codes, split lists, type the flags.

    ``test_type_codes`` may be ARRAY<STRING> (as extracted) or its stored text form ``['K', 'P']``.
    """
    codes = enriched.schema["test_type_codes"].dataType
    types = (map_test_types("test_type_codes") if codes.typeName() == "array"
             else parse_test_types("test_type_codes"))
    return (enriched
            .withColumn("description", clean_text("description"))
            .withColumn("job_levels", clean_text("job_levels"))
            .withColumn("languages", clean_text("languages"))
            .withColumn("duration_minutes", parse_duration("assessment_length"))
            .withColumn("test_types", types)
            .withColumn("job_levels_list", parse_list_field("job_levels"))
            .withColumn("languages_list", parse_list_field("languages"))
            .withColumn("remote_testing_bool", yes_no_to_bool("remote_testing"))
            .withColumn("adaptive_irt_bool", yes_no_to_bool("adaptive_irt")))


def canonicalise(prepared: DataFrame, key: str = "catalog_idx") -> DataFrame:
    """Drop the raw list texts, then rename the parsed lists to their names, and add the
    explicit item key (the numeric listing entity id; a URL hash when the id is not numeric).  Rows
    that repeat a key are items of their own: the later ones, by URL and name, get a hashed key."""
    out = (prepared.drop("job_levels", "languages")
           .withColumnRenamed("job_levels_list", "job_levels")
           .withColumnRenamed("languages_list", "languages"))
    if key not in out.columns:
        own = F.coalesce(F.col("assessment_id").try_cast("bigint"), F.xxhash64("assessment_url"))
        again = F.row_number().over(Window.partitionBy("_own").orderBy("assessment_url", "assessment_name"))
        out = out.withColumn("_own", own).withColumn("_again", again)
        out = out.withColumn(key, F.when(F.col("_again") == 1, F.col("_own"))
                             .otherwise(F.xxhash64("_own", "assessment_url", "assessment_name", "_again")))
    return out.select(key, "category", "assessment_id", "assessment_name", "assessment_url",
                      "remote_testing", "adaptive_irt", "test_type_codes", "description",
                      "assessment_length", "duration_minutes", "test_types", "job_levels", "languages",
                      "remote_testing_bool", "adaptive_irt_bool")
