"""Declared schemas and the fixed vocabularies every job shares."""

from __future__ import annotations

from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# Fixed values (must equal the reference's for equal results).
# Test-type code map, in the reference's order: code -> name.
TEST_TYPE_MAP = {
    "A": "Ability & Aptitude",
    "B": "Biodata & Situational Judgement",
    "C": "Competencies",
    "D": "Development & 360",
    "E": "Assessment Exercises",
    "K": "Knowledge & Skills",
    "P": "Personality & Behavior",
    "S": "Simulations",
}
# Allowed test types for intent replies, in the reference's order.
ALLOWED_TEST_TYPES = [
    "Ability & Aptitude",
    "Knowledge & Skills",
    "Personality & Behavior",
    "Competencies",
    "Assessment Exercises",
    "Simulations",
    "Biodata & Situational Judgement",
    "Development & 360",
]
# Canonical-bonus keywords and role words of the keyword-bias experiment.
CANONICAL_KEYWORDS = ["verify", "verbal", "numerical", "inductive", "english comprehension", "opq",
                      "personality questionnaire"]
ROLE_PLUS_WORDS = ["professional"]
ROLE_MINUS_WORDS = ["manager", "supervisor", "team lead"]
# Listing-page constants.
LISTING_CATEGORY = "Individual Test Solutions"
LISTING_PAGE_ROWS = 12
# Labels of the detail-page blocks.
DETAIL_LABELS = {"description": "Description", "job_levels": "Job levels", "languages": "Languages",
                 "assessment_length": "Assessment length"}
# Retrieval / rerank / result depths of the production path.
TOP_K_RETRIEVAL = 40
RERANK_K = 20
FINAL_RESULTS = 10
# BM25 (Okapi) constants.
BM25_K1 = 1.5
BM25_B = 0.75
BM25_EPSILON = 0.25
# ---------------------------------------------------------------------------

CATALOG = T.StructType([
    T.StructField("catalog_idx", T.LongType()),
    T.StructField("category", T.StringType()),
    T.StructField("assessment_id", T.StringType()),
    T.StructField("assessment_name", T.StringType()),
    T.StructField("assessment_url", T.StringType()),
    T.StructField("remote_testing", T.StringType()),
    T.StructField("adaptive_irt", T.StringType()),
    T.StructField("test_type_codes", T.ArrayType(T.StringType())),
    T.StructField("description", T.StringType()),
    T.StructField("assessment_length", T.StringType()),
    T.StructField("duration_minutes", T.IntegerType()),
    T.StructField("test_types", T.ArrayType(T.StringType())),
    T.StructField("job_levels", T.ArrayType(T.StringType())),
    T.StructField("languages", T.ArrayType(T.StringType())),
    T.StructField("remote_testing_bool", T.BooleanType()),
    T.StructField("adaptive_irt_bool", T.BooleanType()),
])

INTENT = T.StructType([
    T.StructField("skills", T.ArrayType(T.StringType())),
    T.StructField("soft_skills", T.ArrayType(T.StringType())),
    T.StructField("max_duration_minutes", T.IntegerType()),
    T.StructField("job_level", T.StringType()),
    T.StructField("required_test_types", T.ArrayType(T.StringType())),
])

GROUND_TRUTH = T.StructType([
    T.StructField("Query", T.StringType()),
    T.StructField("Assessment_url", T.StringType()),
])

VECTORS = T.StructType([
    T.StructField("catalog_idx", T.LongType()),
    T.StructField("embedding", T.ArrayType(T.FloatType())),
])
