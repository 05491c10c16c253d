"""Query understanding by rules (I1-I4): requested test types, duration limit, job level, and the
typed parse of structured replies from an outside model.  Column expressions only.

The regular expressions use only constructs that mean the same in Java and RE2 (explicit ASCII
boundaries instead of ``\\b``), so the DuckDB oracle can run the very same patterns.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rankframe import schemas as S

B0 = "(^|[^a-z0-9])"
B1 = "([^a-z0-9]|$)"
SP = "[ \\t\\r\\n]*"

# ---------------------------------------------------------------------------
# Rule table, in output order (pattern on the lower-cased query -> test type).
TYPE_RULES = [
    (B0 + "(java|python|sql|excel|javascript|programming|programmer|developers?|engineers?|technical|"
     "tools?|analytics|analyst|coding|software|seo|data)" + B1, "Knowledge & Skills"),
    ("(collaborat|communicat|teamwork|team work|stakeholder|leadership|culture|cultural)", "Personality & Behavior"),
    ("(reasoning|aptitude|cognitive)", "Ability & Aptitude"),
    (B0 + "(senior|leadership|lead|coo|ceo|cfo|cto|chief|executive|director|head of)" + B1, "Competencies"),
]
# A duration phrase: number, upper number, unit to its word's end, or a bare hour in words; the first in the text counts.
DURATION = (f"(^|[^a-z0-9.])(([0-9]+(\\.[0-9]+)?)({SP}-{SP}([0-9]+(\\.[0-9]+)?))?{SP}-?{SP}(hour|hr|minute|min)s?|(an|one){SP}hour){B1}")
DURATION_GROUPS = {"from": 3, "to": 6, "unit": 8, "word": 9}
# Job levels, first match wins.
LEVEL_RULES = [
    (B0 + "(coo|ceo|cfo|cto|chief|executives?|vp|president)" + B1, "Executive"),
    (B0 + "(senior)" + B1, "Senior"),
    (B0 + "(graduates?|entry[- ]level|juniors?|freshers?|interns?)" + B1, "Entry-level"),
    (B0 + "(mid[- ]level|mid-professionals?|professionals?|experienced)" + B1, "Mid-Professional"),
]
# ---------------------------------------------------------------------------


def _low(c) -> Column:
    return F.lower(F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit("")))


def tag_types(text) -> Column:
    """Requested test types in rule order (each at most once)."""
    low = _low(text)
    return F.filter(F.array(*[F.when(low.rlike(p), F.lit(t)) for p, t in TYPE_RULES]), lambda x: x.isNotNull())


def parse_max_duration(text) -> Column:
    """I2: '40 minutes' -> 40, 'about an hour' -> 60, '1-2 hours' -> 120 (upper end), '1.5 hours' -> 90;
    of several phrases the first in the text.  A unit is a whole word: 'an hourly rate' and '5 minor issues' have none."""
    low, g = _low(text), DURATION_GROUPS
    number = F.coalesce(*[F.nullif(F.regexp_extract(low, DURATION, g[k]), F.lit("")) for k in ("to", "from")]).try_cast("double")
    minutes = F.when(F.regexp_extract(low, DURATION, g["unit"]).startswith("min"), number).otherwise(number * 60)
    return F.when(F.regexp_extract(low, DURATION, g["word"]) != "", F.lit(60)).otherwise(F.floor(minutes).try_cast("int"))


def parse_job_level(text) -> Column:
    """Executive / Senior / Entry-level / Mid-Professional, or NULL."""
    low = _low(text)
    e = None
    for p, lvl in LEVEL_RULES:
        e = F.when(low.rlike(p), F.lit(lvl)) if e is None else e.when(low.rlike(p), F.lit(lvl))
    return e


def tag_intent(text) -> Column:
    """Rule-based intent struct with the declared intent schema."""
    return F.struct(F.array().cast("array<string>").alias("skills"),
                    F.array().cast("array<string>").alias("soft_skills"),
                    parse_max_duration(text).alias("max_duration_minutes"),
                    parse_job_level(text).alias("job_level"),
                    tag_types(text).alias("required_test_types"))


def parse_intent_json(reply) -> Column:
    """I4: a structured reply -> typed intent; junk or missing keys -> NULL / []; a whole number of
    minutes counts as text or with a decimal point too; requested types kept only when in the allowed
    list (first occurrence, reply order)."""
    kind = ", ".join(f"{f.name} {'string' if f.name == 'max_duration_minutes' else f.dataType.simpleString()}" for f in S.INTENT.fields)
    j = F.from_json(F.col(reply) if isinstance(reply, str) else reply, kind)
    empty = F.array().cast("array<string>")
    allowed = F.array(*[F.lit(x) for x in S.ALLOWED_TEST_TYPES])
    minutes = j["max_duration_minutes"].try_cast("double")
    return F.struct(F.coalesce(j["skills"], empty).alias("skills"),
                    F.coalesce(j["soft_skills"], empty).alias("soft_skills"),
                    F.when(minutes == F.floor(minutes), minutes.try_cast("int")).alias("max_duration_minutes"),
                    j["job_level"].alias("job_level"),
                    F.array_intersect(F.coalesce(j["required_test_types"], empty), allowed)
                    .alias("required_test_types"))
