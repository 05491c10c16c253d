"""Filters (F1-F3) and scoring expressions (C1-C7) over a candidate frame.

A candidate frame has one row per (query, item) with the item's columns (``test_types``,
``duration_minutes``, ``job_levels``, ``assessment_name``, ``assessment_url``), the query's intent
columns (``max_duration_minutes``, ``job_level``, ``required_test_types``) and retrieval columns
(``sim``, ``pos``).  Everything here is a row-local expression: no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankframe import schemas as S

GENERIC_TYPES = ["Personality & Behavior", "Ability & Aptitude"]


def _arr(c: str) -> Column:
    return F.coalesce(F.col(c), F.array().cast("array<string>"))


# ----------------------------------------------------------------------------- filters
def duration_ok(keep_unknown: bool = False) -> Column:
    """no limit -> keep; limit -> keep items with duration <= limit; unknown -> drop (or keep)."""
    mx, d = F.col("max_duration_minutes"), F.col("duration_minutes")
    unknown = F.lit(keep_unknown)
    return mx.isNull() | F.when(d.isNull(), unknown).otherwise(d <= mx)


def level_ok() -> Column:
    """no level asked (NULL or '') -> keep; else the level must be in the item's list."""
    lv = F.col("job_level")
    return lv.isNull() | (lv == "") | F.array_contains(_arr("job_levels"), lv)


def filter_duration(c: DataFrame, keep_unknown: bool = False) -> DataFrame:
    return c.where(duration_ok(keep_unknown))


def filter_job_level(c: DataFrame) -> DataFrame:
    return c.where(level_ok())


def filter_candidates(c: DataFrame, keep_unknown: bool = False) -> DataFrame:
    """F1 and F2."""
    return c.where(duration_ok(keep_unknown) & level_ok())


# ----------------------------------------------------------------------------- scores
def _duration_points(full: float, near: float, slack: int = 15) -> Column:
    """A max or a duration that is 0 or NULL is neutral; <= max -> full, <= max + slack -> near."""
    mx, d = F.col("max_duration_minutes"), F.col("duration_minutes")
    active = mx.isNotNull() & (mx != 0) & d.isNotNull() & (d != 0)
    return (F.when(~active, F.lit(0.0)).when(d <= mx, F.lit(full))
            .when(d <= mx + slack, F.lit(near)).otherwise(F.lit(0.0)))


def soft_score() -> Column:
    """+3 per required type the item has (each listed type counts), +2/+1 duration, +1 level."""
    types = _arr("test_types")
    n = F.size(F.filter(_arr("required_test_types"), lambda t: F.array_contains(types, t)))
    lv = F.col("job_level")
    level = F.when(lv.isNotNull() & (lv != "") & F.array_contains(_arr("job_levels"), lv), F.lit(1.0)) \
        .otherwise(F.lit(0.0))
    return F.lit(3.0) * n + _duration_points(2.0, 1.0) + level


def generic_bonus(value: float = 0.5) -> Column:
    """Bonus when the item has one of the generic types."""
    g = F.array(*[F.lit(x) for x in GENERIC_TYPES])
    return F.when(F.arrays_overlap(_arr("test_types"), g), F.lit(value)).otherwise(F.lit(0.0))


def weighted_score(w_sim: float = 0.55, w_intent: float = 0.30, w_generic: float = 0.15) -> Column:
    """w_sim * sim + w_intent * soft score + w_generic * generic bonus."""
    return (F.lit(w_sim) * F.col("sim") + F.lit(w_intent) * soft_score()
            + F.lit(w_generic) * generic_bonus())


def intent_score_capped() -> Column:
    """C4: 2 per matched distinct type (at most 2 count) + 1.5 / 0.5 duration; no level term."""
    m = F.size(F.array_intersect(F.array_distinct(_arr("required_test_types")), _arr("test_types")))
    return F.least(m, F.lit(2)) * F.lit(2.0) + _duration_points(1.5, 0.5)


def keyword_bonus(keywords=S.CANONICAL_KEYWORDS, value: float = 2.5) -> Column:
    """Bonus when the lower-cased name or URL contains any keyword."""
    name = F.lower(F.coalesce(F.col("assessment_name"), F.lit("")))
    url = F.lower(F.coalesce(F.col("assessment_url"), F.lit("")))
    hit = F.lit(False)
    for k in keywords:
        hit = hit | name.contains(k) | url.contains(k)
    return F.when(hit, F.lit(value)).otherwise(F.lit(0.0))


def role_adjustment(plus=S.ROLE_PLUS_WORDS, minus=S.ROLE_MINUS_WORDS, up: float = 1.0,
                    down: float = -1.5) -> Column:
    """+1 when the name has a plus word, else -1.5 when it has a minus word, else 0."""
    name = F.lower(F.coalesce(F.col("assessment_name"), F.lit("")))
    p = F.lit(False)
    for w in plus:
        p = p | name.contains(w)
    m = F.lit(False)
    for w in minus:
        m = m | name.contains(w)
    return F.when(p, F.lit(up)).when(m, F.lit(down)).otherwise(F.lit(0.0))


def weighted_bonus_score(w_sim: float = 0.45, w_intent: float = 0.25, keywords=S.CANONICAL_KEYWORDS,
                         plus=S.ROLE_PLUS_WORDS, minus=S.ROLE_MINUS_WORDS) -> Column:
    """w_sim * sim + w_intent * capped intent + keyword bonus + role adjustment."""
    return (F.lit(w_sim) * F.col("sim") + F.lit(w_intent) * intent_score_capped()
            + keyword_bonus(keywords) + role_adjustment(plus, minus))
