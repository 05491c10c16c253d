"""Intent rules on the fixture sample queries (FIXTURES §1.5)."""

from pyspark.sql import functions as F

from rankframe.functions.intent import parse_intent_json, parse_job_level, parse_max_duration, tag_types

QUERIES = [
    ("I am hiring for Java developers who can collaborate effectively with my business teams. "
     "Looking for an assessment that can be completed in 40 minutes.",
     ["Knowledge & Skills", "Personality & Behavior"], 40, None),
    ("I am looking for a COO for my company in China and I want to see if they are culturally a right fit "
     "for our company. Suggest me an assessment that they can complete in about an hour",
     ["Personality & Behavior", "Competencies"], 60, "Executive"),
    ("I want to hire new graduates for a sales role in my company, the budget is for about an hour for each test.",
     [], 60, "Entry-level"),
    ("Senior Data Analyst with 5 years of experience and expertise in SQL, Excel and Python. "
     "The assessment can be 1-2 hour long", ["Knowledge & Skills", "Competencies"], 120, "Senior"),
    ("Content Writer required, expert in English and SEO.", ["Knowledge & Skills"], None, None),
]


def test_rules(spark):
    df = spark.createDataFrame([(q,) for q, *_ in QUERIES], "q string")
    rows = df.select(tag_types("q").alias("t"), parse_max_duration("q").alias("d"),
                     parse_job_level("q").alias("l")).collect()
    for r, (_, types, dur, lvl) in zip(rows, QUERIES):
        assert r.t == types and r.d == dur and r.l == lvl


def test_parse_intent_json(spark):
    df = spark.createDataFrame([('{"required_test_types": ["Simulations", "Bogus", "Simulations"], "job_level": "Senior"}',),
                                ("not json",), ('{"max_duration_minutes": 30}',)], "r string")
    rows = df.select(parse_intent_json("r").alias("i")).select("i.*").collect()
    assert rows[0].required_test_types == ["Simulations"] and rows[0].job_level == "Senior"
    assert rows[1].required_test_types == [] and rows[1].max_duration_minutes is None
    assert rows[2].max_duration_minutes == 30 and rows[2].skills == []


def test_phrases(spark):
    given = [("1.5 hours", 90, None), ("30 mins and 1 hour coffee", 30, None), ("internal role", None, None), ("presenior", None, None),
             ("30 to 40 minutes", 40, None), ("a 90-minute test for interns", 90, "Entry-level"), ("1 - 2 hrs", 120, None), (None, None, None)]
    df = spark.createDataFrame([(g[0],) for g in given], "q string")
    rows = df.select(parse_max_duration("q").alias("d"), parse_job_level("q").alias("l")).collect()
    assert [(r.d, r.l) for r in rows] == [(d, l) for _, d, l in given]


def test_minutes_in_replies(spark):
    given = [('{"max_duration_minutes": "40"}', 40), ('{"max_duration_minutes": 40.0}', 40), ('{"max_duration_minutes": 40.5}', None),
             ('{"max_duration_minutes": "soon"}', None), ('{"max_duration_minutes": null}', None)]
    df = spark.createDataFrame([(g[0],) for g in given], "r string")
    assert [r[0] for r in df.select(parse_intent_json("r").max_duration_minutes).collect()] == [m for _, m in given]


def test_units_are_whole_words(spark):
    given = [("an hourly rate", None), ("5 minor issues", None), ("30 minimum", None), ("2 hours.", 120), ("45 minutes", 45), ("3 hrs", 180),
             ("90min", 90), ("one hour", 60), ("10 hourly tasks, 20 min each", 20), ("an hour-long test", 60), ("1 hr/2", 60)]
    got = spark.createDataFrame([(t,) for t, _ in given], "q string").select(parse_max_duration("q").alias("m")).collect()
    assert [r.m for r in got] == [m for _, m in given]
