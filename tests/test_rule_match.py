"""Rules found by the automaton are those that one regular expression per rule finds."""

import random
import re

import pytest
from pyspark.sql import functions as F

from rankframe.functions import intent as I
from rankframe.operators import rule_match as M


def test_ten_thousand_rules_in_one_pass(spark):
    r = random.Random(1)
    word = lambda: "".join(r.choice("abc1 -") for _ in range(r.randint(1, 5)))
    rules = [(i, word(), f"l{i % 7}", r.random() < 0.5, r.random() < 0.5) for i in range(10_000)] + [(10_001, "", "x", False, False), (10_002, "ÜB", "ü", True, True)]
    texts = ["".join(r.choice("abcABC1 -_.") for _ in range(r.choice((0, 5, 60)))) for _ in range(40)] + ["a üb-b", "aÜb", None, ""]
    table = spark.createDataFrame([(i, t, "kept") for i, t in enumerate(texts)], "id long, text string, labels string")
    got = M.match_rules(table, spark.createDataFrame(rules, M.RULES), "text").collect()
    patterns = [(i, re.compile((r"(?<![a-z0-9])" if a else "") + re.escape(p.lower()) + (r"(?![a-z0-9])" if b else "")), l) for i, p, l, a, b in rules if p]
    assert len(got) == len(texts)
    for row in got:
        found = [(i, l) for i, p, l in patterns if p.search((texts[row.id] or "").lower())]
        assert row.rule_ids == [i for i, _ in found]
        assert row.labels == list(dict.fromkeys(l for _, l in found))


def test_type_rules_as_a_table(spark):
    assert M.phrases_of("entry[- ]levels?") == ["entry-level", "entry-levels", "entry level", "entry levels"]
    rules = M.rules_of_patterns(spark, I.TYPE_RULES)
    said = ["Java developer", "developers, teamwork", "culturally fit", "leading head of data", "seniority", "CEO", "head  of", None, "reasoning; SQL", "scoop toolset"]
    table = spark.createDataFrame([(t,) for t in said], "q string")
    got = M.match_rules(table, rules, "q").select("labels", I.tag_types("q").alias("t")).collect()
    assert [r.labels for r in got] == [r.t for r in got]
    with pytest.raises(ValueError):
        M.rules_of_patterns(spark, [("a.*(b)", "x")])


def test_bounds_and_empty_tables(spark, monkeypatch):
    table = spark.createDataFrame([(1, "a b")], "id long, text string")
    none = spark.createDataFrame([], M.RULES)
    assert M.match_rules(table, none, "text").first()["rule_ids"] == []
    assert M.match_rules(table.limit(0), none, "text").count() == 0
    monkeypatch.setattr(M, "MAX_RULES", 1)
    with pytest.raises(ValueError):
        M.match_rules(table, spark.createDataFrame([(1, "a", "x", False, False), (2, "b", "x", False, False)], M.RULES), "text")
    assert M.match_rules(table, spark.createDataFrame([(1, "B", "x", True, True)], M.RULES), "text").select(F.size("labels")).first()[0] == 1
