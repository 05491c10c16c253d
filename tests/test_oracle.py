"""Every registered query with oracle SQL agrees with DuckDB on the sf0.001 tables."""

import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

import __spark_entry__ as E  # noqa: E402
import oracle_check as OC  # noqa: E402
from conftest import SMALL  # noqa: E402

from rankframe.plans import registry  # noqa: E402

KEYS = sorted(registry.oracle_sql())


@pytest.fixture(scope="module")
def con():
    return OC.duck(SMALL)


@pytest.mark.parametrize("key", KEYS)
def test_query_matches_oracle(spark, con, key):
    info = OC.compare(spark, con, key, E.queries()[key], E.oracle_sql()[key], SMALL)
    assert info["ok"], info


def test_every_query_has_entry_and_runs(spark):
    assert set(registry.oracle_sql()) == set(registry.queries()) <= set(E.queries())
    df = E.entry(spark)
    assert df.count() >= 0 and df.columns == ["query_id", "recall"]
