"""All registered queries and their DuckDB oracle SQL, collected from the plan modules."""

from __future__ import annotations

from rankframe.plans import catalog, dense, hybrid, ranking, recommend, sparse

MODULES = [sparse, dense, hybrid, catalog, ranking, recommend]


def queries() -> dict:
    out = {}
    for m in MODULES:
        out.update(m.QUERIES)
    return out


def oracle_sql() -> dict:
    out = {}
    for m in MODULES:
        out.update(m.SQL)
    return out
