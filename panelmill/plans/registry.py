"""All registered queries and their SQL."""

from __future__ import annotations

from panelmill.plans import estimation, lowrank, relational


def queries() -> dict:
    return relational.QUERIES | estimation.QUERIES | lowrank.QUERIES


def oracle_sql() -> dict[str, str]:
    return relational.ORACLE_SQL | estimation.ORACLE_SQL | lowrank.ORACLE_SQL
