"""Queries over the driver's tables, one for each operator or family of operators, and their SQL."""

from __future__ import annotations

from lodestone.plans import evidence, machines, operations, recorded, tasks, web


def queries() -> dict:
    return {**evidence.QUERIES, **operations.QUERIES, **tasks.QUERIES, **machines.QUERIES, **web.QUERIES, **recorded.QUERIES}


def oracle_sql() -> dict[str, str]:
    return {**evidence.SQL, **operations.SQL, **tasks.SQL, **machines.SQL, **web.SQL, **recorded.SQL}
