"""Every llm query and its SQL."""

from __future__ import annotations

from strataloom.llm import queries as _q


def queries() -> dict:
    return dict(_q.QUERIES)


def oracle_sql() -> dict:
    return dict(_q.ORACLE)
