"""Every query of the core and its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from strataloom.plans import catalog, engine, extraction, fixtures, problems

PARTS = [problems, catalog, extraction, engine, fixtures]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    out: dict = {}
    for part in PARTS:
        out |= part.QUERIES
    return out


def oracle_sql() -> dict[str, str]:
    out: dict = {}
    for part in PARTS:
        out |= part.ORACLE
    return out


def flagship(spark: SparkSession, d: str) -> DataFrame:
    return problems.p3_state_counts(spark, d)
