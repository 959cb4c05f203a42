"""Queries of the core and their SQL, collected from their modules."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from rowan import queries_core, queries_nested, queries_tables

MODULES = (queries_core, queries_nested, queries_tables)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {n: q for m in MODULES for n, q in m.QUERIES.items()}


def oracles() -> dict[str, str]:
    return {n: q for m in MODULES for n, q in m.ORACLES.items()}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queries_core.QUERIES["flagship_revenue"](spark, sf_dir)
