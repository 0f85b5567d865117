"""All queries of the engine and the SQL that each is checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import aggregates, relational, scans, surfaces, versions

FAMILIES = (scans.R, relational.R, aggregates.R, versions.R, surfaces.R)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.R.queries["m0_flagship"](spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for r in FAMILIES for k, f in r.queries.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for r in FAMILIES for k, s in r.oracle.items()}
