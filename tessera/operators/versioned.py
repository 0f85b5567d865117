"""Rows with versions: the latest at or below a version, exact versions, the last few."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest_at(df: DataFrame, keys: list[str], version: str, at: int | None = None) -> DataFrame:
    """Of each key the row with the greatest version not above ``at``.

    An aggregate (max_by), so rows are combined before the shuffle and a hot key costs one row a task.
    """
    if at is not None:
        df = df.filter(F.col(version) <= at)
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(version)).alias("_r"))
    return best.select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest]).select(*df.columns)


def exact(df: DataFrame, keys: dict, version: str, at: int) -> DataFrame:
    for k, v in keys.items():
        df = df.filter(F.col(k) == F.lit(v))
    return df.filter(F.col(version) == at)


def history(df: DataFrame, keys: dict, version: str, limit: int | None = None) -> DataFrame:
    """All versions of one key, latest first."""
    for k, v in keys.items():
        df = df.filter(F.col(k) == F.lit(v))
    df = df.orderBy(F.desc(version))
    return df if limit is None else df.limit(limit)


def keep_latest(df: DataFrame, group: list[str], order: Column | str, n: int) -> DataFrame:
    """The ``n`` rows of each group that come last by ``order``; Spark limits groups before the shuffle."""
    if n < 1:
        raise ValueError("keep at least one")
    order = F.col(order) if isinstance(order, str) else order
    by = Window.partitionBy(*group).orderBy(order.desc())
    return df.withColumn("_rn", F.row_number().over(by)).filter(F.col("_rn") <= n).drop("_rn")
