"""What the query modules share: tables of a folder, views, and a registry."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class Registry:
    """Queries by name with the SQL that gives the same rows."""

    def __init__(self):
        self.queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self.oracle: dict[str, str] = {}

    def add(self, sql: str | None = None, name: str | None = None):
        """Decorator: the function is a query; ``sql`` is its oracle."""

        def put(f):
            key = name or f.__name__
            self.queries[key] = f
            if sql is not None:
                self.oracle[key] = sql
            return f

        return put

    def sql(self, name: str, tables: str, spark_sql: str, oracle: str | None = None) -> None:
        """A query in SQL over ``tables``; the oracle is the same text unless the dialects differ."""
        names = tables.split()

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            for t in names:
                table(spark, sf_dir, t).createOrReplaceTempView(t)
            return spark.sql(spark_sql)

        self.queries[name] = run
        self.oracle[name] = oracle or spark_sql
