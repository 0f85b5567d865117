"""Tables from files, with a declared schema (nothing is inferred)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..spec import SpecError, TableSpec

FORMATS = ("parquet", "orc", "csv", "json", "avro", "jdbc")


def read(spark: SparkSession, spec: TableSpec, path: str | None = None, format: str = "parquet", **options) -> DataFrame:
    """The declared columns of a file or JDBC table; columns that are not declared are not read."""
    if format not in FORMATS:
        raise SpecError(f"no format {format}")
    reader = spark.read.format(format).options(**options)
    if format != "jdbc":
        reader = reader.schema(spec.schema)
    if format == "csv":
        reader = reader.option("header", options.get("header", True)).option("enforceSchema", False)
    return (reader.load(path) if path else reader.load()).select(*[c.name for c in spec.columns])


def write(df: DataFrame, path: str, format: str = "parquet", partition_by: list[str] | None = None, sort_by: list[str] | None = None, **options) -> None:
    """Write ``df``; with ``sort_by`` dealt by ranges and sorted, so that readers skip files."""
    if sort_by:
        df = df.repartitionByRange(*[*(partition_by or []), *sort_by]).sortWithinPartitions(*[*(partition_by or []), *sort_by])
    writer = df.write.format(format).options(**options)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.save(path)
