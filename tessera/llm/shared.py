"""Helpers of the training-data operators: the library's shared tables, file access, naming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import forget, materialize, shared_dir

__all__ = ["BROADCAST_ROWS", "forget", "lean_batches", "local_path", "materialize", "open_fs", "shared_dir", "small", "without"]

#: Rows up to which a per-source or per-dimension table is broadcast; beyond it Spark joins by shuffle.
BROADCAST_ROWS = 100_000


#: Bytes of an Arrow batch: texts are long, and a batch is held in several copies on both sides of a worker.
BATCH_BYTES, BATCH_KEY = str(8 << 20), "spark.sql.execution.arrow.maxBytesPerBatch"


def lean_batches(spark: SparkSession) -> None:
    """Smaller Arrow batches than Spark's default, unless the session has a size of its own."""
    if spark.conf.get(BATCH_KEY).rstrip("b") == str(64 << 20):
        spark.conf.set(BATCH_KEY, BATCH_BYTES)


def small(df: DataFrame, rows: int) -> DataFrame:
    """``df`` with a broadcast hint if it has few enough rows, else as it is."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def without(df: DataFrame, *names: str) -> DataFrame:
    """``df`` without columns that clash (in any case of letters) with an operator's own."""
    taken = {n.lower() for n in names}
    return df.drop(*[c for c in df.columns if c.lower() in taken])


#: Schemes of Spark's own connectors, and what pyarrow calls the same stores.
SCHEMES = {"s3a": "s3", "s3n": "s3", "wasb": "abfs", "wasbs": "abfss"}


def open_fs(uri: str):
    """(file system, path) of a shared folder, for Python workers: what pyarrow knows, and Spark's names of it."""
    from pyarrow import fs

    scheme, colon, rest = uri.partition("://")
    if colon and scheme in SCHEMES:
        uri = f"{SCHEMES[scheme]}://{rest.replace('.blob.core.', '.dfs.core.')}"
    return fs.FileSystem.from_uri(uri)


def local_path(uri: str) -> str | None:
    """The path of a file: URI, which can be memory-mapped; None for other stores."""
    if uri.startswith("file:"):
        return "/" + uri[5:].lstrip("/")
    return uri if uri.startswith("/") else None
