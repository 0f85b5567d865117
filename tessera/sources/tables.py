"""Intermediate tables in the shared folder, and dealing rows by ranges."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """A new folder of this application below spark.checkpoint.dir, which driver and executors share.

    Only a local master without that setting (tests, a laptop) has a temporary folder of its own: on a cluster
    tasks would write to their own disks, so there it raises.  All folders of an application are deleted when
    it ends; results that are to stay are written elsewhere.
    """
    context = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir", None)
    if not root:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = _local.setdefault(context.applicationId, "file://" + tempfile.mkdtemp(prefix="tessera-"))
    own = f"{root.rstrip('/')}/tessera/{context.applicationId}"
    if own not in _ending:
        _ending.add(own)
        path = context._jvm.org.apache.hadoop.fs.Path(own)
        fs = path.getFileSystem(context._jsc.hadoopConfiguration())
        fs.mkdirs(path)
        fs.deleteOnExit(path)
    return f"{own}/{uuid.uuid4().hex}"


#: Temporary folders of local applications, and folders that go when their application ends.
_local: dict[str, str] = {}
_ending: set[str] = set()


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    This cuts the lineage with a copy that outlives executors, and gives Catalyst the table's true size, so
    that broadcast joins are chosen behind a check of it.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def forget(*tables: DataFrame) -> None:
    """Delete tables that materialize() wrote and that nothing reads any more."""
    for df in tables:
        context = df.sparkSession.sparkContext
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            if "/tessera/" in folder:
                path = context._jvm.org.apache.hadoop.fs.Path(folder)
                path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def by_ranges(df: DataFrame, *order: Column | str, label: str = "ranged") -> DataFrame:
    """``df`` dealt by ranges of ``order``, with the range's number as ``_p`` (written, so that it stays).

    Global running sums and neighbours then need a window inside each range and one over a row a range.
    """
    return materialize(df.repartitionByRange(*order).withColumn("_p", F.spark_partition_id()), label)
