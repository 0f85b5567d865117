"""Seeded workloads: keys, values, mixes of operations, and a check of a store against what they say."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Shares of reads, writes and scans.
MIXES = {"read-heavy": (0.95, 0.05, 0.0), "balanced": (0.67, 0.30, 0.03), "write-heavy": (0.20, 0.80, 0.0), "scan-heavy": (0.40, 0.10, 0.50), "ingest-burst": (0.0, 1.0, 0.0)}
SEED, KEY_BYTES, VALUE_BYTES = 0x5EEDC0DE, 48, 160


def _bytes(seed, n: int):
    """n pseudo-random bytes that depend on the columns in ``seed``."""
    parts = [F.sha2(F.concat_ws(":", F.lit(i), *seed), 256) for i in range(-(-n // 32))]
    return F.substr(F.unhex(F.concat(*parts)), F.lit(1), F.lit(n))


def entries(spark: SparkSession, n: int, namespace: int = 0, seed: int = SEED) -> DataFrame:
    """id, key, value of ``n`` deterministic entries."""
    own = [F.lit(seed), F.lit(namespace), F.col("id")]
    return spark.range(n).select("id", _bytes([*own, F.lit("k")], KEY_BYTES).alias("key"), _bytes([*own, F.lit("v")], VALUE_BYTES).alias("value"))


def operations(spark: SparkSession, n: int, keys: int, mix: str = "balanced", seed: int = SEED) -> DataFrame:
    """id, op (read, write, scan) and the entry that each of ``n`` operations is on, uniformly."""
    read, write, _ = MIXES[mix]
    u = F.pmod(F.xxhash64(F.lit(seed), F.col("id"), F.lit("op")), F.lit(1 << 30)) / float(1 << 30)
    op = F.when(u < read, "read").when(u < read + write, "write").otherwise("scan")
    return spark.range(n).select("id", op.alias("op"), F.pmod(F.xxhash64(F.lit(seed), F.col("id"), F.lit("key")), F.lit(keys)).alias("entry"))


def differences(state: DataFrame, expected: DataFrame) -> DataFrame:
    """key, kind: keys that are missing, unexpected or hold another value."""
    a, b = state.select("key", F.col("value").alias("has")), expected.select("key", F.col("value").alias("should"))
    kind = F.when(F.col("has").isNull(), "missing").when(F.col("should").isNull(), "unexpected").when(F.col("has") != F.col("should"), "different")
    return a.join(b, "key", "full").select("key", kind.alias("kind")).filter("kind IS NOT NULL")
