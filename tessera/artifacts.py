"""Consensus artifacts: headers and blocks by digest, certificates by view and height."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .sources.log import CommitLog

DIGEST = T.StructType([T.StructField("digest", T.BinaryType()), T.StructField("payload", T.BinaryType())])
CERTIFICATE = T.StructType([T.StructField("position", T.LongType()), T.StructField("digest", T.BinaryType()), T.StructField("payload", T.BinaryType())])
# kind of record -> schema; finalized certificates are kept by view and by height
KINDS = {"header": DIGEST, "block": DIGEST, "notarized": CERTIFICATE, "finalized_by_view": CERTIFICATE, "finalized_by_height": CERTIFICATE}


class Artifacts:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.log = spark, CommitLog(spark, root)

    def upload(self, headers=(), blocks=(), notarized=(), finalized=()) -> int:
        """One batch.  headers, blocks: (digest, payload); notarized: (view, digest, payload);
        finalized: (view, height, digest, payload).  A certificate names the digest of a header that is there."""
        known = {bytes(d) for d, _ in headers}
        for d in {bytes(x[-2]) for x in (*notarized, *finalized)} - known:
            if self.by_digest("header", d) is None:
                raise ValueError(f"no header {d.hex()}")
        rows = {"header": list(headers), "block": list(blocks), "notarized": list(notarized), "finalized_by_view": [(v, d, p) for v, _, d, p in finalized], "finalized_by_height": [(h, d, p) for _, h, d, p in finalized]}
        return self.log.commit({k: self.spark.createDataFrame(r, KINDS[k]) for k, r in rows.items() if r}).seq

    def put(self, frames: dict[str, DataFrame]) -> int:
        """One batch from frames by kind; certificates must name a header that is there or in the batch."""
        for kind, df in frames.items():
            frames[kind] = df.select(*[F.col(f.name).cast(f.dataType) for f in KINDS[kind]])
        heads = self.records("header").select("digest")
        if "header" in frames:
            heads = heads.union(frames["header"].select("digest"))
        for kind, df in frames.items():
            if KINDS[kind] is CERTIFICATE and df.join(heads, "digest", "left_anti").limit(1).count():
                raise ValueError(f"a {kind} certificate names no header")
        return self.log.commit(frames).seq

    def records(self, kind: str) -> DataFrame:
        got = self.log.history(kind, schema=KINDS[kind])
        return got if got is not None else self.spark.createDataFrame([], T.StructType([*KINDS[kind].fields, T.StructField("seq", T.LongType())]))

    def _one(self, kind: str, where) -> bytes | None:
        got = self.records(kind).filter(where).orderBy(F.desc("seq")).select("payload").take(1)
        return bytes(got[0].payload) if got else None

    def by_digest(self, kind: str, digest: bytes) -> bytes | None:
        return self._one(kind, F.col("digest") == F.lit(bytearray(digest)))

    def by_position(self, kind: str, position: int) -> bytes | None:
        return self._one(kind, F.col("position") == position)

    def latest_finalized(self) -> tuple[int, bytes] | None:
        got = self.records("finalized_by_height").agg(F.max(F.struct("position", "payload")).alias("m")).first().m
        return (got.position, bytes(got.payload)) if got else None

    def mismatched(self, kind: str) -> DataFrame:
        """Certificates whose digest is no header's."""
        return self.records(kind).join(self.records("header").select("digest"), "digest", "left_anti")

    def certified(self, kind: str) -> DataFrame:
        """position, digest, payload and header of certificates, joined to the headers whose digest they name."""
        heads = self.records("header").groupBy("digest").agg(F.max_by("payload", "seq").alias("header"))
        return self.records(kind).select("position", "digest", "payload").join(heads, "digest")
