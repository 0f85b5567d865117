"""A pipelined writer of operations: batches are written ahead, acknowledged in any order, published in order.

Staging writes a batch's files, in several threads; publishing is a manifest each, in order, so the published
watermark is the end of the longest prefix of staged batches.  After a failure the writer is poisoned: nothing
more is published until it is opened again, from what is published.

A batch's hash tree is made from its operations when it is staged, and its head chains the heads before it:
head = sha256(02 | head before | root of the batch).  The head at a watermark thus binds all operations up to it.

append() takes a client's operations, append_frame() those of a DataFrame: they are numbered, cut to batches, written
and hashed by tasks, and the driver sees a row a batch.  prove_batches() and verify_batches() are as distributed.
"""

from __future__ import annotations

from concurrent.futures import Future, ThreadPoolExecutor
from dataclasses import dataclass
from threading import Lock

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.proofs import BatchProof, Proof, ProofError, chain, hash_leaf, leaf_bytes, leaf_hash, prove_leaves, tree_root, verify_batch
from .log import CommitLog, Staged
from .tables import by_ranges, forget

OPS = T.StructType([T.StructField("location", T.LongType()), T.StructField("key", T.BinaryType()), T.StructField("value", T.BinaryType())])
MARK = T.StructType([T.StructField("location", T.LongType()), T.StructField("first", T.LongType()), T.StructField("root", T.BinaryType()), T.StructField("head", T.BinaryType())])


class Poisoned(RuntimeError):
    """The writer failed before; open another."""


@dataclass(frozen=True)
class _Ready:
    staged: Staged
    root: bytes


class OpLogWriter:
    def __init__(self, spark: SparkSession, root: str, ahead: int = 4):
        self.spark, self.log = spark, CommitLog(spark, root)
        self.pool, self.lock = ThreadPoolExecutor(ahead), Lock()
        marks = self.log.history("watermark", schema=MARK)
        top = None if marks is None else marks.agg(F.max(F.struct("location", "head")).alias("m")).first().m
        self.next = self.published = 0 if top is None else top.location + 1
        self.head = b"" if top is None else bytes(top.head)
        self.waiting: list[tuple[int, int, Future]] = []
        self.failed: BaseException | None = None

    def append(self, operations: list[tuple[bytes, bytes | None]]) -> Future:
        """Begin to write a batch of (key, value or None to delete); the future is done when its files are there."""
        if self.failed:
            raise Poisoned(str(self.failed))
        if not operations:
            raise ValueError("an empty batch")
        first = self.next
        rows = [(first + i, bytearray(k), None if v is None else bytearray(v)) for i, (k, v) in enumerate(operations)]
        self.next += len(rows)
        staged = self.pool.submit(self._stage, rows)
        self.waiting.append((first, self.next, staged))
        return staged

    def append_frame(self, operations: DataFrame, order: str, size: int) -> int:
        """Write the rows of key and value (null to delete), in order of ``order``, as batches of ``size``.

        Returns how many batches there are; their files are there, flush() publishes them.
        """
        if self.failed:
            raise Poisoned(str(self.failed))
        if size < 1:
            raise ValueError("a batch needs an operation")
        dealt = by_ranges(operations.select(F.col(order).alias("_o"), "key", "value"), "_o", label="operations")
        before = Window.orderBy("_p")  # a row a range
        sums = dealt.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"))
        sums = sums.select(F.col("_p").alias("_q"), (F.sum("_n").over(before) - F.col("_n")).alias("_base"))
        own = F.row_number().over(Window.partitionBy("_p").orderBy("_o")) - 1
        at = dealt.withColumn("_i", own).join(F.broadcast(sums), F.col("_p") == F.col("_q")).withColumn("_i", F.col("_base") + F.col("_i"))
        rows = at.select((F.lit(self.next) + F.col("_i")).cast("long").alias("location"), "key", "value", F.floor(F.col("_i") / size).cast("long").alias("_b"))
        path = self.log.write_parts("ops", rows)
        forget(dealt)
        # of what the files hold
        written = self.spark.read.schema(T.StructType([*OPS.fields, T.StructField("_b", T.LongType())])).parquet(path)
        leaves = written.select("_b", "location", leaf_hash("location", "key", "value").alias("h"))
        roots = leaves.groupBy("_b").applyInArrow(_root, "b long, first long, n long, root binary").orderBy("b").collect()  # a row a batch
        if not roots:
            raise ValueError("an empty batch")
        for r in roots:
            if r.first != self.next:
                raise ProofError(f"location {self.next} is missing")
            staged = Future()
            staged.set_result(_Ready(self.log.part("ops", path, r.b, r.n, OPS), bytes(r.root)))
            self.next += r.n
            self.waiting.append((r.first, self.next, staged))
        return len(roots)

    def _stage(self, rows) -> _Ready:
        hashes = [hash_leaf(leaf_bytes(i, bytes(k), None if v is None else bytes(v))) for i, k, v in rows]
        return _Ready(self.log.stage({"ops": self.spark.createDataFrame(rows, OPS)}), tree_root(hashes))

    def acknowledged(self) -> int:
        """Locations in the longest prefix of batches whose files are written, published or not."""
        end = self.published
        for _, stop, staged in self.waiting:
            if not staged.done() or staged.exception():
                break
            end = stop
        return end

    def flush(self) -> int:
        """Publish every staged batch in order, each with its watermark; returns the locations published.

        The watermarks of the batches that are staged are written at once; a batch that failed ends them.
        """
        with self.lock:
            if self.waiting and self.failed:
                raise Poisoned(str(self.failed))
            ready, error = [], None
            for first, end, staged in self.waiting:
                try:
                    ready.append((first, end, staged.result()))
                except BaseException as e:
                    error = e
                    break
            try:
                self._publish(ready)
                if error:
                    raise error
            except BaseException as e:
                self.failed = e
                self._discard()
                raise
        return self.published

    def _publish(self, ready: list[tuple[int, int, _Ready]]) -> None:
        head, marks = self.head, []
        for first, end, one in ready:
            head = chain(head, one.root)
            marks.append((end - 1, first, bytearray(one.root), bytearray(head)))
        if len(ready) == 1:
            staged = [self.log.stage({"watermark": self.spark.createDataFrame(marks, MARK)})]
        elif ready:
            rows = self.spark.createDataFrame([(*m, b) for b, m in enumerate(marks)], T.StructType([*MARK.fields, T.StructField("_b", T.LongType())]))
            path = self.log.write_parts("watermark", rows)
            staged = [self.log.part("watermark", path, b, 1, MARK) for b in range(len(marks))]
        else:
            return
        both = [Staged(one.staged.batch, one.staged.tables | m.tables, one.staged.rows | m.rows) for (_, _, one), m in zip(ready, staged, strict=True)]
        for (_, end, _), mark, _ in zip(ready, marks, self.log.publish_each(both), strict=True):
            self.waiting.pop(0)
            self.published, self.head = end, bytes(mark[3])

    def _discard(self) -> None:
        """Files of batches that will not be published go."""
        for _, _, staged in self.waiting:
            if staged.exception() is None and isinstance(ready := staged.result(), _Ready):
                self.log.discard(ready.staged)

    def operations(self) -> DataFrame:
        got = self.log.history("ops", schema=OPS)
        return got if got is not None else self.spark.createDataFrame([], T.StructType([*OPS.fields, T.StructField("seq", T.LongType())]))

    def watermarks(self) -> DataFrame:
        got = self.log.history("watermark", schema=MARK)
        return got.select("location") if got is not None else self.spark.createDataFrame([], "location long")


def _root(leaves):
    """A batch's number, first location, size and root; its locations are dense."""
    import pyarrow as pa

    leaves = leaves.sort_by("location")
    at, n = leaves["location"].to_pylist(), leaves.num_rows
    if at != list(range(at[0], at[0] + n)):
        raise ProofError("locations have holes")
    return pa.table({"b": pa.array([leaves["_b"][0].as_py()], pa.int64()), "first": pa.array([at[0]], pa.int64()), "n": pa.array([n], pa.int64()), "root": pa.array([tree_root(leaves["h"].to_pylist())], pa.binary())})


def prove_batch(log: CommitLog, seq: int, locations: list[int]) -> BatchProof:
    """Proof of some operations of batch ``seq`` against its head; a batch is what one client appended at once."""
    mark = log.get(seq, "watermark").first()
    rows = sorted(log.get(seq, "ops").select("location", "key", "value").collect(), key=lambda r: r.location)
    hashes = [hash_leaf(leaf_bytes(r.location, bytes(r.key), None if r.value is None else bytes(r.value))) for r in rows]
    if tree_root(hashes) != bytes(mark.root):
        raise ProofError(f"batch {seq} is not what its root says")
    earlier = log.history("watermark", 0, seq - 1, MARK) if seq > 1 else None
    before = None if earlier is None else earlier.filter(F.col("location") == mark.first - 1).first()
    return BatchProof(mark.first, b"" if before is None else bytes(before.head), prove_leaves(hashes, [x - mark.first for x in locations]))


_SIBLING = T.StructType([T.StructField("level", T.IntegerType()), T.StructField("i", T.LongType()), T.StructField("h", T.BinaryType())])
PROOFS = T.StructType([T.StructField("seq", T.LongType()), T.StructField("root", T.BinaryType()), T.StructField("size", T.LongType()), T.StructField("locations", T.ArrayType(T.LongType())), T.StructField("siblings", T.ArrayType(_SIBLING))])
PROVEN = T.StructType([T.StructField("seq", T.LongType()), T.StructField("location", T.LongType()), T.StructField("proven", T.BooleanType())])


def _prove(leaves, asked):
    """prove_batch() of one batch where its leaves' hashes are; a batch of which nothing is asked gives nothing."""
    import pyarrow as pa

    schema = pa.schema([("seq", pa.int64()), ("root", pa.binary()), ("size", pa.int64()), ("locations", pa.list_(pa.int64())), ("siblings", pa.list_(pa.struct([("level", pa.int32()), ("i", pa.int64()), ("h", pa.binary())])))])
    if not asked.num_rows:
        return schema.empty_table()
    if not leaves.num_rows:
        raise ProofError(f"batch {asked['seq'][0].as_py()} has no operations")
    leaves = leaves.sort_by("location")
    hashes, first = leaves["h"].to_pylist(), leaves["location"][0].as_py()
    proof = prove_leaves(hashes, [x - first for x in asked["location"].to_pylist()])
    siblings = [{"level": lv, "i": i, "h": h} for lv, i, h in proof.siblings]
    return pa.Table.from_pylist([{"seq": leaves["seq"][0].as_py(), "root": tree_root(hashes), "size": proof.size, "locations": list(proof.locations), "siblings": siblings}], schema)


def prove_batches(log: CommitLog, rows: DataFrame) -> DataFrame:
    """prove_batch() of all batches of ``rows`` (seq and location): a row a batch, each made by one task.

    first, before, size, locations and siblings are those of a BatchProof.
    """
    low, high = rows.agg(F.min("seq"), F.max("seq")).first()
    ops, marks = log.read("ops", low - 1, high, OPS), log.history("watermark", max(low - 2, 0), high, MARK)
    leaves = ops.select("seq", "location", leaf_hash("location", "key", "value").alias("h"))
    made = leaves.groupBy("seq").cogroup(rows.select("seq", "location").groupBy("seq")).applyInArrow(_prove, PROOFS)
    earlier = marks.select((F.col("location") + 1).alias("first"), F.col("head").alias("before"))
    marks = marks.select("seq", "first", F.col("root").alias("_root")).join(earlier, "first", "left")
    wrong = F.raise_error(F.concat(F.lit("not what its root says: batch "), F.col("seq").cast("string"))).cast("boolean")
    told = made.join(marks, "seq").filter(F.when(F.col("root") == F.col("_root"), F.lit(True)).otherwise(wrong))
    return told.select("seq", "first", F.coalesce("before", F.lit(bytearray(b""))).alias("before"), "size", "locations", "siblings")


def _verify(rows, proofs):
    """verify_batch() of one batch."""
    import pyarrow as pa

    if proofs.num_rows != 1:
        raise ProofError(f"a batch has {proofs.num_rows} proofs")
    p = proofs.to_pylist()[0]
    leaves = {r["location"]: leaf_bytes(r["location"], r["key"], r["value"]) for r in rows.to_pylist()}
    proof = Proof(p["size"], tuple(p["locations"]), tuple((s["level"], s["i"], s["h"]) for s in p["siblings"]))
    verify_batch(p["head"], BatchProof(p["first"], p["before"], proof), leaves)
    return pa.table({"seq": rows["seq"], "location": rows["location"], "proven": pa.array([True] * rows.num_rows, pa.bool_())})


def verify_batches(heads: DataFrame, rows: DataFrame, proofs: DataFrame) -> DataFrame:
    """seq, location and proven of ``rows``, which are raised upon unless ``proofs`` show them under the trusted
    ``heads`` (first and head of each batch)."""
    known = proofs.join(heads.select("first", "head"), "first", "left")
    asked = rows.select("seq", "location", "key", "value")
    return asked.groupBy("seq").cogroup(known.groupBy("seq")).applyInArrow(_verify, PROVEN)
