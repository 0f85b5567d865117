"""Live batches: a streaming source whose offset is the sequence number, and subscriptions on it.

``since`` unset or 0 starts after what is published now; ``since=N`` replays from batch N on and goes on live.
A batch is never split: a micro-batch takes whole numbers.  A checkpoint is the resume cursor.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.streaming import StreamingQuery

from ..operators.predicates import Selector, ValueFilter, stream_filter
from ..sources.log import CommitLog, LogError, Store

FORMAT = "tessera_log"
LOOKAHEAD = 8  # batches that a micro-batch takes at most, unless told otherwise


PART = 16 << 20  # bytes of files that one task reads, if there are several


class _Part(InputPartition):
    """Files with the numbers of their batches."""

    def __init__(self, files: list[tuple[int, str]]):
        self.files = files


class LogReader(DataSourceStreamReader):
    """Lists manifests on the driver and reads a batch's files in tasks, through pyarrow's file systems.

    A micro-batch takes at most ``maxBatches`` batches after the last offset: the one handed out before, the
    initial one, or, after a restart, the one that the checkpoint's offset log ends with.
    """

    def __init__(self, schema: T.StructType, options: dict):
        from pyarrow import fs

        options = {k.lower(): v for k, v in options.items()}
        self.schema, self.table, self.since = schema, options["table"], int(options.get("since", 0))
        self.step, self.until = int(options.get("maxbatches", LOOKAHEAD)), int(options.get("until", 1 << 62))
        self.root, self.checkpoint = options["root"], options.get("checkpoint")
        self.fs, self.path = fs.FileSystem.from_uri(self.root)
        self.seen: int | None = None
        self.first: int | None = None

    def _names(self, folder: str) -> list[str]:
        from pyarrow import fs

        return [f.base_name for f in self.fs.get_file_info(fs.FileSelector(f"{self.path}/{folder}", allow_not_found=True))]

    def _floor(self) -> int:
        return max((int(n[6:]) for n in self._names("retention") if n.startswith("floor-")), default=1)

    def _top(self) -> int:
        """The last published number."""
        return max([*(int(n[:-5]) for n in self._names("manifest") if n.endswith(".json")), self._floor() - 1, 0])

    def _resumed(self) -> int | None:
        """The offset that the checkpoint ends with; None in a new one."""
        from pyarrow import fs

        if not self.checkpoint:
            return None
        store, path = fs.FileSystem.from_uri(self.checkpoint if ":" in self.checkpoint else f"file://{self.checkpoint}")
        found = store.get_file_info(fs.FileSelector(f"{path}/offsets", allow_not_found=True))
        last = max((int(f.base_name) for f in found if f.base_name.isdigit()), default=None)
        if last is None:
            return None
        with store.open_input_stream(f"{path}/offsets/{last}") as f:
            return int(json.loads(f.read().decode().splitlines()[-1])["seq"])

    def _start(self) -> int:
        if self.first is None:
            floor, top = self._floor(), self._top()
            if self.since and self.since < floor:
                raise LogError("BATCH_EVICTED", f"{self.since} is evicted", floor)
            # beyond what is published: live only
            self.first = min(self.since - 1, top) if self.since else top
        return self.first

    def initialOffset(self) -> dict:
        return {"seq": self._start()}

    def latestOffset(self) -> dict:
        """Spark asks for it before it asks where to start, and does not tell where it is."""
        if self.seen is None:
            resumed = self._resumed()
            self.seen = self._start() if resumed is None else resumed
        top = min(self._top(), self.until)
        self.seen = max(self.seen, min(top, self.seen + self.step) if self.step else top)
        return {"seq": self.seen}

    def partitions(self, start: dict, end: dict) -> list[_Part]:
        from pyarrow import fs

        if start["seq"] + 1 < self._floor() and start["seq"] < end["seq"]:
            raise LogError("BATCH_EVICTED", f"{start['seq'] + 1} is evicted", self._floor())
        out, room = [], 0
        for seq in range(start["seq"] + 1, end["seq"] + 1):
            with self.fs.open_input_stream(f"{self.path}/manifest/{seq}.json") as f:
                table = json.loads(f.read())["tables"].get(self.table)
            if table:
                store, path = fs.FileSystem.from_uri(table["path"])
                for x in store.get_file_info(fs.FileSelector(path)):
                    if x.base_name.endswith(".parquet"):
                        if x.size > room:
                            out.append(_Part([]))
                            room = PART
                        out[-1].files.append((seq, f"{path}/{x.base_name}"))
                        room -= x.size
        return out

    def read(self, partition: _Part) -> Iterator:
        import pyarrow as pa
        import pyarrow.parquet as pq

        names = [f.name for f in self.schema if f.name != "seq"]
        for seq, path in partition.files:
            with self.fs.open_input_file(path) as file:
                for batch in pq.ParquetFile(file).iter_batches(columns=names):
                    cols = {n: batch.column(batch.schema.get_field_index(n)) for n in names}
                    cols["seq"] = pa.array([seq] * batch.num_rows, pa.int64())
                    yield pa.RecordBatch.from_arrays([cols[f.name] for f in self.schema], names=[f.name for f in self.schema])

    def commit(self, end: dict) -> None:
        pass


class LogSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return "seq long, ord long, key binary, value binary"

    def streamReader(self, schema: T.StructType) -> LogReader:
        return LogReader(schema, dict(self.options))


def stream(spark: SparkSession, root: str, table: str, schema: T.StructType | None = None, since: int | None = None, max_batches: int | None = LOOKAHEAD, checkpoint: str | None = None, until: int | None = None) -> DataFrame:
    """A streaming DataFrame of the table's rows with their batch number as ``seq``.

    A micro-batch takes at most ``max_batches`` (None: all there are); with ``checkpoint`` also the first one
    after a restart.  ``until`` is the last number that is read.
    """
    spark.dataSource.register(LogSource)
    reader = spark.readStream.format(FORMAT).option("root", root).option("table", table).option("since", str(since or 0))
    reader = reader.option("maxBatches", str(max_batches or 0))
    for name, value in (("checkpoint", checkpoint), ("until", until)):
        if value is not None:
            reader = reader.option(name, str(value))
    if schema is not None:
        reader = reader.schema(T.StructType([T.StructField("seq", T.LongType()), *[f for f in schema if f.name != "seq"]]))
    return reader.load()


class Subscription:
    """A running subscription; one that is to end with what was published when it began does so when awaited."""

    def __init__(self, query: StreamingQuery, once: bool):
        self.query, self.once = query, once

    def awaitTermination(self, timeout: int | None = None):
        if self.once:
            self.query.processAllAvailable()
            self.query.stop()
        return self.query.awaitTermination(timeout) if timeout is not None else self.query.awaitTermination()

    def exception(self):
        return self.query.exception()

    def stop(self) -> None:
        self.query.stop()

    @property
    def isActive(self) -> bool:
        return self.query.isActive

    def processAllAvailable(self) -> None:
        self.query.processAllAvailable()


def each_sequence(rows: DataFrame, handle: Callable[[int, DataFrame], None], checkpoint: str, once: bool = False, name: str | None = None, together: bool = False) -> Subscription:
    """Call ``handle(seq, rows)`` for each batch that has rows, in order; batches without any are left out.

    A micro-batch is read once: its rows are written by number below the checkpoint, and each call reads its own.
    ``together`` calls once a micro-batch that has rows, with its number and all its rows; seq tells them apart.
    """

    def run_together(batch: DataFrame, number: int) -> None:
        spark, folder = batch.sparkSession, f"{checkpoint.rstrip('/')}/frames/{number}"
        batch.write.mode("overwrite").parquet(folder)
        if (got := spark.read.schema(batch.schema).parquet(folder)).limit(1).count():
            handle(number, got)
        Store(spark, checkpoint).delete(f"frames/{number}")

    def run(batch: DataFrame, number: int) -> None:
        spark, folder = batch.sparkSession, f"{checkpoint.rstrip('/')}/frames/{number}"
        store = Store(spark, checkpoint)
        batch.withColumn("_seq", F.col("seq")).write.mode("overwrite").partitionBy("_seq").parquet(folder)
        for seq in sorted(int(n[5:]) for n in store.names(f"frames/{number}") if n.startswith("_seq=")):
            handle(seq, spark.read.schema(batch.schema).parquet(f"{folder}/_seq={seq}"))
        store.delete(f"frames/{number}")

    writer = rows.writeStream.foreachBatch(run_together if together else run).option("checkpointLocation", checkpoint)
    if name:
        writer = writer.queryName(name)
    return Subscription(writer.trigger(processingTime="0 seconds" if once else "1 second").start(), once)


def _subscribe(spark: SparkSession, root: str, table: str, schema: T.StructType | None, where, handle, checkpoint: str, since: int | None, once: bool, max_batches: int | None, together: bool = False) -> Subscription:
    until = CommitLog(spark, root).current() if once else None
    rows = stream(spark, root, table, schema, since, max_batches, checkpoint, until)
    return each_sequence(rows.filter(where), handle, checkpoint, once, together=together)


def subscribe_log(spark: SparkSession, root: str, selectors: list[Selector], handle: Callable[[int, DataFrame], None], checkpoint: str, values: list[ValueFilter] | None = None, since: int | None = None, once: bool = False, max_batches: int | None = LOOKAHEAD) -> Subscription:
    """Entries of the key-value log that match, batch by batch."""
    return _subscribe(spark, root, "kv", None, stream_filter(selectors, values), handle, checkpoint, since, once, max_batches)


def subscribe_sql(spark: SparkSession, root: str, table: str, schema: T.StructType, where: str, handle: Callable[[int, DataFrame], None], checkpoint: str, since: int | None = None, once: bool = False, max_batches: int | None = LOOKAHEAD) -> Subscription:
    """Rows of a typed table that satisfy a SQL predicate, batch by batch; a bad predicate fails at once."""
    return _subscribe(spark, root, table, schema, F.expr(where), handle, checkpoint, since, once, max_batches)


def subscribe_operations(spark: SparkSession, root: str, handle: Callable[..., None], checkpoint: str, where: str = "true", since: int | None = None, once: bool = False, max_batches: int | None = LOOKAHEAD, selectors: list[Selector] | None = None, values: list[ValueFilter] | None = None, prove: bool = False, together: bool = False) -> Subscription:
    """Operations of an uploaded log, batch by batch: those that any of ``selectors`` and ``values`` matches.

    A batch and its watermark are published as one, so whatever is seen is at or below the watermark; the
    batch number is the cursor to resume from.  With ``prove`` the handler gets a third argument, the proof that
    the operations are what the batch's head holds at their locations (operators/proofs.py).  ``together`` hands over
    a micro-batch at once, under its own number, and the proofs as a DataFrame with a row a batch; nothing of it is
    collected.
    """
    from ..sources.upload import OPS, prove_batch, prove_batches

    keep = F.expr(where)
    if selectors or values:
        keep = keep & stream_filter(selectors or [Selector(b"")], values)
    log = CommitLog(spark, root)

    def proven(seq: int, rows: DataFrame) -> None:
        # a batch is what one client appended at once
        handle(seq, rows, prove_batch(log, seq, [r.location for r in rows.select("location").collect()]))

    def proven_together(number: int, rows: DataFrame) -> None:
        handle(number, rows, prove_batches(log, rows))

    call = (proven_together if together else proven) if prove else handle
    return _subscribe(spark, root, "ops", OPS, keep, call, checkpoint, since, once, max_batches, together)


def subscribe_records(spark: SparkSession, root: str, kind: str, handle: Callable[[int, DataFrame], None], checkpoint: str, since: int | None = None, once: bool = False, max_batches: int | None = LOOKAHEAD) -> Subscription:
    """Headers, blocks or certificates, as they are uploaded."""
    from ..artifacts import KINDS

    return _subscribe(spark, root, kind, KINDS[kind], F.lit(True), handle, checkpoint, since, once, max_batches)


def collect_sequences(log: CommitLog) -> list[Row]:
    """seq and rows of each retained batch."""
    return [Row(seq=s, rows=sum(log.manifest(s)["rows"].values())) for s in log.sequences()]
