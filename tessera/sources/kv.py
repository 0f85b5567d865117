"""An ordered key-value store over the log: points, ranges, prefixes, reductions, snapshots, pruning.

The state is the last value of each key in a base table and the batches after it, both sorted by key.  A prune
writes a new base; trimming the log takes nothing from the state.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import prune as pruning
from ..operators import reduce as reducing
from ..operators.predicates import Selector, ValueFilter, stream_filter
from .log import CommitLog
from .tables import by_ranges

MAX_KEY, MAX_VALUE = 254, 10 << 20
ENTRY = T.StructType([T.StructField("ord", T.LongType()), T.StructField("key", T.BinaryType()), T.StructField("value", T.BinaryType())])
STATE = T.StructType([T.StructField("key", T.BinaryType()), T.StructField("value", T.BinaryType()), T.StructField("seq", T.LongType())])


def prefix_bounds(prefix: bytes) -> tuple[bytes, bytes]:
    """The first and last key (both inclusive) that start with ``prefix``."""
    return prefix, prefix + b"\xff" * (MAX_KEY - len(prefix))


class KvStore:
    """``prefix`` makes a namespace: keys are put and returned without it."""

    def __init__(self, spark: SparkSession, root: str, prefix: bytes = b""):
        self.spark, self.root, self.ns = spark, root, prefix
        self.log = CommitLog(spark, root)

    def namespace(self, prefix: bytes) -> KvStore:
        return KvStore(self.spark, self.root, self.ns + prefix)

    # writing

    def _entries(self, kvs: Iterable[tuple[bytes, bytes]]) -> list[tuple[int, bytearray, bytearray]]:
        out = []
        for i, (k, v) in enumerate(kvs):
            if len(self.ns) + len(k) > MAX_KEY or len(v) > MAX_VALUE:
                raise ValueError(f"a key of {len(self.ns) + len(k)} or value of {len(v)} bytes is too long")
            out.append((i, bytearray(self.ns + k), bytearray(v)))
        return out

    def put(self, kvs: Iterable[tuple[bytes, bytes]]) -> int:
        """One atomic batch; of a key that occurs twice the last value holds.  Returns its number."""
        rows = self._entries(kvs)
        if not rows:
            raise ValueError("a batch needs an entry")
        return self.log.commit({"kv": self.spark.createDataFrame(rows, ENTRY)}).seq

    def put_frame(self, df: DataFrame) -> int:
        """A batch from a DataFrame of key and value (and ord, to order entries of one key); nothing is collected."""
        bad = df.filter((F.length("key") + len(self.ns) > MAX_KEY) | (F.length("value") > MAX_VALUE) | F.col("key").isNull() | F.col("value").isNull())
        if bad.limit(1).count():
            raise ValueError("a key or value is null or too long")
        order = F.col("ord").cast("long") if "ord" in df.columns else F.monotonically_increasing_id()
        rows = df.select(order.alias("ord"), F.concat(F.lit(bytearray(self.ns)), "key").alias("key"), "value")
        return self.log.commit({"kv": rows.repartitionByRange("key").sortWithinPartitions("key")}).seq

    # state

    def state(self, at: int | None = None) -> DataFrame:
        """key, value, seq: the last write of each key in batches up to ``at`` (default: current), with full keys.

        A snapshot that needs batches which are reclaimed raises BATCH_EVICTED.
        """
        found = self.log.base("kv", at)
        base, seq = (self.spark.read.schema(STATE).parquet(found["path"]), found["seq"]) if found else (None, 0)
        new = self.log.history("kv", seq, at, ENTRY)
        if new is None:
            return base if base is not None else self.spark.createDataFrame([], STATE)
        rows = new.select("key", "value", "seq", "ord")
        if base is not None:
            rows = rows.unionByName(base.withColumn("ord", F.lit(-1).cast("long")))
        last = rows.groupBy("key").agg(F.max_by(F.struct("value", "seq"), F.struct("seq", "ord")).alias("_l"))
        return last.select("key", F.col("_l.value").alias("value"), F.col("_l.seq").alias("seq"))

    def _own(self, at: int | None = None, min_seq: int | None = None) -> DataFrame:
        self.log.require(min_seq)
        rows = self.state(at)
        if self.ns:
            rows = rows.filter(F.startswith("key", F.lit(bytearray(self.ns))))
        return rows

    def _strip(self, df: DataFrame) -> DataFrame:
        return df.withColumn("key", F.substr("key", F.lit(len(self.ns) + 1))) if self.ns else df

    # reading

    def get(self, key: bytes, min_seq: int | None = None, at: int | None = None) -> bytes | None:
        got = self._own(at, min_seq).filter(F.col("key") == F.lit(bytearray(self.ns + key))).select("value").take(1)
        return bytes(got[0].value) if got else None

    def get_many(self, keys: list[bytes] | DataFrame, min_seq: int | None = None, at: int | None = None) -> DataFrame:
        """key, value of each asked key, value null where it is absent; asked keys stay once for each time."""
        if not isinstance(keys, DataFrame):
            keys = self.spark.createDataFrame([(i, bytearray(self.ns + k)) for i, k in enumerate(keys)], "pos long, key binary")
        elif self.ns:
            keys = keys.withColumn("key", F.concat(F.lit(bytearray(self.ns)), "key"))
        return self._strip(keys.join(self._own(at, min_seq).select("key", "value"), "key", "left"))

    def range(self, start: bytes = b"", end: bytes = b"", limit: int | None = None, reverse: bool = False, min_seq: int | None = None, at: int | None = None) -> DataFrame:
        """key, value in order of keys; both bounds are inclusive, an empty ``end`` is none."""
        rows = self._own(at, min_seq).filter(F.col("key") >= F.lit(bytearray(self.ns + start)))
        if end:
            rows = rows.filter(F.col("key") <= F.lit(bytearray(self.ns + end)))
        rows = rows.select("key", "value").orderBy(F.desc("key") if reverse else F.asc("key"))
        return self._strip(rows if limit is None else rows.limit(limit))

    def prefix(self, prefix: bytes, **options) -> DataFrame:
        start, end = prefix, prefix_bounds(self.ns + prefix)[1][len(self.ns) :]
        return self.range(start, end, **options)

    def frames(self, rows: DataFrame, size: int = 4096) -> Iterator[list[Row]]:
        """Pages of a range, drawn a partition at a time; an empty range is one empty page."""
        page, sent = [], False
        for row in rows.toLocalIterator(prefetchPartitions=True):
            page.append(row)
            if len(page) == size:
                yield page
                page, sent = [], True
        if page or not sent:
            yield page

    def pages(self, rows: DataFrame, size: int = 4096) -> DataFrame:
        """``rows`` of a range in order of keys with the number of their page, as frames() draws them, in tasks.

        Keys are numbered inside ranges, on top of the ranges before.
        """
        dealt, before = by_ranges(rows, "key", label="pages"), Window.orderBy("_p")  # a row a range
        sums = dealt.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"))
        sums = sums.select(F.col("_p").alias("_q"), (F.sum("_n").over(before) - F.col("_n")).alias("_base"))
        own = F.row_number().over(Window.partitionBy("_p").orderBy("key")) - 1
        numbered = dealt.withColumn("_i", own).join(F.broadcast(sums), F.col("_p") == F.col("_q"))
        return numbered.select(*rows.columns, F.floor((F.col("_base") + F.col("_i")) / size).cast("long").alias("page"))

    def reduce(self, spec: reducing.ReduceSpec, start: bytes = b"", end: bytes = b"", min_seq: int | None = None) -> DataFrame:
        rows = self._own(None, min_seq).filter(F.col("key") >= F.lit(bytearray(self.ns + start)))
        if end:
            rows = rows.filter(F.col("key") <= F.lit(bytearray(self.ns + end)))
        return reducing.run(self._strip(rows), spec)

    def session(self) -> Session:
        return Session(self)

    # log

    def batch(self, seq: int) -> DataFrame:
        return self.log.get(seq, "kv").orderBy("ord").select("seq", "ord", "key", "value")

    def matching(self, selectors: list[Selector], values: list[ValueFilter] | None = None, since: int | None = None) -> DataFrame:
        """Entries of the log that a subscription would be sent, in order; ``since`` is inclusive."""
        if since is not None and since < self.log.oldest():
            raise_evicted(self.log)
        got = self.log.read("kv", (since or 1) - 1, None, ENTRY)
        got = got if got is not None else self.spark.createDataFrame([], T.StructType([*ENTRY.fields, T.StructField("seq", T.LongType())]))
        return got.filter(stream_filter(selectors, values)).select("seq", "ord", "key", "value")

    # maintenance

    def _write_base(self, rows: DataFrame, seq: int) -> None:
        """Dealt by ranges of keys and sorted, so that points and ranges read few files and row groups."""
        self.log.write_base("kv", rows.repartitionByRange("key").sortWithinPartitions("key"), seq)

    def prune(self, policies: list[pruning.PrunePolicy]) -> None:
        """Rewrite the state; the log and its numbers stay as they are.  Pruning twice changes nothing more."""
        seq = self.log.current()
        own = [pruning.PrunePolicy(self.ns + p.prefix, p.regex, p.retain, p.group_by, p.order_by, p.version) for p in policies]
        self._write_base(pruning.apply(self.state(seq), own), seq)

    def compact(self) -> None:
        """Fold the log into a base, and delete what was trimmed and is held by bases now."""
        seq = self.log.current()
        self._write_base(self.state(seq), seq)
        self.log.reclaim()

    def retain(self, kind: str, n: int = 0) -> int:
        """Trim the log once; the state does not change, nor do snapshots."""
        return self.log.retain(kind, n)


def raise_evicted(log: CommitLog) -> None:
    from .log import LogError

    raise LogError("BATCH_EVICTED", "the first batch asked for is evicted", log.oldest())


class Session:
    """Reads of one snapshot: the number is fixed by the first read."""

    def __init__(self, store: KvStore):
        self.store, self.seq = store, None

    def _at(self) -> int:
        if self.seq is None:
            self.seq = self.store.log.current()
        return self.seq

    def get(self, key: bytes) -> bytes | None:
        return self.store.get(key, at=self._at())

    def get_many(self, keys) -> DataFrame:
        return self.store.get_many(keys, at=self._at())

    def range(self, *args, **options) -> DataFrame:
        return self.store.range(*args, at=self._at(), **options)


class WriteBatch:
    """Entries of several namespaces of one root that become visible together."""

    def __init__(self):
        self.entries, self.stores = [], []

    def push(self, store: KvStore, key: bytes, value: bytes) -> WriteBatch:
        if self.stores and store.root != self.stores[0].root:
            raise ValueError("a batch is of one root")
        self.stores.append(store)
        self.entries.append((store.ns + key, value))
        return self

    def commit(self) -> int:
        return KvStore(self.stores[0].spark, self.stores[0].root).put(self.entries)
