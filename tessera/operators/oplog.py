"""An operation log by location: state as of a location, active keys, ranges, frontiers.

The log is a DataFrame with location (dense from 0), key and value; a null value deletes the key.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import by_ranges


class OpLogError(ValueError):
    """A question that the log cannot answer."""


@dataclass(frozen=True)
class OpLog:
    ops: DataFrame
    location: str = "location"
    key: str = "key"
    value: str = "value"
    watermarks: DataFrame | None = None  # published frontiers, in a column named as location
    batches: DataFrame | None = None  # last location of each batch, in a column named as location

    def watermark(self) -> int | None:
        """The greatest published location (None: nothing is published)."""
        return (self.watermarks if self.watermarks is not None else self.ops).agg(F.max(self.location)).first()[0]

    def require(self, at: int, boundary: bool = False) -> None:
        """Raise unless ``at`` is published and, if asked, the end of a batch."""
        top = self.watermark()
        if top is None or at > top:
            raise OpLogError(f"watermark too low: {top} is published, {at} asked for")
        if boundary and self.batches is not None and not self.batches.filter(F.col(self.location) == at).limit(1).count():
            raise OpLogError(f"{at} is not the end of a batch")

    def _latest(self, at: int, floor: int | None = None) -> DataFrame:
        ops = self.ops.filter(F.col(self.location) <= at)
        if floor is not None:
            ops = ops.filter(F.col(self.location) >= floor)
        best = ops.groupBy(self.key).agg(F.max(F.struct(F.col(self.location).alias("l"), F.col(self.value).alias("v"))).alias("m"))
        return best.select(self.key, F.col("m.l").alias(self.location), F.col("m.v").alias(self.value))

    def get_many_at(self, keys: DataFrame, at: int) -> DataFrame:
        """Of each asked key its latest operation at ``at``: value null if deleted, location null if absent.

        Keys are asked once each (others raise); the log is reduced to them before it is grouped.
        """
        if keys.groupBy(self.key).count().filter("count > 1").limit(1).count():
            raise OpLogError("a key is asked for twice")
        own = OpLog(self.ops.join(keys.select(self.key), self.key, "left_semi"), self.location, self.key, self.value)
        return keys.select(self.key).join(own._latest(at), self.key, "left")

    def active(self, at: int, floor: int | None = None) -> DataFrame:
        """Keys alive at ``at``: the deletion is judged on the latest operation, not filtered before."""
        return self._latest(at, floor).filter(F.col(self.value).isNotNull())

    def active_at_boundary(self, at: int, floor: int | None = None) -> DataFrame:
        """active(), of a published location that ends a batch; others raise."""
        self.require(at, boundary=True)
        return self.active(at, floor)

    def boundaries(self, start: int, stop: int) -> DataFrame:
        """Locations of [start, stop] that end a published batch."""
        if self.batches is None:
            raise OpLogError("the log has no batches")
        return self.batches.filter(F.col(self.location).between(start, min(stop, self.watermark()))).select(self.location)

    def lookup(self, asked: DataFrame, at: int, order: str = "pos", hits_only: bool = False) -> DataFrame:
        """Of each asked key (with its place in the request, ``order``) if it is active at ``at``, and its value.

        A key that is asked for twice raises.  The log is reduced to the asked keys before it is grouped.
        """
        if asked.groupBy(self.key).count().filter("count > 1").limit(1).count():
            raise OpLogError("a key is asked for twice")
        own = OpLog(self.ops.join(asked.select(self.key), self.key, "left_semi"), self.location, self.key, self.value)
        out = asked.join(own.active(at).select(self.key, self.value), self.key, "inner" if hits_only else "left")
        return out.select(order, self.key, F.col(self.value).isNotNull().alias("hit"), self.value)

    def links(self, at: int, start, end) -> DataFrame:
        """Evidence of a key range: its active keys with the next one, and the key before it whose link spans ``start``.

        Followed from one to the next they show that no other key is in [start, end).
        """
        key, nxt, first = F.col(self.key), F.col("next_key"), F.lit(start)
        spans = ((key < first) & (first < nxt)) | ((nxt <= key) & ((first > key) | (first < nxt)))
        return self.successors(at).filter((key >= first) & (key < F.lit(end)) | spans)

    def operations(self, start: int, most: int, at: int | None = None) -> DataFrame:
        """Operations from ``start``, ``most`` of them, none beyond ``at``; a gap raises."""
        at = self.watermark() if at is None else at
        stop = min(start + most, (at if at is not None else -1) + 1)
        out = self.ops.filter((F.col(self.location) >= start) & (F.col(self.location) < stop))
        if (n := out.count()) != max(0, stop - start):
            raise OpLogError(f"{n} of {stop - start} operations are there")
        return out.orderBy(self.location)

    def key_range(self, at: int, start=None, end=None, limit: int = 1000) -> tuple[DataFrame, bool, object]:
        """(entries, has_more, next_start_key): active keys of [start, end) in order, ``limit`` at most."""
        if limit < 1:
            raise OpLogError("limit must be positive")
        act = self.active(at)
        if start is not None:
            act = act.filter(F.col(self.key) >= F.lit(start))
        if end is not None:
            act = act.filter(F.col(self.key) < F.lit(end))
        head = act.orderBy(self.key).limit(limit + 1)
        beyond = head.orderBy(self.key).offset(limit).limit(1).collect()
        return head.orderBy(self.key).limit(limit), bool(beyond), beyond[0][self.key] if beyond else None

    def successors(self, at: int) -> DataFrame:
        """Active keys with the next one in order; the greatest key's successor is the smallest.

        Ranges of keys are numbered and joined end to start, so that no task sees all keys.
        """
        act = self.active(at).select(self.key)
        part = by_ranges(act, self.key, label="active")
        by = Window.partitionBy("_p").orderBy(self.key)
        inner = part.withColumn("_next", F.lead(self.key).over(by))
        firsts = part.groupBy("_p").agg(F.min(self.key).alias("_first"))
        order = Window.orderBy("_p")  # a row a partition
        after = firsts.select(F.col("_p").alias("_q"), F.coalesce(F.lead("_first").over(order), F.min("_first").over(Window.partitionBy())).alias("_after"))
        return inner.join(F.broadcast(after), F.col("_p") == F.col("_q")).select(self.key, F.coalesce("_next", "_after").alias("next_key"))


def contiguous_frontier(acks: DataFrame, start: str = "start", end: str = "end", origin: int = 0) -> DataFrame:
    """frontier: end of the longest run of acknowledged [start, end) ranges from ``origin`` without a hole.

    Ranges are dealt by start; a range reaches as far as the greatest end before it, which is a running
    maximum inside each part over the greatest end of the parts before.  The first range that starts beyond
    what is reached shows the frontier.
    """
    spans = by_ranges(acks.select(F.col(start).alias("s"), F.col(end).alias("e")).filter("e > s"), "s", label="acks")
    tops = spans.groupBy("_p").agg(F.max("e").alias("t"))
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)  # a row a part
    tops = tops.select(F.col("_p").alias("_q"), F.max("t").over(before).alias("_before"), F.max("t").over(Window.partitionBy()).alias("_top"))
    by = Window.partitionBy("_p").orderBy("s", "e").rowsBetween(Window.unboundedPreceding, -1)
    floor = F.lit(origin).cast("long")
    run = spans.withColumn("_in", F.max("e").over(by)).join(F.broadcast(tops), F.col("_p") == F.col("_q"))
    run = run.withColumn("_reach", F.greatest(floor, F.coalesce("_in", floor), F.coalesce("_before", floor)))
    found = run.agg(F.min(F.when(F.col("s") > F.col("_reach"), F.col("_reach"))).alias("h"), F.max("_top").alias("t"))
    return found.select(F.coalesce("h", F.greatest(floor, F.coalesce("t", floor))).cast("long").alias("frontier"))
