"""Grouped reduction: reducers over a filtered range, by any expressions."""

from __future__ import annotations

from dataclasses import dataclass, field
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class ReduceError(ValueError):
    """A reduction that cannot run."""


@dataclass(frozen=True)
class Reducer:
    """``op`` is count_all, count, sum, min, max or avg; ``where`` restricts the rows that it sees."""

    op: str
    alias: str
    value: Column | None = None
    where: Column | None = None

    def to_column(self) -> Column:
        if self.op == "count_all":
            v = F.lit(1) if self.where is None else F.when(self.where, F.lit(1))
            return F.count(v).alias(self.alias)
        if self.value is None:
            raise ReduceError(f"{self.op} needs a value")
        v = self.value if self.where is None else F.when(self.where, self.value)
        try:
            f = {"count": F.count, "sum": F.sum, "min": F.min, "max": F.max, "avg": F.avg}[self.op]
        except KeyError:
            raise ReduceError(f"no reducer {self.op}") from None
        return f(v).alias(self.alias)


@dataclass(frozen=True)
class ReduceSpec:
    """``lenient`` drops a row whose group key or value expression fails (built of try_ functions: is null where
    ``needs`` are not), as the key-value surface does; strict reductions raise."""

    reducers: tuple[Reducer, ...] = ()
    group_by: tuple[tuple[str, Column], ...] = ()
    where: Column | None = None
    lenient: bool = False
    needs: tuple[Column, ...] = field(default=())


def run(df: DataFrame, spec: ReduceSpec) -> DataFrame:
    """Partial and final aggregation on the group keys; a global reduction of no rows is one row."""
    if not spec.reducers and not spec.group_by:
        raise ReduceError("a reduction needs a reducer or a group key")
    if spec.where is not None:
        df = df.filter(spec.where)
    if spec.lenient:
        for need in spec.needs:
            df = df.filter(need.isNotNull())
    keys = [c.alias(n) for n, c in spec.group_by]
    if not spec.reducers:
        return df.select(*keys).distinct()
    grouped = df.groupBy(*keys) if keys else df.groupBy()
    return grouped.agg(*[r.to_column() for r in spec.reducers])


def u64_sum(c: Column) -> Column:
    """Sum of decimal(20, 0) that raises beyond 2 ** 64 - 1 instead of widening."""
    s = F.sum(c)
    over = F.raise_error(F.lit("uint64 overflow")).cast("decimal(20,0)")
    return F.when(s > F.lit(Decimal((1 << 64) - 1)), over).otherwise(s.cast("decimal(20,0)"))


def histogram(df: DataFrame, value: str, bounds: list[float]) -> DataFrame:
    """bound, n: rows by the smallest of the upper bounds that they do not pass; null for those beyond all."""
    at = F.lit(None).cast("double")
    for b in sorted(bounds, reverse=True):
        at = F.when(F.col(value) <= b, F.lit(float(b))).otherwise(at)
    return df.groupBy(at.alias("bound")).agg(F.count(F.lit(1)).alias("n"))


def percentile_bounds(df: DataFrame, value: str, bounds: list[float], shares: list[float]) -> DataFrame:
    """share, bound: upper bound of the bucket in which each share of the rows is reached."""
    from pyspark.sql import Window

    buckets = histogram(df, value, bounds)  # a few rows, whatever the input
    by = Window.orderBy(F.asc_nulls_last("bound"))
    run_ = buckets.select("bound", F.sum("n").over(by).alias("run"), F.sum("n").over(Window.partitionBy()).alias("total"))
    asked = F.explode(F.array(*[F.lit(s) for s in shares])).alias("share")
    reached = run_.select("bound", "run", "total", asked).filter("run >= share * total")
    return reached.groupBy("share").agg(F.min_by("bound", "run").alias("bound"))
