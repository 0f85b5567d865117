"""Predicates as data: constraints on columns, turned to Spark columns that Catalyst can push to scans.

Semantics that differ from plain Spark: a NaN in a row satisfies no bound, a NaN or null literal matches no
row, null members of IN are ignored, and nanosecond literals that fall between microseconds round by operator.
"""

from __future__ import annotations

import datetime as dt
import math
import re
from collections.abc import Iterable
from dataclasses import dataclass
from functools import reduce as fold
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Nanos:
    """A timestamp literal in nanoseconds since 1970."""

    value: int


@dataclass(frozen=True)
class Constraint:
    """``op`` is one of = <> < <= > >= in between is_null is_not_null prefix regex."""

    column: str
    op: str
    value: Any = None
    is_float: bool = False

    def to_column(self) -> Column:
        c = F.col(f"`{self.column}`")
        if self.op == "is_null":
            return c.isNull()
        if self.op == "is_not_null":
            return c.isNotNull()
        if self.op == "in":
            members = list(dict.fromkeys(v for v in self.value if v is not None and not _nan(v)))
            return c.isin(members) if members else F.lit(False)
        if self.op == "between":
            low, high = self.value
            return Constraint(self.column, ">=", low, self.is_float).to_column() & Constraint(self.column, "<=", high, self.is_float).to_column()
        if self.value is None or _nan(self.value):
            return F.lit(False)
        if self.op == "prefix":
            return F.startswith(c, F.lit(self.value))
        if self.op == "regex":
            return byte_regex(c, self.value)
        op, value = self.op, self.value
        if isinstance(value, Nanos):
            op, value = micros(op, value)
            if value is None:
                return F.lit(False)
        out = {"=": c == F.lit(value), "<>": c != F.lit(value), "<": c < F.lit(value), "<=": c <= F.lit(value), ">": c > F.lit(value), ">=": c >= F.lit(value)}[op]
        return out & ~F.isnan(c) if self.is_float or isinstance(value, float) else out


def _nan(v: Any) -> bool:
    return isinstance(v, float) and math.isnan(v)


def micros(op: str, nanos: Nanos) -> tuple[str, dt.datetime | None]:
    """The bound in microseconds that matches the same rows of a microsecond column; None if none can match."""
    low, rest = divmod(nanos.value, 1000)
    at = lambda us: dt.datetime(1970, 1, 1) + dt.timedelta(microseconds=us)
    if rest == 0:
        return op, at(low)
    if op == "=":
        return op, None
    return {"<": ("<=", at(low)), "<=": ("<=", at(low)), ">": (">=", at(low + 1)), ">=": (">=", at(low + 1)), "<>": ("is_not_null", at(low))}[op]


def java_pattern(pattern: str) -> str:
    """Byte patterns write flags such as (?s-u) and groups such as (?P<n>...); Java wants (?s) and (?<n>...)."""
    out = pattern.replace("(?P<", "(?<")
    return re.sub(r"^\(\?([a-z]*)-u\)", lambda m: f"(?{m[1]})" if m[1] else "", out)


def byte_regex(c: Column, pattern: str) -> Column:
    """Does the pattern occur in the bytes?  Latin-1 maps each byte to a character, so . is one byte."""
    return F.rlike(F.decode(c, "ISO-8859-1"), F.lit(java_pattern(pattern)))


def conjunction(constraints: Iterable[Constraint]) -> Column:
    return fold(lambda a, b: a & b, (c.to_column() for c in constraints), F.lit(True))


def disjunction(constraints: Iterable[Constraint]) -> Column:
    return fold(lambda a, b: a | b, (c.to_column() for c in constraints), F.lit(False))


@dataclass(frozen=True)
class Selector:
    """Keys that start with ``prefix`` and whose rest matches ``payload_regex``."""

    prefix: bytes
    payload_regex: str = ".*"

    def to_column(self, key: str = "key") -> Column:
        k = F.col(key)
        on = F.startswith(k, F.lit(bytearray(self.prefix)))
        if self.payload_regex in (".*", "(?s).*", "(?s-u).*"):
            return on
        return on & byte_regex(F.substr(k, F.lit(len(self.prefix) + 1)), self.payload_regex)


@dataclass(frozen=True)
class ValueFilter:
    """``kind`` is exact, prefix or regex."""

    kind: str
    value: bytes | str

    def to_column(self, value: str = "value") -> Column:
        v = F.col(value)
        if self.kind == "exact":
            return v == F.lit(bytearray(self.value))
        if self.kind == "prefix":
            return F.startswith(v, F.lit(bytearray(self.value)))
        if self.kind == "regex":
            return byte_regex(v, self.value if isinstance(self.value, str) else self.value.decode("latin-1"))
        raise ValueError(f"no value filter {self.kind}")


def stream_filter(selectors: list[Selector], values: list[ValueFilter] | None = None) -> Column:
    """One of the selectors and, if there are any, one of the value filters; 1 to 16 and 0 to 16 of them."""
    values = values or []
    if not 1 <= len(selectors) <= 16 or len(values) > 16:
        raise ValueError("1 to 16 selectors and at most 16 value filters")
    keys = fold(lambda a, b: a | b, (s.to_column() for s in selectors))
    return keys & fold(lambda a, b: a | b, (v.to_column() for v in values)) if values else keys


def composite_key(columns: list[str], points: list[Any], low: Any = None, high: Any = None) -> Column:
    """A composite key narrowed from the left: equal to ``points``, then one closed range on the next column."""
    out = [Constraint(c, "=", v) for c, v in zip(columns, points, strict=False)]
    if len(points) < len(columns):
        out += [Constraint(columns[len(points)], op, v) for op, v in ((">=", low), ("<=", high)) if v is not None]
    return conjunction(out)
