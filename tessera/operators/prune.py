"""Prune policies: which keys of a state stay, by what a pattern captures of them."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import capture
from .predicates import Selector, byte_regex, java_pattern

VERSION = 2


class PolicyError(ValueError):
    """A policy that breaks a rule."""


@dataclass(frozen=True)
class Retain:
    """``kind`` is keep_latest (n), greater_than (t), at_least (t) or drop_all."""

    kind: str
    n: int = 0


@dataclass(frozen=True)
class PrunePolicy:
    """Keys of ``prefix`` whose rest matches ``regex`` are grouped by captures, ordered, and retained."""

    prefix: bytes
    regex: str
    retain: Retain
    group_by: tuple[str, ...] = ()
    order_by: tuple[str, str] | None = None  # capture, encoding: bytes, u64_be or i64_be
    version: int = VERSION

    def validate(self) -> None:
        groups = re.compile(self.regex.replace("-u", "")).groupindex
        if self.version != VERSION:
            raise PolicyError(f"policy version {self.version} is not {VERSION}")
        if unknown := [g for g in self.group_by if g not in groups]:
            raise PolicyError(f"the pattern captures no {unknown}")
        if len(set(self.group_by)) != len(self.group_by):
            raise PolicyError("a group is named twice")
        if self.order_by and (self.order_by[0] not in groups or self.order_by[1] not in ("bytes", "u64_be", "i64_be")):
            raise PolicyError(f"cannot order by {self.order_by}")
        if self.retain.kind == "keep_latest" and (self.retain.n < 1 or not self.order_by):
            raise PolicyError("keep_latest needs a positive count and an order")
        if self.retain.kind in ("greater_than", "at_least") and (not self.order_by or self.order_by[1] != "u64_be"):
            raise PolicyError("a threshold needs an order by u64_be")
        if self.retain.kind not in ("keep_latest", "greater_than", "at_least", "drop_all"):
            raise PolicyError(f"cannot retain {self.retain.kind}")

    def _captured(self, name: str) -> Column:
        rest = F.substr(F.col("key"), F.lit(len(self.prefix) + 1))
        return capture(rest, java_pattern(self.regex), re.compile(self.regex.replace("-u", "")).groupindex[name])

    def matches(self) -> Column:
        on = Selector(self.prefix).to_column()
        return on & byte_regex(F.substr(F.col("key"), F.lit(len(self.prefix) + 1)), self.regex)


def validate(policies: list[PrunePolicy]) -> None:
    for p in policies:
        p.validate()
    prefixes = sorted(p.prefix for p in policies)
    if any(b.startswith(a) for a, b in zip(prefixes, prefixes[1:], strict=False)):
        raise PolicyError("prefixes of policies overlap")


def u64(c: Column) -> Column:
    """Big-endian bytes as decimal(20, 0); nothing is 0."""
    return F.coalesce(F.conv(F.when(F.length(c) > 0, F.hex(c)), 16, 10).cast("decimal(20,0)"), F.lit(0).cast("decimal(20,0)"))


def _order(policy: PrunePolicy) -> Column:
    """What the policy orders by, as bytes in that order."""
    name, kind = policy.order_by
    order = policy._captured(name)
    if kind == "u64_be":
        return F.unhex(F.lpad(F.conv(u64(order).cast("string"), 10, 16), 16, "0"))
    if kind == "i64_be":  # a sign flip puts two's complement in byte order
        sign = F.when(F.hex(F.substr(order, F.lit(1), F.lit(1))) >= "80", F.lit(bytearray(b"\x00"))).otherwise(F.lit(bytearray(b"\x01")))
        return F.concat(sign, order)
    return order


def apply(state: DataFrame, policies: list[PrunePolicy]) -> DataFrame:
    """The rows of ``state`` (key, ...) that stay.  Keys that no pattern matches always do.

    One pass: thresholds and drops are decided in place, and what keep_latest policies are about meets one window.
    """
    validate(policies)
    number = F.lit(None).cast("int")
    for i, p in enumerate(policies):
        number = F.when(F.coalesce(p.matches(), F.lit(False)), F.lit(i)).otherwise(number)
    latest = [i for i, p in enumerate(policies) if p.retain.kind == "keep_latest"]
    stays = F.lit(True)
    for i, p in enumerate(policies):
        if p.retain.kind == "drop_all":
            stays = F.when(F.col("_policy") == i, F.lit(False)).otherwise(stays)
        elif i not in latest:
            at, t = u64(p._captured(p.order_by[0])), F.lit(p.retain.n).cast("decimal(20,0)")
            stays = F.when(F.col("_policy") == i, at > t if p.retain.kind == "greater_than" else at >= t).otherwise(stays)
    marked = state.withColumn("_policy", number)
    if not latest:
        return marked.filter(stays).drop("_policy")
    ranked = F.col("_policy").isin(latest)
    empty = F.array().cast("array<binary>")
    group, order, most = empty, F.lit(None).cast("binary"), F.lit(0)
    for i in latest:
        p, own = policies[i], F.col("_policy") == i
        group = F.when(own, F.array(*[p._captured(g) for g in p.group_by]) if p.group_by else empty).otherwise(group)
        order = F.when(own, _order(p)).otherwise(order)
        most = F.when(own, F.lit(p.retain.n)).otherwise(most)
    by = Window.partitionBy("_policy", "_group").orderBy(F.desc("_order"), F.desc("key"))
    kept = marked.filter(ranked).withColumns({"_group": group, "_order": order, "_most": most})
    kept = kept.withColumn("_rn", F.row_number().over(by)).filter(F.col("_rn") <= F.col("_most"))
    rest = marked.filter(F.coalesce(~ranked, F.lit(True)) & stays)
    return rest.drop("_policy").unionByName(kept.drop("_policy", "_group", "_order", "_most", "_rn"))


@dataclass(frozen=True)
class UpdatePolicy:
    """Which updates of an operation log stay: keep_latest_updates (``n`` of each key) or keep_positions_gte (``n``)."""

    kind: str
    n: int

    def apply(self, df: DataFrame, key: str, position: str) -> DataFrame:
        if self.kind == "keep_positions_gte":
            return df.filter(F.col(position) >= self.n)
        if self.kind != "keep_latest_updates":
            raise PolicyError(f"cannot apply {self.kind}")
        if self.n < 1:
            raise PolicyError("keep_latest_updates needs a positive count")
        return keep_latest_versions(df, [key], position, self.n)


def keep_latest_versions(df: DataFrame, entity: list[str], version: str, n: int) -> DataFrame:
    """The typed form: the ``n`` greatest versions of each entity."""
    from .versioned import keep_latest

    return keep_latest(df, entity, version, n)
