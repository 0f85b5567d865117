"""Index projections of a table: its rows' key and covered columns, clustered by the index keys.

A lexicographic index is dealt by ranges of its keys and sorted, a z-order index by the interleaved ranks of
its keys; predicates on the plain columns then skip files and row groups by their statistics.  A projection
records the batch up to which it holds the table; readers put what was written after it in place of the rows it
replaces, so an index follows its table.  A chooser picks a path before the query is built.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import morton
from ..operators.predicates import Constraint, conjunction
from ..spec import IndexSpec, TableSpec


@dataclass(frozen=True)
class Projection:
    """An index's rows, and the batch up to which they hold the table (0: a table without a log)."""

    rows: DataFrame
    seq: int


def publish(store, table: TableSpec, index: IndexSpec, path: str, seq: int) -> None:
    """Record a written projection, so that other engines of the root find it."""
    at = 1 + max((int(n[:-5]) for n in store.names(f"index/{table.name}/{index.name}/made")), default=0)
    store.create(f"index/{table.name}/{index.name}/made/{at}.json", json.dumps({"path": path, "seq": seq}))


def stored(store, spark: SparkSession, table: TableSpec) -> dict[str, Projection]:
    """The last recorded projection of each of the table's indexes."""
    out = {}
    for i in table.indexes:
        folder = f"index/{table.name}/{i.name}/made"
        if last := max((int(n[:-5]) for n in store.names(folder)), default=None):
            made = json.loads(store.read(f"{folder}/{last}.json"))
            out[i.name] = Projection(spark.read.parquet(made["path"]), made["seq"])
    return out


def replaced(rows: DataFrame, newer: DataFrame, key: list[str], gone: DataFrame | None = None) -> DataFrame:
    """``rows`` with those of ``newer`` in place of the ones with the same key, or of those whose key is in ``gone``."""
    return rows.join((newer if gone is None else gone).select(*key), key, "left_anti").select(*rows.columns).unionByName(newer.select(*rows.columns))


def place(value: Column, points: list[float]) -> Column:
    """How many of the sorted ``points`` are not above ``value`` (null: 0), by halving steps."""
    if not points:
        return F.lit(0)
    known = F.from_json(F.lit(json.dumps(points)), "array<double>")
    steps = F.array(*[F.lit(1 << i) for i in reversed(range(len(points).bit_length()))])
    onward = lambda at, s: (at + s <= F.lit(len(points))) & F.coalesce(F.get(known, at + s - 1) <= value, F.lit(False))
    return F.aggregate(steps, F.lit(0), lambda at, s: F.when(onward(at, s), at + s).otherwise(at))


def rank_bits(df: DataFrame, columns: list[str], bits: int = 10) -> list[Column]:
    """Each column as an unsigned number of ``bits`` bits: its place between approximate quantiles.

    One aggregate finds all cut points; there are 2 ** bits of them at most, whatever the table.
    """
    n = 1 << min(bits, 8)
    shares = [i / n for i in range(1, n)]
    as_double = {c: F.col(c).cast("double") if dict(df.dtypes)[c] not in ("date", "timestamp", "timestamp_ntz") else F.unix_micros(F.col(c).cast("timestamp")).cast("double") for c in columns}
    cuts = df.agg(*[F.percentile_approx(v, shares, 10_000).alias(c) for c, v in as_double.items()]).first()
    return [place(as_double[c], sorted(set(cuts[c] or []))) for c in columns]


def project(df: DataFrame, table: TableSpec, index: IndexSpec) -> DataFrame:
    """The projection's rows in their order."""
    columns = list(dict.fromkeys([*index.keys, *table.primary_key, *index.cover]))
    rows = df.select(*columns)
    if index.layout == "lexicographic":
        order = list(dict.fromkeys([*index.keys, *table.primary_key]))
        return rows.repartitionByRange(*order).sortWithinPartitions(*order)
    bits = min(8, 62 // len(index.keys))
    # the ranks are columns first: each of their bits is used
    ranks = {f"_r{i}": r for i, r in enumerate(rank_bits(df, list(index.keys), bits))}
    coded = rows.withColumns(ranks).withColumn("_z", morton([F.col(r) for r in ranks], bits))
    return coded.repartitionByRange("_z").sortWithinPartitions("_z").select(*columns)


def write(df: DataFrame, table: TableSpec, index: IndexSpec, path: str, mode: str = "overwrite") -> None:
    project(df, table, index).write.mode(mode).parquet(path)


@dataclass(frozen=True)
class AccessPath:
    """How a query will read a table."""

    table: str
    path: str  # primary, or the index's name
    layout: str
    mode: str  # primary, covering, lookup or empty
    constrained: tuple[str, ...]
    full_scan: bool

    def __str__(self) -> str:
        return f"{self.table}: {self.mode} by {self.path} ({self.layout}); constrained {list(self.constrained)}; full scan {self.full_scan}"


def _prefix(keys: tuple[str, ...], by: dict[str, set[str]], layout: str) -> tuple[str, ...]:
    """The keys that narrow a scan: equalities from the left and then one range; z-order takes any."""
    if layout == "z_order":
        return tuple(k for k in keys if by.get(k, set()) & {"=", "in", "between", "<", "<=", ">", ">="})
    out = []
    for k in keys:
        ops = by.get(k, set())
        if ops & {"=", "in"}:
            out.append(k)
            continue
        if ops & {"between", "<", "<=", ">", ">="}:
            out.append(k)
        break
    return tuple(out)


def choose(table: TableSpec, constraints: list[Constraint], columns: list[str], ready: set[str] | None = None) -> AccessPath:
    """The path with most constrained keys; then covering before lookup, lexicographic before z-order.

    An index that constrains nothing more than the primary key is not used.
    """
    for c in constraints:
        if c.op in ("=", "<", "<=", ">", ">=") and c.value is None or c.op == "in" and not [v for v in c.value if v is not None]:
            return AccessPath(table.name, "none", "-", "empty", (), False)
    by: dict[str, set[str]] = {}
    for c in constraints:
        by.setdefault(c.column, set()).add(c.op)
    need = set(columns) | set(by)
    own = _prefix(table.primary_key, by, "lexicographic")
    best, score = AccessPath(table.name, "primary", "lexicographic", "primary", own, not own), (len(own), 1, 1, 1)
    for i in table.indexes:
        if ready is not None and i.name not in ready:
            continue
        hit = _prefix(i.keys, by, i.layout)
        covers = need <= {*i.keys, *table.primary_key, *i.cover}
        s = (len(hit), covers, i.layout == "lexicographic", 0)
        if hit and s > score:
            best, score = AccessPath(table.name, i.name, i.layout, "covering" if covers else "lookup", hit, False), s
    return best


def scan(base: DataFrame, projections: dict[str, Projection], table: TableSpec, constraints: list[Constraint], columns: list[str], path: AccessPath, newer: DataFrame | None = None, written: DataFrame | None = None) -> DataFrame:
    """Rows and columns of ``table`` under ``constraints`` by ``path``.

    ``newer`` are the table's rows that were written after the path's projection (covering: at least those of keys of
    which some written row meets the constraints), ``written`` has the keys of all of them.  A covering scan meets
    only the keys that it found with those, so that what was written is not sorted as a whole.  A lookup restricts the base
    to the primary keys that the index finds and those written since, by a semi-join whose strategy Catalyst
    chooses by size.
    """
    where, key = conjunction(constraints), list(table.primary_key)
    if path.mode == "covering":
        p = projections[path.path].rows.filter(where)
        if newer is None:
            return p.select(*columns)
        touched = (newer if written is None else written).select(*key).join(p.select(*key), key, "left_semi")
        return replaced(p, newer.filter(where), key, touched).select(*columns)
    if path.mode == "lookup":
        p = projections[path.path].rows
        keys = p.filter(conjunction([c for c in constraints if c.column in p.columns])).select(*key)
        if newer is not None:
            keys = keys.unionByName(newer.select(*key))
        return base.filter(where).join(keys, key, "left_semi").select(*columns)
    return base.filter(where).select(*columns)
