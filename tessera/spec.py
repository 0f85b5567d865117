"""Declared tables: columns, primary key and index projections, with the rules they must keep."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Literal

from pyspark.sql import types as T

MAX_TABLES, MAX_INDEXES = 16, 15

#: kind -> (Spark type, key width in bytes or None where variable, may be in a primary key, may be in an index key)
KINDS: dict[str, tuple[T.DataType, int | None, bool, bool]] = {
    "int64": (T.LongType(), 8, True, True),
    "uint64": (T.DecimalType(20, 0), 8, True, True),
    "float64": (T.DoubleType(), 8, False, True),
    "boolean": (T.BooleanType(), 1, False, True),
    "utf8": (T.StringType(), None, True, True),
    "date32": (T.DateType(), 4, False, True),
    "date64": (T.TimestampNTZType(), 8, False, True),
    "timestamp": (T.TimestampNTZType(), 8, False, True),
    "timestamp_tz": (T.TimestampType(), 8, False, True),
    "binary": (T.BinaryType(), None, False, False),
}
LIST_ITEMS = {"int64", "float64", "boolean", "utf8"}


class SpecError(ValueError):
    """A declaration that breaks a rule."""


@dataclass(frozen=True)
class ColumnSpec:
    """``kind`` is one of KINDS, ``decimal(p,s)``, ``fixed(n)`` (bytes) or ``list<item>``."""

    name: str
    kind: str
    nullable: bool = False

    def _parts(self) -> tuple[T.DataType, int | None, bool, bool]:
        if self.kind in KINDS:
            return KINDS[self.kind]
        head, _, rest = self.kind.replace("<", "(").rstrip(">)").partition("(")
        if head == "decimal":
            p, s = (int(x) for x in rest.split(","))
            if p > 38:
                raise SpecError(f"{self.name}: precision {p} is beyond Spark's 38")
            return T.DecimalType(p, s), 16, False, True
        if head == "fixed":
            return T.BinaryType(), int(rest), True, True
        if head == "list" and rest in LIST_ITEMS:
            return T.ArrayType(KINDS[rest][0]), None, False, False
        raise SpecError(f"{self.name}: {self.kind} is no supported type")

    @property
    def spark_type(self) -> T.DataType:
        return self._parts()[0]

    @property
    def width(self) -> int | None:
        return self._parts()[1]

    @property
    def keyable(self) -> bool:
        return self._parts()[2]

    @property
    def indexable(self) -> bool:
        return self._parts()[3]

    @property
    def fixed_bytes(self) -> int | None:
        return self.width if self.kind.startswith("fixed(") else None


@dataclass(frozen=True)
class IndexSpec:
    name: str
    keys: tuple[str, ...]
    cover: tuple[str, ...] = ()
    layout: Literal["lexicographic", "z_order"] = "lexicographic"


@dataclass(frozen=True)
class TableSpec:
    name: str
    columns: tuple[ColumnSpec, ...]
    primary_key: tuple[str, ...]
    indexes: tuple[IndexSpec, ...] = field(default=())

    def __post_init__(self) -> None:
        names = [c.name for c in self.columns]
        if not names or not self.primary_key:
            raise SpecError(f"{self.name}: a table needs a column and a primary key column")
        if any(not n.strip() for n in [self.name, *names]) or len(set(names)) != len(names):
            raise SpecError(f"{self.name}: names must be unique and not blank")
        for k in self.primary_key:
            if k not in names or not self.column(k).keyable or self.column(k).nullable:
                raise SpecError(f"{self.name}: {k} cannot be in the primary key")
        if len(set(self.primary_key)) != len(self.primary_key):
            raise SpecError(f"{self.name}: the primary key repeats a column")
        if len(self.indexes) > MAX_INDEXES or len({i.name for i in self.indexes}) != len(self.indexes):
            raise SpecError(f"{self.name}: too many indexes, or two of one name")
        for i in self.indexes:
            if not i.name.strip() or not i.keys or len(set(i.keys)) != len(i.keys):
                raise SpecError(f"{self.name}: index {i.name!r} needs a name and distinct keys")
            for k in i.keys:
                if k not in names or not self.column(k).indexable or self.column(k).nullable:
                    raise SpecError(f"{self.name}.{i.name}: {k} cannot be an index key")
                if i.layout == "z_order" and self.column(k).width is None:
                    raise SpecError(f"{self.name}.{i.name}: z-order needs columns of fixed width, not {k}")
            for c in i.cover:
                if c not in names or c in self.primary_key:
                    raise SpecError(f"{self.name}.{i.name}: {c} cannot be covered")

    def column(self, name: str) -> ColumnSpec:
        return next(c for c in self.columns if c.name == name)

    def index(self, name: str) -> IndexSpec:
        return next(i for i in self.indexes if i.name == name)

    @property
    def schema(self) -> T.StructType:
        return T.StructType([T.StructField(c.name, c.spark_type, c.nullable) for c in self.columns])

    def evolve(self, indexes: tuple[IndexSpec, ...]) -> TableSpec:
        """More indexes: the present ones must be the first of the new list, unchanged."""
        if tuple(indexes[: len(self.indexes)]) != self.indexes:
            raise SpecError(f"{self.name}: indexes may only be added at the end")
        return TableSpec(self.name, self.columns, self.primary_key, tuple(indexes))
