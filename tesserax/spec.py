"""Schemas of databases: named tables of known kinds, validated, with a fingerprint."""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict, dataclass, field

from pyspark.sql.types import BinaryType, DoubleType, IntegerType, LongType, StringType, StructField, StructType

TYPES = {"bigint": LongType(), "int": IntegerType(), "double": DoubleType(), "string": StringType(), "binary": BinaryType()}
KINDS = ("map", "multimap", "sequence", "blob", "queue", "boxes", "log")
COORDINATES = ("bigint", "int", "double")


class SpecError(ValueError):
    """A schema or a value that breaks a rule."""


@dataclass(frozen=True)
class Table:
    """One component. ``settings`` are its limits: max_key, max_value, chunk_size, dimensions, coordinate."""

    name: str
    kind: str
    columns: tuple[tuple[str, str], ...]
    version: int = 1
    settings: tuple[tuple[str, object], ...] = ()

    def __post_init__(self):
        raw = self.name.encode()
        if not 1 <= len(raw) <= 255 or "\0" in self.name:
            raise SpecError(f"bad name {self.name!r}")
        if any(part.startswith("$") for part in self.name.split(".")):
            raise SpecError(f"reserved name {self.name!r}")
        if self.kind not in KINDS:
            raise SpecError(f"unknown kind {self.kind!r}")
        if bad := [t for _, t in self.columns if t not in TYPES]:
            raise SpecError(f"unknown types {bad}")
        if len({c for c, _ in self.columns}) != len(self.columns):
            raise SpecError("repeated column")
        limits = dict(self.settings)
        if self.kind == "boxes" and (limits.get("dimensions", 0) < 1 or limits.get("coordinate") not in COORDINATES):
            raise SpecError("boxes need dimensions of 1 or more and a signed or floating coordinate")
        if self.kind == "sequence" and limits.get("chunk_size", 256) < 1:
            raise SpecError("chunks need a size")

    def struct(self) -> StructType:
        return StructType([StructField(c, TYPES[t]) for c, t in self.columns])


@dataclass(frozen=True)
class Database:
    """An immutable set of tables; ``add`` gives a new one."""

    tables: tuple[Table, ...] = field(default=())

    def add(self, table: Table) -> Database:
        if any(t.name == table.name for t in self.tables):
            raise SpecError(f"repeated table {table.name!r}")
        return Database((*self.tables, table))

    def table(self, name: str) -> Table:
        found = [t for t in self.tables if t.name == name]
        if not found:
            raise SpecError(f"no table {name!r}")
        return found[0]

    def canonical(self) -> str:
        return json.dumps([asdict(t) for t in self.tables], sort_keys=True, separators=(",", ":"))

    def fingerprint(self) -> str:
        """Depends on names, kinds, versions, columns and settings, and on their order."""
        return hashlib.sha256(self.canonical().encode()).hexdigest()


#: The work-order application: orders by id, where they are, what is due, and a log.
DISPATCH = (
    Database()
    .add(Table("orders", "map", (("k", "bigint"), ("v", "string")), settings=(("max_key", 8), ("max_value", 64))))
    .add(Table("areas", "boxes", (("id", "bigint"), ("lo0", "bigint"), ("hi0", "bigint"), ("lo1", "bigint"), ("hi1", "bigint")), settings=(("dimensions", 2), ("coordinate", "bigint"))))
    .add(Table("due", "queue", (("k", "bigint"),)))
    .add(Table("audit", "log", (("seq", "bigint"), ("line", "string"))))
)
