"""The typed catalog: tables, fields, declared domains and key fields.

Keys are a declaration, a hint for the order in which data is written; nothing is unique because of them.
A declared domain prunes queries only if its field says that it is enforced, and then every load checks it.
"""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field
from pathlib import Path

from pyspark.sql import types as T

from millrace.errors import SchemaError
from millrace.functions.types import SPARK_OF, FieldType, declared

Value = int | float | bool | str


@dataclass(frozen=True)
class FieldDef:
    name: str
    type: FieldType
    size: int | None = None  # CHARARRAY: most characters
    min: Value | None = None
    max: Value | None = None
    enforced: bool = False  # the domain is checked when data is loaded, and prunes queries
    nullable: bool = False  # rows are registered unchecked and may hold nulls

    def __post_init__(self) -> None:
        if self.type == FieldType.CHARARRAY and not (self.size and self.size > 0):
            raise SchemaError(f"{self.name}: a CHARARRAY needs a size")
        if self.enforced and (self.min is None or self.max is None):
            raise SchemaError(f"{self.name}: an enforced domain needs both ends")
        if self.min is not None and self.max is not None and self.min > self.max:  # type: ignore[operator]
            raise SchemaError(f"{self.name}: the domain is empty")

    def spark(self, other: T.DataType | None = None) -> T.StructField:
        meta = {k: v for k, v in {"declared_type": self.type.value, "size": self.size, "min": self.min, "max": self.max}.items() if v is not None}
        kind = SPARK_OF.get(self.type, other)
        if kind is None:
            raise SchemaError(f"{self.name}: {self.type} has no Spark type of its own")
        return T.StructField(self.name, kind, nullable=False, metadata=meta)


@dataclass(frozen=True)
class IndexDef:
    """Fields of a key, by name."""

    fields: tuple[str, ...]


@dataclass(frozen=True)
class TableDef:
    name: str
    fields: tuple[FieldDef, ...]
    primary: IndexDef | None = None
    indexes: tuple[IndexDef, ...] = ()

    def __post_init__(self) -> None:
        names = [f.name for f in self.fields]
        if not names:
            raise SchemaError(f"Table {self.name} has no fields")
        if len(set(names)) != len(names):
            raise SchemaError(f"Table {self.name} has two fields of one name")
        keys = [i.fields for i in (*([self.primary] if self.primary else []), *self.indexes)]
        if len(set(keys)) != len(keys):
            raise SchemaError(f"Table {self.name} declares an index twice")
        for key in keys:
            if not key or not set(key) <= set(names):
                raise SchemaError(f"Table {self.name} has an index on {key}, not fields of it")

    def get(self, name: str) -> FieldDef | None:
        return next((f for f in self.fields if f.name == name), None)

    def at(self, index: int) -> FieldDef:
        return self.fields[index]

    @property
    def key(self) -> tuple[str, ...]:
        """The fields that data is ordered by: the primary index, or the first field."""
        return self.primary.fields if self.primary else (self.fields[0].name,)

    def has_index(self, *fields: str) -> bool:
        return fields == self.key or any(i.fields == fields for i in self.indexes)

    def schema(self) -> T.StructType:
        return T.StructType([f.spark() for f in self.fields])


@dataclass
class Catalog:
    """Tables by name; names are case-sensitive."""

    name: str = "default"
    tables: dict[str, TableDef] = field(default_factory=dict)

    def add(self, table: TableDef) -> TableDef:
        if table.name in self.tables:
            raise SchemaError(f"Table {table.name} exists already")
        self.tables[table.name] = table
        return table

    def get(self, name: str) -> TableDef | None:
        return self.tables.get(name)

    def to_dict(self) -> dict:
        return {"name": self.name, "tables": [asdict(t) for t in self.tables.values()]}

    @classmethod
    def from_dict(cls, data: dict) -> Catalog:
        catalog = cls(data.get("name", "default"))
        for t in data.get("tables", []):
            fields = tuple(FieldDef(**{**f, "type": FieldType(f["type"])}) for f in t["fields"])
            primary = IndexDef(tuple(t["primary"]["fields"])) if t.get("primary") else None
            catalog.add(TableDef(t["name"], fields, primary, tuple(IndexDef(tuple(i["fields"])) for i in t.get("indexes", []))))
        return catalog

    def save(self, path: str) -> None:
        Path(path).write_text(json.dumps(self.to_dict(), indent=1))

    @classmethod
    def load(cls, path: str) -> Catalog:
        return cls.from_dict(json.loads(Path(path).read_text()))


def table_of(name: str, schema: T.StructType, primary: tuple[str, ...] | None = None) -> TableDef:
    """A table definition for a DataFrame's schema."""
    return TableDef(name, tuple(FieldDef(f.name, declared(f.dataType)) for f in schema.fields), IndexDef(primary) if primary else None)
