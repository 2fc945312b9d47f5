"""The table API: load, insert, delete, search and scan. Every operation gives a new DataFrame or state.

Data written by ``save`` is ranged and sorted by the table's key, so that later point and range searches skip
row groups by their statistics.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.errors import SchemaError
from millrace.functions.types import SPARK_OF, FieldType
from millrace.operators.relational import quoted
from millrace.sources.catalog import FieldDef, TableDef, Value


def violations(table: TableDef, rows: DataFrame) -> Column:
    """What breaks the declaration in a row: null, a text that is too long, a value outside an enforced domain."""
    found = F.lit(False)
    for f in table.fields:
        c = rows[quoted(f.name)]
        bad = c.isNull()
        if f.type == FieldType.CHARARRAY:
            bad = bad | (F.length(c) > f.size)
        if f.type == FieldType.CHAR:
            bad = bad | (F.length(c) != 1) | (F.ascii(c) > 127)
        if f.enforced:
            bad = bad | ~c.between(f.min, f.max)
        found = found | F.coalesce(bad, F.lit(True))
    return found


def conform(table: TableDef, rows: DataFrame, check: bool = True) -> DataFrame:
    """The rows with the table's columns and types in order; with ``check``, breaking rows are an error.

    The check is part of the plan: nothing is read for it beforehand.
    """
    missing = [f.name for f in table.fields if f.name not in rows.columns]
    if missing:
        raise SchemaError(f"Table {table.name}: no columns {missing}")
    if len(rows.columns) != len(table.fields):
        raise SchemaError(f"Table {table.name} has {len(table.fields)} fields, the rows have {len(rows.columns)} columns")
    out = []
    for f in table.fields:
        own = rows.schema[f.name].dataType
        want = SPARK_OF.get(f.type, own)
        widened = isinstance(want, T.LongType | T.DoubleType) and isinstance(own, T.IntegerType | T.ShortType | T.ByteType)
        if own != want and not widened:
            raise SchemaError(f"Table {table.name}, field {f.name}: {own.simpleString()} is not {f.type}")
        out.append(rows[quoted(f.name)].cast(want).alias(f.name, metadata=f.spark(own).metadata))
    if check:
        rows = rows.where(F.when(violations(table, rows), F.raise_error(F.lit(f"Table {table.name}: a row breaks its declaration")).cast("boolean")).otherwise(F.lit(True)))
    return rows.select(*out)


def _compare(f: FieldDef, rows: DataFrame, value: Value) -> tuple[Column, Column]:
    kind = SPARK_OF.get(f.type)
    if kind is None:
        raise SchemaError(f"{f.name} can't be searched")
    return rows[quoted(f.name)], F.lit(value).cast(kind)


@dataclass(frozen=True)
class Table:
    """A table's definition with its rows."""

    definition: TableDef
    rows: DataFrame

    def load(self, rows: DataFrame) -> Table:
        """Replace all rows; an empty load is valid."""
        return Table(self.definition, conform(self.definition, rows))

    def insert(self, rows: DataFrame) -> Table:
        """Add rows; duplicates are kept."""
        return Table(self.definition, self.rows.unionByName(conform(self.definition, rows)))

    def delete(self, keys: DataFrame) -> tuple[Table, DataFrame]:
        """Remove the rows whose fields equal one of ``keys`` (by its column names).

        Returns the new state and a one-row DataFrame with the number removed, n.
        """
        names = keys.columns
        for n in names:
            if self.definition.get(n) is None:
                raise SchemaError(f"Table {self.definition.name} has no field {n}")
        if len(names) != len(set(names)) or not names:
            raise SchemaError("Delete needs key columns")
        gone = self.rows.join(keys.distinct(), names, "left_semi").agg(F.count(F.lit(1)).alias("n"))
        return Table(self.definition, self.rows.join(keys.distinct(), names, "left_anti").select(*self.rows.columns)), gone

    def search(
        self,
        key: Mapping[str, Value] | None = None,
        left: Mapping[str, Value] | None = None,
        right: Mapping[str, Value] | None = None,
        left_open: bool = False,
        right_open: bool = False,
    ) -> DataFrame:
        """The rows at a key, or between two keys. A key of several fields is compared field by field, in order."""
        if key is not None and (left or right):
            raise SchemaError("Search takes a key or bounds, not both")
        conditions = []
        if key is not None:
            conditions += [a == b for a, b in (_compare(self._field(n), self.rows, v) for n, v in key.items())]
        if left:
            conditions.append(self._beyond(left, greater=True, is_open=left_open))
        if right:
            conditions.append(self._beyond(right, greater=False, is_open=right_open))
        return self.rows.where(reduce(and_, conditions)) if conditions else self.rows

    def _field(self, name: str) -> FieldDef:
        found = self.definition.get(name)
        if found is None:
            raise SchemaError(f"Table {self.definition.name} has no field {name}")
        return found

    def _beyond(self, bound: Mapping[str, Value], greater: bool, is_open: bool) -> Column:
        """Lexicographic comparison with a bound, with the first field's own bound in front for row-group skipping."""
        pairs = [_compare(self._field(n), self.rows, v) for n, v in bound.items()]
        cases = []
        for i, (column, value) in enumerate(pairs):
            last = i == len(pairs) - 1
            step = (column > value if greater else column < value) if not last or is_open else (column >= value if greater else column <= value)
            cases.append(reduce(and_, [*(a == b for a, b in pairs[:i]), step]))
        first, value = pairs[0]
        return reduce(or_, cases) if len(pairs) == 1 else (first >= value if greater else first <= value) & reduce(or_, cases)

    def scan(self) -> DataFrame:
        return self.rows

    def keys(self, *names: str) -> DataFrame:
        """The key's fields (or the given ones) in their order."""
        own: Sequence[str] = names or self.definition.key
        columns = [self.rows[quoted(self._field(n).name)] for n in own]
        return self.rows.select(*columns).orderBy(*[c.asc() for c in columns])

    def save(self, path: str, partitions: int | None = None) -> None:
        """Write to a new folder, ranged and sorted by the key."""
        key = [F.col(quoted(n)) for n in self.definition.key]
        ranged = self.rows.repartitionByRange(partitions, *key) if partitions else self.rows.repartitionByRange(*key)
        ranged.sortWithinPartitions(*key).write.mode("errorifexists").parquet(path)


def empty(definition: TableDef, like: DataFrame) -> Table:
    """A table without rows."""
    return Table(definition, like.sparkSession.createDataFrame([], definition.schema()))


def union_distinct(a: DataFrame, b: DataFrame, *keys: str) -> DataFrame:
    """Both inputs' rows, one for each key."""
    return a.unionByName(b).dropDuplicates(list(keys) or a.columns)


def merge_sorted(a: DataFrame, b: DataFrame, *keys: str) -> DataFrame:
    """Both inputs' rows, duplicates kept, in the order of the keys."""
    return a.unionByName(b).orderBy(*[F.col(quoted(k)).asc() for k in keys])
