"""The syntax tree."""

from __future__ import annotations

from dataclasses import dataclass

from millrace.functions.types import ValueType


@dataclass(frozen=True)
class Literal:
    value: int | float | bool | str
    type: ValueType


@dataclass(frozen=True)
class ColumnRef:
    """A column as written; the table is None where none is written."""

    table: str | None
    name: str

    def __str__(self) -> str:
        return f"{self.table}.{self.name}" if self.table else self.name


@dataclass(frozen=True)
class Unary:
    op: str  # - or NOT
    operand: Expr


@dataclass(frozen=True)
class Binary:
    op: str
    left: Expr
    right: Expr


Expr = Literal | ColumnRef | Unary | Binary


@dataclass(frozen=True)
class Item:
    """A column (or ``*``) of the select list or the order, with its aggregate function if any."""

    column: ColumnRef
    aggregate: str | None = None

    def __str__(self) -> str:
        return f"{self.aggregate}({self.column})" if self.aggregate else str(self.column)


@dataclass(frozen=True)
class Select:
    items: tuple[Item, ...]
    tables: tuple[str, ...]
    where: Expr | None = None
    group: tuple[ColumnRef, ...] = ()
    order: tuple[Item, ...] = ()
