"""A resolved query to a DataFrame.

One filter stands on each table for the conditions that only it needs, the rest is the join condition, so
that the optimizer pushes filters into scans and picks the join. Conditions that tie two tables by equality
make it an equi-join; without any the join is a cross join, as the query says.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.scalar import TypeOf, lower
from millrace.functions.types import FieldType
from millrace.plans.analyzer import Output, Query
from millrace.plans.ast import ColumnRef, Expr
from millrace.plans.normalize import FALSE, TRUE, columns_of, conjuncts, joined


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def reference(table: str, column: str) -> Column:
    return F.col(f"{quoted(table)}.{quoted(column)}")


def tables_of(e: Expr) -> set[str]:
    return {c.table for c in columns_of(e) if c.table}


def condition(e: Expr, type_of: TypeOf) -> Column:
    return lower(e, lambda c: reference(c.table or "", c.name), type_of)


def source(query: Query, where: Expr | None, frames: Mapping[str, DataFrame], type_of: TypeOf) -> DataFrame:
    """The filtered and joined rows of a query, before projection; columns are reached as table.column."""
    parts = [] if where is None or where == TRUE else conjuncts(where)
    named = {t: frames[t].alias(t) for t in query.tables}
    if where == FALSE or any(not tables_of(p) for p in parts):
        constant = [p for p in parts if not tables_of(p)]
        parts = [p for p in parts if tables_of(p)]
        first = query.tables[0]
        named[first] = named[first].where(F.lit(False) if where == FALSE else condition(joined(constant), type_of))  # type: ignore[arg-type]
    for table in query.tables:
        own = [p for p in parts if tables_of(p) == {table}]
        if own:
            named[table] = named[table].where(condition(joined(own), type_of))  # type: ignore[arg-type]
    rest = [p for p in parts if len(tables_of(p)) > 1]
    order = _join_order(query.tables, rest)
    rows, seen = named[order[0]], {order[0]}
    for table in order[1:]:
        seen.add(table)
        on = [p for p in rest if tables_of(p) <= seen]
        rest = [p for p in rest if p not in on]
        rows = rows.join(named[table], condition(joined(on), type_of), "inner") if on else rows.crossJoin(named[table])  # type: ignore[arg-type]
    return rows


def _join_order(tables: tuple[str, ...], conditions: list[Expr]) -> list[str]:
    """The tables as written, but each next one tied to those before it where there is one."""
    order, left = [tables[0]], list(tables[1:])
    while left:
        tied = next((t for t in left if any(t in tables_of(p) and tables_of(p) <= {t, *order} for p in conditions)), left[0])
        order.append(tied)
        left.remove(tied)
    return order


def aggregate(o: Output) -> Column:
    """The value of an aggregate function.

    Sums of integers are 64-bit. The average of integers is their sum divided by their number, towards zero.
    """
    if o.field is None:
        return F.count(F.lit(1))
    column = reference(o.table or "", o.field.name)
    integer = o.field.type in (FieldType.INT, FieldType.LONGINT)
    if o.aggregate == "COUNT":
        return F.count(column)
    if o.aggregate == "SUM":
        return F.sum(column.cast("bigint") if integer else column)
    if o.aggregate == "AVG":
        return F.call_function("div", F.sum(column.cast("bigint")), F.count(column)) if integer else F.avg(column)
    return F.max(column) if o.aggregate == "MAX" else F.min(column)


def finish(query: Query, rows: DataFrame) -> DataFrame:
    """Grouping, order and projection."""
    prefix = len(query.tables) > 1
    names = {o: o.name(prefix) for o in query.outputs}
    if query.aggregated or query.keys:
        keys = [reference(o.table or "", o.field.name).alias(names[o]) for o in query.keys if o.field]
        sums = [aggregate(o).alias(names[o]) for o in query.outputs if o.aggregate]
        grouped = rows.groupBy(*keys) if keys else rows
        rows = grouped.agg(*sums) if sums else rows.select(*keys).distinct()
        column: Callable[[Output], Column] = lambda o: F.col(quoted(names[o]))
    else:
        column = lambda o: reference(o.table or "", o.field.name)  # type: ignore[union-attr]
    if query.order:
        rows = rows.orderBy(*[column(o).asc() for o in query.order])
    return rows.select(*[column(o).alias(names[o]) for o in query.outputs])
