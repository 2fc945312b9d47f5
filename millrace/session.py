"""The engine: a Spark session, a catalog, and data for the catalog's tables."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession

from millrace.errors import AnalysisError, SchemaError
from millrace.functions.scalar import evaluate
from millrace.functions.types import ValueType
from millrace.operators.relational import finish, source
from millrace.operators.table import Table, conform
from millrace.plans.analyzer import Analyzer, Query, analyze
from millrace.plans.ast import Binary, ColumnRef, Expr, Literal, Select, Unary
from millrace.plans.normalize import normalize
from millrace.plans.parser import parse
from millrace.sources.catalog import Catalog, FieldDef, TableDef, table_of
from millrace.sources.render import render


def show(e: Expr | None) -> str:
    """An expression as dialect text, with every operation in parentheses."""
    if e is None:
        return "TRUE"
    if isinstance(e, Literal):
        if e.type == ValueType.STRING:
            return f'"{e.value}"'
        return f"'{e.value}'" if e.type == ValueType.CHAR else str(e.value).upper() if e.type == ValueType.BOOL else str(e.value)
    if isinstance(e, ColumnRef):
        return str(e)
    if isinstance(e, Unary):
        return f"(-{show(e.operand)})" if e.op == "-" else f"(NOT {show(e.operand)})"
    return f"({show(e.left)} {e.op} {show(e.right)})" if isinstance(e, Binary) else str(e)


class Engine:
    """Runs queries of the dialect. Queries are lazy DataFrames; nothing is kept between them."""

    def __init__(self, spark: SparkSession, catalog: Catalog | None = None) -> None:
        self.spark, self.catalog = spark, catalog or Catalog()
        self.data: dict[str, DataFrame] = {}

    # Data

    def register(self, name: str, rows: DataFrame, definition: TableDef | None = None, check: bool = False) -> Table:
        """Give a table its rows. Without a definition it is declared from their schema.

        ``check`` makes breaking rows (nulls, over-long texts, values outside an enforced domain) an error;
        it is always on for tables with enforced domains, which prune queries. Fields of unchecked rows may hold nulls if
        the rows' schema allows that: comparisons with null are then never true, under NOT neither.
        """
        known = self.catalog.get(name) or self.catalog.add(definition or table_of(name, rows.schema))
        check = check or any(f.enforced for f in known.fields)
        open_to_null = {f.name for f in rows.schema.fields if f.nullable and not check}
        known = replace(known, fields=tuple(replace(f, nullable=f.name in open_to_null) for f in known.fields))
        self.catalog.tables[name] = known
        self.data[name] = conform(known, rows, check)
        return Table(known, self.data[name])

    def read(self, name: str, path: str, **options: str) -> Table:
        """Register a Parquet file or folder."""
        return self.register(name, self.spark.read.options(**options).parquet(path))

    def table(self, name: str) -> Table:
        definition = self.catalog.get(name)
        if definition is None:
            raise AnalysisError("INVALID_TABLE", f"Invalid table {name}")
        if name not in self.data:
            raise SchemaError(f"Table {name} has no data")
        return Table(definition, self.data[name])

    def put(self, table: Table) -> None:
        """Make a table's new state the one that queries see."""
        self.data[table.definition.name] = table.rows

    # Queries

    def analyze(self, text: str) -> tuple[Query, Expr | None, Analyzer]:
        """The resolved query and its normalised condition."""
        found = parse(text)
        if not isinstance(found, Select):
            raise AnalysisError("NOT_A_QUERY", "Not a SELECT")
        query = analyze(found, self.catalog.tables)
        own = Analyzer(self.catalog.tables, query.tables)

        def lookup(c: ColumnRef) -> FieldDef:
            return own.resolve(c)[1]

        return query, normalize(query.where, lookup) if query.where is not None else None, own

    def sql(self, text: str) -> DataFrame:
        query, where, own = self.analyze(text)
        frames = {t: self.table(t).rows for t in query.tables}
        return finish(query, source(query, where, frames, own.type_of))

    def explain(self, text: str) -> str:
        """The normalised condition and Spark's plan."""
        _, where, _ = self.analyze(text)
        plan = self.sql(text)._jdf.queryExecution().toString()
        return f"WHERE {show(where)}\n{plan}"

    def show(self, text: str) -> str:
        """The result as a text grid; it is gathered on the driver."""
        return render(self.sql(text))

    def evaluate_const(self, text: str) -> int | float | bool | str:
        """The value of an expression without columns."""
        found = parse(text)
        if isinstance(found, Select):
            raise AnalysisError("NOT_AN_EXPRESSION", "Not an expression")
        Analyzer({}, ()).type_of(found)
        return evaluate(found)
