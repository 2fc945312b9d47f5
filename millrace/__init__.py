"""A relational analytics engine on Spark DataFrames: a compact SQL dialect, a typed catalog and a table API."""

from millrace.errors import AnalysisError, EngineError, ParseError, SchemaError
from millrace.session import Engine
from millrace.sources.catalog import Catalog, FieldDef, IndexDef, TableDef

__all__ = ["AnalysisError", "Catalog", "Engine", "EngineError", "FieldDef", "IndexDef", "ParseError", "SchemaError", "TableDef"]
