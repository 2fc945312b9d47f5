r"""Records as lines of text: ``Type: value`` pieces between bars, as in ``Record: | Int: 3 | String: "a" | ``.

Both spellings of types and booleans are read (LongInt or Int64, 0/1 or True/False), so what is written can be
read again. In texts a backslash is written \\, a quote \q, a bar \p, a line feed \n and a carriage return \r; a bar
between quotes doesn't end a piece. A line that doesn't have a table's fields, in type and order, is dropped or an error, as asked.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.types import SPARK_OF, FieldType
from millrace.operators.relational import quoted
from millrace.sources.catalog import TableDef

#: The type names of the format, the one written first.
NAMES = {
    FieldType.INT: ("Int",),
    FieldType.LONGINT: ("LongInt", "Int64"),
    FieldType.DOUBLE: ("Double",),
    FieldType.BOOL: ("Bool",),
    FieldType.CHAR: ("Char",),
    FieldType.STRING: ("String",),
    FieldType.CHARARRAY: ("CharArray",),
}
_TEXTS = (FieldType.STRING, FieldType.CHARARRAY, FieldType.CHAR)


#: What stands for a character of a text, the backslash first.
ESCAPES = {"\\": "\\\\", '"': "\\q", "|": "\\p", "\n": "\\n", "\r": "\\r"}


def _escaped(text: Column) -> Column:
    for character, written in ESCAPES.items():
        text = F.replace(text, F.lit(character), F.lit(written))
    return text


def _unescaped(text: Column) -> Column:
    """Each part between doubled backslashes has its own escapes."""

    def plain(part: Column) -> Column:
        for character, written in list(ESCAPES.items())[1:]:
            part = F.replace(part, F.lit(written), F.lit(character))
        return part

    return F.array_join(F.transform(F.split(text, r"\\\\"), plain), "\\")


def _value(kind: FieldType, text: Column) -> Column:
    if kind == FieldType.BOOL:
        return F.when(F.lower(text).isin("1", "true"), F.lit(True)).when(F.lower(text).isin("0", "false"), F.lit(False))
    return _unescaped(text) if kind in _TEXTS else text.try_cast(SPARK_OF[kind])


def parse_records(lines: DataFrame, table: TableDef, column: str = "value", strict: bool = False) -> DataFrame:
    """Lines of text to rows of the table."""
    pieces = F.filter(F.split(F.col(column), r'\|(?=(?:[^"]*"[^"]*")*[^"]*$)'), lambda p: p.rlike(r"^\s*\w+\s*:.*\S\s*$") & ~p.rlike(r"^\s*Record\s*:\s*$"))
    rows = lines.select(pieces.alias("p"))
    good = F.size("p") == len(table.fields)
    out = []
    for i, f in enumerate(table.fields):
        piece = F.get("p", F.lit(i))
        kind = F.trim(F.substring_index(piece, ":", 1))
        text = F.regexp_extract(piece, r"^\s*\w+\s*:\s*\"?(.*?)\"?\s*$", 1)
        value = _value(f.type, text)
        good = good & F.coalesce(kind.isin(*NAMES[f.type]), F.lit(False)) & value.isNotNull()
        out.append(value.alias(f.name))
    if strict:
        good = F.when(good, F.lit(True)).otherwise(F.raise_error(F.lit(f"Not a record of {table.name}")).cast("boolean"))
    return rows.where(good).select(*out)


def read_records(spark: SparkSession, path: str, table: TableDef, strict: bool = False) -> DataFrame:
    return parse_records(spark.read.text(path), table, strict=strict)


def format_records(rows: DataFrame, table: TableDef) -> DataFrame:
    """Rows of the table to lines, in the column value."""
    parts = []
    for f in table.fields:
        text = F.col(quoted(f.name)).cast("string")
        if f.type == FieldType.BOOL:
            text = F.initcap(text)
        if f.type in _TEXTS:
            text = F.concat(F.lit('"'), _escaped(text), F.lit('"'))
        parts.append(F.concat(F.lit(f"{NAMES[f.type][0]}: "), text, F.lit(" | ")))
    return rows.select(F.concat(F.lit("Record: | "), *parts).alias("value"))


def write_records(rows: DataFrame, table: TableDef, path: str) -> None:
    format_records(rows, table).write.text(path)
