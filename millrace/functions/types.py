"""The seven declared types, the five evaluation types, and what each operator takes and gives."""

from __future__ import annotations

from enum import StrEnum

from pyspark.sql import types as T


class FieldType(StrEnum):
    """Declared type of a field. OTHER: a Spark type outside the dialect; it can be selected and counted, no more."""

    INT = "INT"
    LONGINT = "LONGINT"
    DOUBLE = "DOUBLE"
    BOOL = "BOOL"
    CHAR = "CHAR"
    STRING = "STRING"
    CHARARRAY = "CHARARRAY"
    OTHER = "OTHER"


class ValueType(StrEnum):
    """Type of a value in an expression."""

    INT64 = "INT64"
    DOUBLE = "DOUBLE"
    BOOL = "BOOL"
    CHAR = "CHAR"
    STRING = "STRING"
    OTHER = "OTHER"


VALUE_OF = {
    FieldType.INT: ValueType.INT64,
    FieldType.LONGINT: ValueType.INT64,
    FieldType.DOUBLE: ValueType.DOUBLE,
    FieldType.BOOL: ValueType.BOOL,
    FieldType.CHAR: ValueType.CHAR,
    FieldType.STRING: ValueType.STRING,
    FieldType.CHARARRAY: ValueType.STRING,
    FieldType.OTHER: ValueType.OTHER,
}

SPARK_OF: dict[FieldType, T.DataType] = {
    FieldType.INT: T.IntegerType(),
    FieldType.LONGINT: T.LongType(),
    FieldType.DOUBLE: T.DoubleType(),
    FieldType.BOOL: T.BooleanType(),
    FieldType.CHAR: T.StringType(),
    FieldType.STRING: T.StringType(),
    FieldType.CHARARRAY: T.StringType(),
}


def declared(spark_type: T.DataType) -> FieldType:
    """The field type that holds a Spark type."""
    for wide, kind in ((T.LongType, FieldType.LONGINT), (T.DoubleType, FieldType.DOUBLE), (T.BooleanType, FieldType.BOOL), (T.StringType, FieldType.STRING)):
        if isinstance(spark_type, wide):
            return kind
    return FieldType.INT if isinstance(spark_type, T.IntegerType | T.ShortType | T.ByteType) else FieldType.OTHER


ARITHMETIC, EQUALITY, ORDERING, LOGIC = ("+", "-", "*", "/", "%"), ("=", "!="), ("<", ">", "<=", ">="), ("AND", "OR")
NUMBERS = {ValueType.INT64, ValueType.DOUBLE}


def result_type(op: str, left: ValueType, right: ValueType) -> ValueType | None:
    """What ``left op right`` gives; None if the operator doesn't take such operands."""
    both = {left, right}
    number = ValueType.DOUBLE if ValueType.DOUBLE in both else ValueType.INT64
    if op in ARITHMETIC:
        if op == "%":
            return ValueType.INT64 if both == {ValueType.INT64} else None
        if both <= NUMBERS:
            return number
        # A character and an integer, or two characters, add and subtract as character codes.
        return ValueType.CHAR if op in ("+", "-") and ValueType.CHAR in both and both <= {ValueType.CHAR, ValueType.INT64} else None
    if op in EQUALITY or op in ORDERING:
        if both <= NUMBERS or (ValueType.CHAR in both and both <= {ValueType.CHAR, ValueType.INT64}) or both == {ValueType.STRING}:
            return ValueType.BOOL
        return ValueType.BOOL if both == {ValueType.BOOL} and op in EQUALITY else None
    if op in LOGIC:
        return ValueType.BOOL if both == {ValueType.BOOL} else None
    raise ValueError(op)


def negated_type(operand: ValueType) -> ValueType | None:
    """What unary minus gives: anything but strings and types outside the dialect can be negated."""
    if operand in (ValueType.STRING, ValueType.OTHER):
        return None
    return operand


AGGREGATES = ("SUM", "COUNT", "AVG", "MAX", "MIN")


def aggregates(name: str, field: FieldType) -> bool:
    """Whether an aggregate function takes a field of the type."""
    if name == "COUNT":
        return True
    if field == FieldType.OTHER:
        return False
    return field in (FieldType.INT, FieldType.LONGINT, FieldType.DOUBLE) if name in ("SUM", "AVG") else field != FieldType.BOOL
