"""Scalar expressions: as Spark columns, and as plain Python values.

Integers are 64-bit and division truncates towards zero; overflow and division by zero are errors. A
character counts as its code where it meets a number.
"""

from __future__ import annotations

import operator
from collections.abc import Callable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.functions.types import ARITHMETIC, ValueType
from millrace.plans.ast import Binary, ColumnRef, Expr, Literal, Unary

_COMPARE = {"=": operator.eq, "!=": operator.ne, "<": operator.lt, ">": operator.gt, "<=": operator.le, ">=": operator.ge}
_SPARK_TYPE = {ValueType.INT64: "bigint", ValueType.DOUBLE: "double", ValueType.BOOL: "boolean", ValueType.CHAR: "string", ValueType.STRING: "string"}

TypeOf = Callable[[Expr], ValueType]


def lower(e: Expr, column: Callable[[ColumnRef], Column], type_of: TypeOf) -> Column:
    """The Spark column of an expression; ``column`` gives that of a resolved reference."""
    kind = type_of(e)
    if isinstance(e, Literal):
        return F.lit(e.value).cast(_SPARK_TYPE[kind])
    if isinstance(e, ColumnRef):
        found = column(e)
        return found.cast("bigint") if kind == ValueType.INT64 else found
    if isinstance(e, Unary):
        inner = lower(e.operand, column, type_of)
        if e.op == "NOT":
            return ~inner
        if kind == ValueType.CHAR:
            return F.chr(-F.ascii(inner))
        # A boolean is its own negative: it counts as 0 or 1.
        return inner if kind == ValueType.BOOL else -inner
    left, right = lower(e.left, column, type_of), lower(e.right, column, type_of)
    kinds = {type_of(e.left), type_of(e.right)}
    if e.op in ("AND", "OR"):
        return left & right if e.op == "AND" else left | right
    if ValueType.CHAR in kinds:
        left, right = (F.ascii(c).cast("bigint") if type_of(s) == ValueType.CHAR else c for s, c in ((e.left, left), (e.right, right)))
    elif ValueType.DOUBLE in kinds:
        left, right = left.cast("double"), right.cast("double")
    if e.op not in ARITHMETIC:
        return _COMPARE[e.op](left, right)
    if e.op == "/":
        return left / right if kind == ValueType.DOUBLE else F.call_function("div", left, right)
    found = {"+": operator.add, "-": operator.sub, "*": operator.mul, "%": operator.mod}[e.op](left, right)
    return F.chr(found) if kind == ValueType.CHAR else found


def evaluate(e: Expr, row: Mapping[ColumnRef, object] | None = None) -> int | float | bool | str:
    """The value of an expression in Python, for one row; the same rules as ``lower``. Types must have been checked."""
    if isinstance(e, Literal):
        return e.value
    if isinstance(e, ColumnRef):
        return row[e]  # type: ignore[index,return-value]
    if isinstance(e, Unary):
        inner = evaluate(e.operand, row)
        return not inner if e.op == "NOT" else inner if isinstance(inner, bool) else -inner  # type: ignore[operator]
    left, right = evaluate(e.left, row), evaluate(e.right, row)
    if e.op == "AND":
        return bool(left and right)
    if e.op == "OR":
        return bool(left or right)
    texts = isinstance(left, str), isinstance(right, str)
    if any(texts) and (e.op in ARITHMETIC or not all(texts)):
        left, right = (ord(v) if isinstance(v, str) else v for v in (left, right))
    if e.op in _COMPARE:
        return _COMPARE[e.op](left, right)
    both = isinstance(left, int) and isinstance(right, int)
    if e.op in ("/", "%"):
        if right == 0:
            raise ZeroDivisionError(f"{left} {e.op} 0")
        if not both:
            return left / right  # type: ignore[operator]
        whole = abs(left) // abs(right) * (1 if (left < 0) == (right < 0) else -1)  # type: ignore[operator,arg-type]
        found = whole if e.op == "/" else left - whole * right  # type: ignore[operator]
    else:
        found = {"+": operator.add, "-": operator.sub, "*": operator.mul}[e.op](left, right)
    if both and not -(1 << 63) <= found < 1 << 63:
        raise OverflowError(f"{left} {e.op} {right}")
    return chr(found) if any(texts) else found
