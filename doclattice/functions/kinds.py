"""Kinds of field values, constants, and exact comparison of a column with a constant.

Comparisons never convert across kinds: a constant of another kind makes the atom false. Integers
and floats compare by value, without the loss that a cast would bring; the constant is rewritten so
that it has the column's type, which also lets Parquet skip row groups.
"""

from __future__ import annotations

import math
from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

INTEGER, FLOAT, STRING, BOOLEAN = "integer", "float", "string", "boolean"
SQL_TYPE = {INTEGER: "bigint", FLOAT: "double", STRING: "string", BOOLEAN: "boolean"}
LONG_MIN, LONG_MAX = -(1 << 63), (1 << 63) - 1

Constant = int | float | str | bool


def kind_of_type(t: T.DataType) -> str | None:
    """The kind of a Spark type; None for types that predicates can't address."""
    if isinstance(t, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)) or isinstance(t, T.DecimalType) and t.scale == 0:
        return INTEGER
    if isinstance(t, (T.FloatType, T.DoubleType)):
        return FLOAT
    if isinstance(t, (T.StringType, T.VarcharType, T.CharType)):
        return STRING
    return BOOLEAN if isinstance(t, T.BooleanType) else None


def kind_of(value: Constant) -> str:
    if isinstance(value, bool):
        return BOOLEAN
    return INTEGER if isinstance(value, int) else FLOAT if isinstance(value, float) else STRING


_OPS = {"eq": lambda c, v: c == v, "gt": lambda c, v: c > v, "ge": lambda c, v: c >= v, "lt": lambda c, v: c < v, "le": lambda c, v: c <= v}


def compare(col: Column, kind: str, op: str, value: Constant, ordered_booleans: bool = False) -> Column | None:
    """`col op value`, null where col is null; None where it is false for every value."""
    const = kind_of(value)
    if {kind, const} <= {INTEGER, FLOAT}:
        return _numeric(col, kind, op, value)  # type: ignore[arg-type]
    if kind != const or kind == BOOLEAN and op != "eq" and not ordered_booleans:
        return None
    return _OPS[op](col, F.lit(value))


def _all(col: Column) -> Column:
    return col.isNotNull()


def _numeric(col: Column, kind: str, op: str, value: int | float) -> Column | None:
    up = op in ("gt", "ge")
    if isinstance(value, float) and value.is_integer():
        value = int(value)
    if kind == FLOAT:
        if isinstance(value, int) and abs(value) > 1 << 1023:
            return None if op == "eq" or up == (value > 0) else _all(col)
        near = float(value)
        if near == value:
            return _OPS[op](col, F.lit(near))
        # No double equals the constant: compare with the largest one below.
        below = near if Decimal(near) < value else math.nextafter(near, -math.inf)
        return None if op == "eq" else col > F.lit(below) if up else col <= F.lit(below)
    if isinstance(value, float):  # has a fraction
        if op == "eq":
            return None
        value, op = math.floor(value), "gt" if up else "le"
    if not LONG_MIN <= value <= LONG_MAX:
        return None if op == "eq" or up == (value > 0) else _all(col)
    return _OPS[op](col, F.lit(value).cast("long"))


def among(col: Column, kind: str, values: list[Constant]) -> Column | None:
    """Whether col equals one of the values; None where it never does."""
    same: list[Constant] = []
    for v in values:
        if {kind, kind_of(v)} <= {INTEGER, FLOAT}:
            if isinstance(v, float) and v.is_integer():
                v = int(v)
            if kind == INTEGER and isinstance(v, int) and LONG_MIN <= v <= LONG_MAX:
                same.append(v)
            elif kind == FLOAT and abs(v) < 1 << 1023 and float(v) == v:
                same.append(float(v))
        elif kind == kind_of(v):
            same.append(v)
    if not same:
        return None
    return col.isin([F.lit(v).cast("long") if kind == INTEGER else F.lit(v) for v in same])
