"""Ranges over tuples of index fields, in lexicographic order.

A bound is written out as comparisons of single fields, with the bound that it implies for the
first field in front; data sources push these, which they don't with comparisons of structs.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from doclattice.functions.kinds import compare
from doclattice.plans.nodes import Bound


def _test(field: tuple[Column, str], op: str, value) -> Column:
    out = compare(*field, op, value, ordered_booleans=True)
    return F.lit(False) if out is None else out


def _comparable(field: tuple[Column, str], value) -> bool:
    """Whether the constant has a place among the field's values at all."""
    return any(compare(*field, op, value, ordered_booleans=True) is not None for op in ("eq", "lt", "gt"))


def bound(fields: list[tuple[Column, str]], b: Bound) -> Column:
    if not all(map(_comparable, fields, b.values)):
        return F.lit(False)
    if b.op == "eq":
        return reduce(Column.__and__, [_test(f, "eq", v) for f, v in zip(fields, b.values, strict=True)])
    strict, loose = b.op[0] + "t", b.op[0] + "e"
    out = _test(fields[-1], b.op, b.values[-1])
    for f, v in reversed(list(zip(fields[:-1], b.values[:-1], strict=True))):
        out = _test(f, strict, v) | (_test(f, "eq", v) & out)
    return out if len(fields) == 1 else _test(fields[0], loose, b.values[0]) & out


def within(fields: list[tuple[Column, str]], bounds: tuple[Bound, ...]) -> Column:
    """All fields are there and the tuple is within the bounds."""
    present = [c.isNotNull() for c, _ in fields]
    return reduce(Column.__and__, present + [bound(fields, b) for b in bounds])
