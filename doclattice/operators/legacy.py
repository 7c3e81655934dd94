"""The older predicate dialect, for queries that ask for it.

It differs from the one of plans: both sides of a comparison may be fields or constants, `ne` and
`in` with a list in parentheses are known, `.__id` is a field, all numbers are doubles, booleans are
ordered (false before true), and a bare atom is a predicate. A missing field equals nothing and is in
no order to anything; values of different kinds neither.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from doclattice.errors import BadRequest
from doclattice.functions.kinds import FLOAT, INTEGER, kind_of
from doclattice.operators.predicates import Resolve
from doclattice.plans.sexpr import Atom, List, Node, Symbol, read

_ORDER = {"ge": lambda a, b: a >= b, "gt": lambda a, b: a > b, "le": lambda a, b: a <= b, "lt": lambda a, b: a < b}
_FALSE = ("false", "nil", "#f")


def referred_fields(source: str) -> set[str]:
    """The fields that a predicate reads."""
    todo, found = [read(source)], set()
    while todo:
        node = todo.pop()
        if isinstance(node, List):
            todo.extend(node.items)
        elif isinstance(node, Symbol) and node.name.startswith("."):
            found.add(node.name)
    return found


def _operand(node: Node, resolve: Resolve) -> tuple[Column, str] | None:
    """A value and its kind; None for what has no value."""
    if isinstance(node, List):
        raise BadRequest(f"a comparison is between fields and constants (at {node.at})")
    if isinstance(node, Symbol):
        if (field := resolve(node.name)) is None:
            return None
        value, kind = field
    else:
        value, kind = F.lit(node.value), kind_of(node.value)
    return (value.cast("double"), FLOAT) if kind in (INTEGER, FLOAT) else (value, kind)


def _compare(left: Node, right: Node, resolve: Resolve, test) -> Column:
    a, b = _operand(left, resolve), _operand(right, resolve)
    if a is None or b is None or a[1] != b[1]:
        return F.lit(False)
    return F.coalesce(test(a[0], b[0]), F.lit(False))


def _equal(left: Node, right: Node, resolve: Resolve) -> Column:
    return _compare(left, right, resolve, lambda a, b: a == b)


def _truth(node: Node, resolve: Resolve) -> Column:
    if isinstance(node, Atom):
        return F.lit(node.value if isinstance(node.value, bool) else True)
    if isinstance(node, Symbol):
        return F.lit(node.name not in _FALSE)
    if not node.items:
        return F.lit(True)
    head, args = node.items[0], node.items[1:]
    op = head.name if isinstance(head, Symbol) else None
    least = {"eq": 2, "ne": 2, "in": 2, "and": 2, "or": 2, "not": 1} | dict.fromkeys(_ORDER, 2)
    if op not in least:
        raise BadRequest(f"unknown predicate (at {node.at})")
    if len(args) < least[op] or op == "in" and len(args) != 2:
        raise BadRequest(f"{op} has a wrong number of operands (at {node.at})")
    if op in ("and", "or"):
        return reduce(Column.__and__ if op == "and" else Column.__or__, [_truth(x, resolve) for x in args])
    if op == "not":
        return ~_truth(args[0], resolve)
    if op == "in":
        items = args[1].items if isinstance(args[1], List) else ()
        return reduce(Column.__or__, [_equal(args[0], x, resolve) for x in items], F.lit(False))
    if op in ("eq", "ne"):
        same = _equal(args[0], args[1], resolve)
        return same if op == "eq" else ~same
    return _compare(args[0], args[1], resolve, _ORDER[op])


def legacy_condition(source: str, resolve: Resolve) -> Column:
    """True or false for each document."""
    return _truth(read(source), resolve)
