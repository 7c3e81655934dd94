"""Predicates as Column expressions.

Logic has two values: an atom on a missing field is false, so its negation is true. Negation is
pushed down to the atoms when the expression is made (an atom's negation also takes nulls), so that
the result is plain comparisons that data sources can evaluate.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from doclattice.functions.kinds import among, compare
from doclattice.plans.nodes import Always, Among, Compare, Every, Not, Predicate

#: A path's column and kind; None for a path that no document has as a value.
Resolve = Callable[[str], tuple[Column, str] | None]


def condition(p: Predicate, resolve: Resolve, holds: bool = True) -> Column:
    """True where p is as `holds` says; false or null elsewhere."""
    if isinstance(p, Always):
        return F.lit(holds)
    if isinstance(p, Not):
        return condition(p.of, resolve, not holds)
    if isinstance(p, (Compare, Among)):
        field = resolve(p.path)
        test = None
        if field:
            test = compare(*field, p.op, p.value) if isinstance(p, Compare) else among(*field, list(p.values))
        if test is None:
            return F.lit(not holds)
        return test if holds else ~test | field[0].isNull()  # type: ignore[index]
    parts = [condition(x, resolve, holds) for x in p.of]
    return reduce(Column.__and__ if isinstance(p, Every) == holds else Column.__or__, parts)
