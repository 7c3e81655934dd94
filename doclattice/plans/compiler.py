"""Plans as DataFrames."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from doclattice.catalog import Collection
from doclattice.errors import BadRequest
from doclattice.functions.kinds import STRING
from doclattice.functions.text import prefix_of
from doclattice.operators.predicates import Resolve, condition
from doclattice.operators.ranges import within
from doclattice.plans.nodes import Bound, Filter, IndexScan, Plan, Scan, Union


def _fields(scan: IndexScan, coll: Collection, resolve: Resolve) -> list[tuple[Column, str]] | None:
    """The index's columns and kinds; None if no document has all of its fields."""
    if (index := coll.indexes.get(scan.index)) is None:
        raise BadRequest(f"no index {scan.index}")
    if not index.ready:
        raise BadRequest(f"index {scan.index} is not ready")
    for b in scan.bounds:
        if len(b.values) != len(index.fields):
            raise BadRequest(f"index {scan.index} has {len(index.fields)} fields, not {len(b.values)}")
    found = [resolve(p) for p in index.paths]
    return None if None in found else found  # type: ignore[return-value]


def _loose(b: Bound, index_fields: list[tuple[str, int | None]]) -> Bound:
    """A bound on truncated keys that lets through whatever the bound on whole values does."""
    values = tuple(prefix_of(v, n) if n is not None and isinstance(v, str) else v for v, (_, n) in zip(b.values, index_fields, strict=True))
    cut = any(n is not None for _, n in index_fields)
    return Bound({"gt": "ge", "lt": "le"}.get(b.op, b.op) if cut else b.op, values)


def _by_table(docs: DataFrame, scan: IndexScan, coll: Collection, table: DataFrame, fields: list[tuple[Column, str]]) -> DataFrame:
    """Look keys up in the index's table, fetch the documents, and test whole values again."""
    index = coll.indexes[scan.index]
    keys = [(table[f"k{i}"], k) for i, (_, k) in enumerate(fields)]
    cut = next((i for i, ((_, n), (_, k)) in enumerate(zip(index.fields, fields, strict=True)) if n is not None and k == STRING), None)
    if cut is None:
        test = within(keys, scan.bounds)
    else:  # what follows a truncated field is not in order
        head = tuple(_loose(Bound(b.op, b.values[: cut + 1]), index.fields[: cut + 1]) for b in scan.bounds)
        head = tuple(Bound("eq" if b.op == "eq" else b.op[0] + "e", b.values) for b in head)
        test = within(keys[: cut + 1], head)
    ids = table.filter(test).select("__id")
    return docs.join(ids, "__id", "left_semi").filter(within(fields, scan.bounds))


def compiled(plan: Plan, docs: DataFrame, coll: Collection, resolve: Resolve, table: Callable[[str], DataFrame | None]) -> DataFrame:
    """table: the index's own table, if it is to be used; else an index scan is a filter on docs,
    which reads less than a lookup wherever files have statistics."""
    if isinstance(plan, Scan):
        return docs.filter(condition(plan.where, resolve))
    if isinstance(plan, Filter):
        return compiled(plan.of, docs, coll, resolve, table).filter(condition(plan.where, resolve))
    if isinstance(plan, IndexScan):
        fields = _fields(plan, coll, resolve)
        if fields is None:
            return docs.filter(F.lit(False))
        own = table(plan.index)
        return docs.filter(within(fields, plan.bounds)) if own is None else _by_table(docs, plan, coll, own, fields)
    return reduce(DataFrame.union, [compiled(p, docs, coll, resolve, table) for p in plan.of])


def branches(plan: Plan) -> list[Plan]:
    """The plan's leaves in turn, each with the filters above it; all together are the plan."""
    if isinstance(plan, Filter):
        return [Filter(p, plan.where) for p in branches(plan.of)]
    if isinstance(plan, Union):
        return [b for p in plan.of for b in branches(p)]
    return [plan]
