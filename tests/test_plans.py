"""Reading plans: syntax, arity, constants."""

import pytest

from doclattice.errors import BadRequest, DocIdError, QueryParseError
from doclattice.functions.text import parse_doc_id, prefix_of
from doclattice.plans.nodes import Always, Among, Bound, Compare, Every, Filter, IndexScan, Not, Scan, Union, parse_plan, parse_predicate


def test_reads_all_forms():
    text = """; a comment
    (filter (union (scan ()) (ixscan (right-interval ix (1 "a") (2.5f32 "b")))) ; more
      (and (eq .a.b 1.0) (not (in .c "x" true -1e3))))"""
    assert parse_plan(text) == Filter(
        Union((Scan(Always()), IndexScan("ix", (Bound("ge", (1, "a")), Bound("lt", (2.5, "b")))))),
        Every((Compare("eq", ".a.b", 1), Not(Among(".c", ("x", True, -1000))))),
    )


@pytest.mark.parametrize("op", ["eq", "gt", "ge", "lt", "le"])
def test_comparison_arity(op):
    assert parse_predicate(f'({op} .f "v")') == Compare(op, ".f", "v")
    for bad in (f"({op} .f)", f"({op} .f 1 2)", f"({op} f 1)", f"({op} 1 .f)", f"({op} .f .g)", f"({op} .f 137u32)"):
        with pytest.raises(BadRequest):
            parse_predicate(bad)


@pytest.mark.parametrize("bad", ["(and ())", "(or)", "(not)", "(not () ())", "(in .f)", "(ne .f 1)", "(1 2)", "symbol", "7"])
def test_bad_predicates(bad):
    with pytest.raises(BadRequest):
        parse_predicate(bad)


@pytest.mark.parametrize("bad", ["()", "(scan)", "(scan () ())", "(ixscan ())", "(ixscan (eq))", "(ixscan (eq ix))", "(ixscan (eq ix 1))", "(ixscan (interval ix (1)))", "(ixscan (near ix (1)))", '(ixscan (eq "ix" (1)))', "(ixscan (eq ix (9999999999u32)))", "(union (scan ()))", "(filter (scan ()))", "(join (scan ()) (scan ()))"])
def test_bad_plans(bad):
    with pytest.raises(BadRequest):
        parse_plan(bad)


@pytest.mark.parametrize("bad", ["", "; nothing", "(scan ()", "(scan ()))", "(scan ()) (scan ())", '(scan (eq .f "open', '(scan (eq .f "\\q"))'])
def test_syntax_errors_have_a_place(bad):
    with pytest.raises(QueryParseError) as e:
        parse_plan(bad)
    assert isinstance(e.value.at, int)


def test_doc_id():
    assert parse_doc_id("04000000000000003280028900000000")[0] == 4
    for bad in ("", "04", "g" * 32, "é" * 32):
        with pytest.raises(DocIdError):
            parse_doc_id(bad)


def test_prefix():
    assert [prefix_of("héllo", n) for n in range(5)] == ["", "h", "h", "hé", "hél"]
