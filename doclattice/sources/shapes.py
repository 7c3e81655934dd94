"""Shapes of documents, and the emergent schema that they add up to.

A document's shape is the list of its leaf paths with their kinds. The first accepted document with
a path fixes its kind. Shapes are judged in the order of their first documents: a rejected shape
adds nothing and stays rejected, an accepted one stays accepted, so judging distinct shapes gives
what judging document by document would.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from doclattice.functions.kinds import BOOLEAN, FLOAT, INTEGER, STRING

NAME = re.compile("[a-zA-Z][-_0-9a-zA-Z]*")
_TOKEN = re.compile(r"`(?:[^`]|``)*`|[\w$]+|[<>(),:]|\s+|.")
SCALARS = {"BIGINT": INTEGER, "STRING": STRING, "BOOLEAN": BOOLEAN, "DOUBLE": FLOAT, "FLOAT": FLOAT}


@dataclass(frozen=True)
class Shape:
    """Leaf paths with kinds, in the order of names; or why no document of this shape is taken."""

    leaves: tuple[tuple[str, str], ...] = ()
    error: str | None = None


class _Reader:
    """Reads the type text that describes a variant value."""

    def __init__(self, text: str):
        self.tokens = [t for t in _TOKEN.findall(text) if not t.isspace()]
        self.at = 0
        self.leaves: list[tuple[str, str]] = []
        self.error: str | None = None

    def take(self) -> str:
        self.at += 1
        return self.tokens[self.at - 1]

    def skip(self, sign: str) -> bool:
        if self.at < len(self.tokens) and self.tokens[self.at] == sign:
            self.at += 1
            return True
        return False

    def fail(self, why: str) -> None:
        self.error = self.error or why

    def value(self, path: str) -> None:
        kind = self.take()
        if kind == "OBJECT":
            self.take()
            while not self.skip(">"):
                self.skip(",")
                name = self.take()
                if name.startswith("`"):
                    name = name[1:-1].replace("``", "`")
                self.take()
                if not NAME.fullmatch(name):
                    self.fail(f"field name {name!r} is not allowed")
                self.value(f"{path}.{name}")
        elif kind == "ARRAY":
            self.fail(f"field {path} is an array")
            self.nested()
        elif kind == "DECIMAL":
            self.take()
            precision, _, scale = int(self.take()), self.take(), int(self.take())
            self.take()
            if scale == 0 and 19 <= precision <= 20:
                self.fail(f"field {path} is an integer beyond 64 bits with sign")
            self.leaves.append((path, FLOAT))
        elif kind in SCALARS:
            self.leaves.append((path, SCALARS[kind]))
        else:
            self.fail(f"field {path} is null" if kind == "VOID" else f"field {path} is of type {kind.lower()}")

    def nested(self) -> None:
        depth = 0
        while True:
            token = self.take()
            depth += (token == "<") - (token == ">")
            if not depth:
                return


def shape(text: str | None) -> Shape:
    """The shape for what schema_of_variant says of a document; None for what isn't JSON."""
    if text is None:
        return Shape(error="not a JSON value with distinct names")
    if not text.startswith("OBJECT"):
        return Shape(error="a document is an object")
    r = _Reader(text)
    r.value("")
    return Shape(tuple(r.leaves), r.error)


def conflict(leaves: tuple[tuple[str, str], ...], fields: dict[str, str]) -> str | None:
    for path, kind in leaves:
        if fields.get(path, kind) != kind:
            return f"field {path} holds {fields[path]} values, not {kind}"
    return None


@dataclass
class Verdict:
    error: str | None
    #: Changes of the schema up to and with this shape's first document.
    changes: int = 0
    new: tuple[tuple[str, str], ...] = ()


def fold(ordered: list[Shape], fields: dict[str, str]) -> tuple[list[Verdict], dict[str, str]]:
    """A verdict for each shape, and the fields after all of them."""
    fields, out, changes = dict(fields), [], 0
    for s in ordered:
        error = s.error or conflict(s.leaves, fields)
        new = () if error else tuple((p, k) for p, k in s.leaves if p not in fields)
        fields.update(new)
        changes += bool(new)
        out.append(Verdict(error, changes, new))
    return out, fields
