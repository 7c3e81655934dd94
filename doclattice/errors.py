"""Errors of the engine."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from py4j.protocol import Py4JJavaError


class EngineError(RuntimeError):
    """Anything that isn't the request's fault."""


class BadRequest(ValueError):
    """A request that can't be served: unknown names, wrong numbers of operands, wrong shapes."""


class QueryParseError(BadRequest):
    """Plan text that can't be read; `at` is the offset."""

    def __init__(self, message: str, at: int):
        super().__init__(f"{message} (at {at})")
        self.at = at


class DocIdError(BadRequest):
    """Text that isn't a document id."""


class ValidationError(ValueError):
    """A document that its collection can't take."""


class SchemaConflict(RuntimeError):
    """The catalog changed between reading and writing it."""


@contextmanager
def failures() -> Iterator[None]:
    """What goes wrong in the file system comes as an EngineError."""
    try:
        yield
    except Py4JJavaError as e:
        raise EngineError(str(e.java_exception)) from e
