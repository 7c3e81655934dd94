"""Spark-native document query engine."""

from doclattice.engine import Engine
from doclattice.errors import BadRequest, DocIdError, EngineError, QueryParseError, SchemaConflict, ValidationError

__all__ = ["BadRequest", "DocIdError", "Engine", "EngineError", "QueryParseError", "SchemaConflict", "ValidationError"]
