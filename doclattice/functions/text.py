"""Functions on text: UTF-8 prefixes by bytes, and document ids."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from doclattice.errors import DocIdError


def byte_prefix(col: Column, n: int) -> Column:
    """At most n bytes of the UTF-8 form, cut at a character's end."""
    if n <= 0:
        return F.when(col.isNotNull(), F.lit(""))
    raw = col.cast("binary")
    cuts = [F.try_validate_utf8(F.substring(raw, 1, k).cast("string")) for k in range(n, max(-1, n - 4), -1)]
    return F.coalesce(*cuts)


def prefix_of(value: str, n: int) -> str:
    return value.encode()[: max(n, 0)].decode(errors="ignore")


def doc_id(version: Column, batch: Column, place: Column) -> Column:
    """Eight hex digits of the schema version, lowest byte first, then 24 of batch and place."""
    h = F.lpad(F.lower(F.hex(version.cast("long"))), 8, "0")
    little = F.concat(*[F.substring(h, k, 2) for k in (7, 5, 3, 1)])
    wide = lambda c, n: F.lpad(F.lower(F.hex(c.cast("long"))), n, "0")
    return F.concat(little, wide(batch, 8), wide(place, 16))


def parse_doc_id(text: str) -> tuple[int, int]:
    """(schema version, stamp)."""
    if not re.fullmatch(r"[0-9a-fA-F]{32}", text):
        raise DocIdError(f"not a document id: {text!r}")
    return int.from_bytes(bytes.fromhex(text[:8]), "little"), int(text[8:], 16)
