"""Continuous insertion from a stream of JSON documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming.query import StreamingQuery

from doclattice.engine import Engine


def insert_stream(engine: Engine, db: str, name: str, docs: DataFrame, checkpoint: str, rejected: str | None = None) -> StreamingQuery:
    """Insert each micro-batch of docs (a column json) in turn, until there is no more; documents
    that are rejected are written to the folder `rejected`, if one is given, one folder for each
    micro-batch (`batch=<number>`). The catalog keeps the number of the last micro-batch under the
    checkpoint's name, so that one that is repeated after a failure isn't inserted twice."""

    def add(batch: DataFrame, number: int) -> None:
        out = engine.insert(db, name, batch, stream=(checkpoint, number))
        if rejected:
            out.rejected.write.mode("overwrite").parquet(f"{rejected}/batch={number}")

    return docs.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
