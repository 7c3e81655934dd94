"""JSON documents into rows: parsing, validation against the emergent schema, ids, typed leaves."""

from __future__ import annotations

import itertools
import json
import re
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from doclattice.catalog import Collection
from doclattice.errors import BadRequest
from doclattice.functions.kinds import SQL_TYPE, STRING
from doclattice.functions.text import doc_id
from doclattice.sources.shapes import fold, shape

#: Distinct shapes that are judged at once; the verdicts of so many are broadcast.
MAX_SHAPES = 10_000
BLANK = re.compile(r"[\x20\t\n\r]*")


def json_lines(spark: SparkSession, path: str) -> DataFrame:
    """A file or folder with a JSON document in each line; blank lines are left out."""
    return spark.read.text(path).filter(F.trim("value") != "").select(F.col("value").alias("json"))


def json_values(spark: SparkSession, path: str) -> DataFrame:
    """Files with JSON values one after the other, with or without blanks between, each in the text it
    has there. A file is read whole by one task; what can't be read ends it, as a value of its own that
    no collection takes."""

    def run(batches):
        read = json.JSONDecoder().raw_decode
        for batch in batches:
            for text in batch.column(0).to_pylist():
                out, at = [], 0
                while (at := BLANK.match(text, at).end()) < len(text):
                    try:
                        _, end = read(text, at)
                    except ValueError:
                        end = len(text)
                    out.append(text[at:end])
                    at = end
                for i in range(0, len(out), 10_000):
                    yield pa.RecordBatch.from_arrays([pa.array(out[i : i + 10_000], pa.string())], ["json"])

    return spark.read.text(path, wholetext=True).mapInArrow(run, "json string")


def numbered(docs: DataFrame, order: str | None = None) -> DataFrame:
    """place (a number that keeps the rows' order), json and its parsed value."""
    if "json" not in docs.columns:
        raise BadRequest("documents come in a column named json")
    place = F.col(order).cast("long") if order else F.monotonically_increasing_id()
    return docs.select(place.alias("place"), F.col("json").cast("string").alias("json"))


def parsed(rows: DataFrame) -> DataFrame:
    value = F.try_parse_json("json")
    return rows.withColumn("value", value).withColumn("shape", F.schema_of_variant("value"))


def _leaf(path: str, kind: str) -> Column:
    """The path's value; null where it isn't there, or is an object in this document."""
    where = "$" + "".join(f"['{name}']" for name in path[1:].split("."))
    value = F.try_variant_get("value", where, SQL_TYPE[kind])
    if kind != STRING:
        return value
    return F.when(F.schema_of_variant(F.try_variant_get("value", where, "variant")) == "STRING", value)


@dataclass
class Batch:
    accepted: DataFrame
    rejected: DataFrame
    fields: dict[str, str]
    changes: int


def validated(rows: DataFrame, coll: Collection, version: int, batch: int, scratch: str) -> Batch:
    """Split rows (place, json) into those the collection takes, with ids and leaves, and the others,
    with the reason. Only distinct shapes come to the driver, MAX_SHAPES at a time; where there are
    more, their verdicts are written to the folder `scratch` and joined from there."""
    docs = parsed(rows)
    spark = rows.sparkSession
    ordered = docs.groupBy("shape").agg(F.min("place").alias("first")).orderBy("first")
    fields, starts, found = coll.fields, [], ordered.toLocalIterator()
    schema, wrote, told = "told string, error string", False, None
    while chunk := list(itertools.islice(found, MAX_SHAPES)):
        judged, fields = fold([shape(s["shape"]) for s in chunk], fields)
        starts += [s["first"] for s, v in zip(chunk, judged, strict=True) if v.new]
        part = spark.createDataFrame([(s["shape"], v.error) for s, v in zip(chunk, judged, strict=True)], schema)
        if not wrote and len(chunk) < MAX_SHAPES:
            told = F.broadcast(part)
            break
        part.write.mode("append").parquet(scratch)
        wrote = True
    if told is None:
        told = spark.read.schema(schema).parquet(scratch) if wrote else spark.createDataFrame([], schema)
    joined = docs.join(told, docs["shape"].eqNullSafe(told["told"])).drop("told")
    rejected = joined.filter("error is not null").select("place", "json", F.col("error").alias("reason"))
    grown = F.size(F.filter(F.array([F.lit(x).cast("long") for x in starts]), lambda x: x <= F.col("place"))) if starts else F.lit(0)
    own = F.lit(version) + grown
    leaves = [_leaf(p, k).alias(f"f{i}") for i, (p, k) in enumerate(fields.items())]
    accepted = joined.filter("error is null").select(doc_id(own, F.lit(batch), F.col("place")).alias("__id"), F.lit(batch).alias("__batch"), F.col("place").alias("__place"), F.col("json").alias("document"), *leaves)
    return Batch(accepted, rejected, fields, len(starts))
