"""The engine: collections of documents, indexes and queries over one Spark session."""

from __future__ import annotations

import json
import tempfile
import time
import uuid
from dataclasses import dataclass
from functools import reduce
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from doclattice.catalog import Catalog, Collection, Index, Store
from doclattice.errors import BadRequest, EngineError, SchemaConflict, ValidationError, failures
from doclattice.functions.kinds import SQL_TYPE, STRING, kind_of_type
from doclattice.functions.text import byte_prefix, parse_doc_id
from doclattice.operators.legacy import legacy_condition
from doclattice.plans.compiler import branches, compiled
from doclattice.plans.nodes import Filter, IndexScan, Plan, parse_plan
from doclattice.sources.ingest import numbered, validated

#: Batches of a collection that a step of an index's building takes.
BACKFILL = 1000


@dataclass
class Inserted:
    #: __id and place of the accepted documents; place, json and reason of the others.
    ids: DataFrame
    rejected: DataFrame


@dataclass
class _Attached:
    docs: DataFrame
    columns: dict[str, Column]
    id_column: str | None
    coll: Collection


def _leaves(schema: T.StructType, above: str = "", column: str = "") -> dict[str, tuple[str, str]]:
    """Leaf paths of a row type, each with its column name and kind."""
    out = {}
    for f in schema.fields:
        path, name = f"{above}.{f.name}", f"{column}.`{f.name}`".lstrip(".")
        if isinstance(f.dataType, T.StructType):
            out |= _leaves(f.dataType, path, name)
        elif kind := kind_of_type(f.dataType):
            out[path] = (name, kind)
    return out


class Engine:
    """root: a folder for collections that documents are inserted into. If none is given, it is a new
    one in the cluster's shared folder (spark.checkpoint.dir); in local mode, where that is unset, one
    of this machine."""

    def __init__(self, spark: SparkSession, root: str | None = None):
        self.spark = spark
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not (root or shared):
            master = spark.sparkContext.master
            if master != "local" and not master.startswith("local["):
                raise EngineError("on a cluster a root is needed, or a shared folder in spark.checkpoint.dir")
            shared = Path(tempfile.gettempdir()).as_uri()
        self.root = (root or f"{shared.rstrip('/')}/doclattice-{uuid.uuid4().hex}").rstrip("/")
        self.store = Store(spark, self.root)
        self.attached: dict[str, _Attached] = {}

    @property
    def catalog(self) -> Catalog:
        return self.store.load()

    # -- definitions ---------------------------------------------------------------------------

    def create_collection(self, db: str, name: str) -> None:
        catalog = self.catalog
        if f"{db}.{name}" in catalog.collections or f"{db}.{name}" in self.attached:
            raise BadRequest(f"collection {db}.{name} already exists")
        catalog.collections[f"{db}.{name}"] = Collection()
        self._save(catalog, 1)

    def attach(self, db: str, name: str, docs: DataFrame, id_column: str | None = None) -> None:
        """Make a DataFrame a collection that can be read. Its leaf columns are the fields; columns
        of types without a kind pass through. id_column: what __id is made from (schema version 0)."""
        leaves = _leaves(docs.schema)
        coll = Collection({p: k for p, (_, k) in leaves.items()})
        self.attached[f"{db}.{name}"] = _Attached(docs, {p: F.col(c) for p, (c, _) in leaves.items()}, id_column, coll)

    def create_index(self, db: str, name: str, index: str, fields: list, build: bool = True) -> None:
        """fields: paths, or (path, prefix length in bytes)."""
        pairs = [(f, None) if isinstance(f, str) else tuple(f) for f in fields]
        if not pairs or not all(p.startswith(".") for p, _ in pairs):
            raise BadRequest("an index has at least one field, and fields begin with a dot")
        if (own := self.attached.get(f"{db}.{name}")) is not None:
            if index in own.coll.indexes:
                raise BadRequest(f"index {index} already exists")
            own.coll.indexes[index] = Index(pairs, ready=build)
            return
        catalog = self.catalog
        coll = catalog.collection(db, name)
        if index in coll.indexes:
            raise BadRequest(f"index {index} already exists")
        coll.indexes[index] = Index(pairs)
        self._save(catalog, 1)
        if build:
            self.refresh_index(db, name, index)

    def refresh_index(self, db: str, name: str, index: str) -> None:
        """Bring the index's table up to date and make the index ready. Batches are taken BACKFILL at a
        time, and the catalog tells after each step how far the table is: batches that it has are not
        read again, also after a failure. A field that is unknown so far is missing everywhere."""
        if (own := self.attached.get(f"{db}.{name}")) is not None:
            own.coll.indexes[index].ready = True
            return
        while True:
            catalog = self.catalog
            coll = catalog.collection(db, name)
            if index not in coll.indexes:
                raise BadRequest(f"no index {index}")
            entry = coll.indexes[index]
            upto = min(coll.batches, entry.batches + BACKFILL)
            if entry.batches < upto and all(p in coll.fields for p in entry.paths):
                docs = self._stored(db, name, coll, entry.batches, upto)
                rows = self._entries(docs, entry, lambda p: (F.col(coll.column(p)), coll.fields[p]))
                keys = [f"k{i}" for i in range(len(entry.fields))]
                folder = f"{self._index_path(db, name, index)}/{uuid.uuid4().hex}"
                rows.repartitionByRange(*keys).sortWithinPartitions(*keys, "__id").write.parquet(folder)
                entry.folders.append(folder)
            entry.batches = upto
            entry.ready = entry.ready or upto == coll.batches
            entry.locked = time.time() if upto < coll.batches else 0.0
            self._save(catalog, 1)
            if upto == coll.batches:
                return

    def build_pending(self, timeout: float = 10.0) -> list[tuple[str, str, str]]:
        """Build the indexes that aren't ready and that no other worker has taken within `timeout`
        seconds; those that were built are returned. A worker takes an index by its mark in the
        catalog, which only one of several gets saved."""
        built = []
        for full, coll in self.catalog.collections.items():
            db, name = full.split(".", 1)
            for index, entry in coll.indexes.items():
                if entry.ready or time.time() - entry.locked < timeout:
                    continue
                try:
                    catalog = self.catalog
                    mine = catalog.collections[full].indexes[index]
                    if mine.ready or time.time() - mine.locked < timeout:
                        continue
                    mine.locked = time.time()
                    self._save(catalog, 1)
                    self.refresh_index(db, name, index)
                except SchemaConflict:
                    continue  # another writer was first; the index's turn comes again
                built.append((db, name, index))
        return built

    # -- writing -------------------------------------------------------------------------------

    def insert(self, db: str, name: str, docs: DataFrame | list, order: str | None = None, strict: bool = False, stream: tuple[str, int] | None = None) -> Inserted:
        """Add documents: a DataFrame with a column json, or a list of JSON texts or values. They are
        judged in the order of `order`, a column of distinct numbers (else in that of the rows).
        strict: raise ValidationError if any is rejected, and add none.
        stream: a name and the number of a micro-batch; one that is in the catalog isn't added again,
        and what it gave is returned.
        The documents are there once the catalog that lists their folder is saved; a writer that comes
        second gets SchemaConflict, and its folder is removed."""
        catalog = self.catalog
        coll = catalog.collection(db, name)
        if stream and stream[0] in coll.streams and coll.streams[stream[0]][0] >= stream[1]:
            number, folder = coll.streams[stream[0]]
            inserted = self._inserted(folder)
            return inserted if number == stream[1] else Inserted(inserted.ids.limit(0), inserted.rejected.limit(0))
        if isinstance(docs, list):
            texts = [(i, d if isinstance(d, str) else json.dumps(d)) for i, d in enumerate(docs)]
            docs, order = self.spark.createDataFrame(texts, "place long, json string"), "place"
        staged = f"{self.root}/staged/{uuid.uuid4().hex}"  # numbers given once, whatever is read again
        folder = f"{self._path(db, name)}/{uuid.uuid4().hex}"
        saved = False
        try:
            numbered(docs, order).write.parquet(staged)
            rows = self.spark.read.parquet(staged)
            batch = validated(rows, coll, catalog.version, coll.batches, f"{staged}-shapes")
            if strict and (bad := batch.rejected.orderBy("place").first()):
                raise ValidationError(bad["reason"])
            batch.accepted.write.parquet(f"{folder}/accepted")
            batch.rejected.write.parquet(f"{folder}/rejected")
            coll.fields = batch.fields
            coll.folders.append(folder)
            if stream:
                coll.streams[stream[0]] = (stream[1], folder)
            self._save(catalog, batch.changes + (batch.changes == 0))
            saved = True
        finally:
            self._remove(staged)
            self._remove(f"{staged}-shapes")
            if not saved:
                self._remove(folder)
        for index, entry in coll.indexes.items():
            if entry.ready:
                self.refresh_index(db, name, index)
        return self._inserted(folder)

    def _inserted(self, folder: str) -> Inserted:
        read = self.spark.read
        return Inserted(read.parquet(f"{folder}/accepted").select("__id", F.col("__place").alias("place")), read.parquet(f"{folder}/rejected"))

    def compact(self, db: str, name: str) -> None:
        """Put the documents of many small batches into one folder; plans list fewer files then. The
        older folders stay for readers that have begun; remove them when those are done."""
        catalog = self.catalog
        coll = catalog.collection(db, name)
        if coll.batches < 2:
            return
        folder = f"{self._path(db, name)}/{uuid.uuid4().hex}"
        self._stored(db, name, coll).write.parquet(f"{folder}/accepted")
        # Batch numbers stay in the rows; later batches go on from them.
        coll.folders = [folder] * coll.batches
        self._save(catalog, 1)

    def update(self, *_args, **_kwargs) -> None:
        raise NotImplementedError("documents can't be changed")

    # -- reading -------------------------------------------------------------------------------

    def query(self, db: str, name: str, plan: str | None = None, limit: int | None = None, query: str | None = None, ordered: bool = True, tables: bool = False, as_json: bool = False, legacy: bool = False) -> DataFrame:
        """The documents of a plan. limit: at most so many, the first in the plan's order (insertion
        or index keys; a union's branches in turn) unless ordered is false. tables: index scans read
        the index's own table. as_json: __id and the document as JSON text, for attached collections
        too. query: a bare predicate; it is only supported in the older dialect, with legacy=True."""
        if query is not None and not legacy:
            raise NotImplementedError("a query without a plan is not supported")
        if (plan is None) == (query is None):
            raise BadRequest("either a plan or a query is needed")
        docs, coll, resolve, names = self._source(db, name)
        if query is not None:
            known = lambda p: (F.col("__id"), STRING) if p == ".__id" and "__id" in docs.columns else resolve(p)
            docs, plan = docs.filter(legacy_condition(query, known)), "(scan ())"
        parsed = parse_plan(plan)
        table = lambda index: self._index_table(db, name, index) if tables else None
        if limit is None:
            out = compiled(parsed, docs, coll, resolve, table)
        elif limit < 0:
            raise BadRequest("a limit is not negative")
        elif not ordered:
            out = compiled(parsed, docs, coll, resolve, table).limit(limit)
        else:
            out = self._first(parsed, limit, docs, coll, resolve, table)
        if as_json:
            ids = ["__id"] if "__id" in docs.columns else []
            own = F.col("document") if "document" in names else F.to_json(F.struct(*[f"`{n}`" for n in names if n != "__id"]))
            return out.select(*ids, own.alias("document"))
        return out.select(*names)

    def _first(self, plan: Plan, limit: int, docs: DataFrame, coll: Collection, resolve, table) -> DataFrame:
        """The first documents of a plan: those of its branches in turn, each in insertion or key order."""
        parts = []
        for k, branch in enumerate(branches(plan)):
            leaf = branch
            while isinstance(leaf, Filter):
                leaf = leaf.of
            out = compiled(branch, docs, coll, resolve, table)
            keys = [resolve(p)[0] for p in coll.indexes[leaf.index].paths if resolve(p)] if isinstance(leaf, IndexScan) else []
            keys += [F.col(c) for c in ("__batch", "__place") if c in docs.columns] or [F.col("__id")] * ("__id" in docs.columns)
            out = (out.orderBy(*keys) if keys else out).limit(limit)
            parts.append((k, out))
        if len(parts) == 1:
            return parts[0][1]
        turn = lambda k, df: df.withColumn("__turn", F.lit(k)).withColumn("__nth", F.monotonically_increasing_id())
        return reduce(DataFrame.unionByName, [turn(k, df) for k, df in parts]).orderBy("__turn", "__nth").limit(limit)

    def get(self, db: str, name: str, doc_id: str) -> DataFrame:
        """The document of that id, in no rows or one; an unknown collection has none."""
        parse_doc_id(doc_id)
        if f"{db}.{name}" not in self.attached and f"{db}.{name}" not in self.catalog.collections:
            return self.spark.createDataFrame([], "__id string, document string")
        docs, _, _, names = self._source(db, name)
        if "__id" not in docs.columns:
            raise BadRequest(f"the documents of {db}.{name} have no ids")
        return docs.filter(F.col("__id") == doc_id.lower()).select(*names)

    def fields(self, db: str, name: str) -> DataFrame:
        """path and kind of each known field."""
        own = self.attached.get(f"{db}.{name}")
        coll = own.coll if own else self.catalog.collection(db, name)
        return self.spark.createDataFrame(list(coll.fields.items()), "path string, kind string")

    def index_entries(self, db: str, name: str, index: str) -> DataFrame:
        """Keys k0, k1, ... (strings cut to their prefix) and __id of the documents with all fields."""
        docs, coll, resolve, _ = self._source(db, name)
        if index not in coll.indexes:
            raise BadRequest(f"no index {index}")
        return self._entries(docs, coll.indexes[index], resolve)

    # -- inside --------------------------------------------------------------------------------

    def _save(self, catalog: Catalog, by: int) -> None:
        expected = catalog.version
        catalog.version += by
        self.store.save(catalog, expected)

    def _path(self, db: str, name: str) -> str:
        return f"{self.root}/collections/{db}/{name}"

    def _index_path(self, db: str, name: str, index: str) -> str:
        return f"{self.root}/indexes/{db}/{name}/{index}"

    def _index_table(self, db: str, name: str, index: str) -> DataFrame | None:
        if f"{db}.{name}" in self.attached:
            return None
        folders = self.catalog.collection(db, name).indexes[index].folders
        return self.spark.read.parquet(*folders) if folders else None

    def _remove(self, path: str) -> None:
        where = self.store.jvm.org.apache.hadoop.fs.Path(path)
        with failures():
            self.store.fs.delete(where, True)

    def _stored(self, db: str, name: str, coll: Collection, begin: int = 0, end: int | None = None) -> DataFrame:
        """Batches (all, or from begin to before end), with a column for each known field; older
        batches lack later ones."""
        leaves = [f"f{i} {SQL_TYPE[k]}" for i, k in enumerate(coll.fields.values())]
        schema = ", ".join(["__id string", "__batch int", "__place long", "document string", *leaves])
        if not coll.batches:
            return self.spark.createDataFrame([], schema)
        docs = self.spark.read.schema(schema).parquet(*[f"{f}/accepted" for f in dict.fromkeys(coll.folders[begin:end])])
        return docs if end is None else docs.filter(F.col("__batch").between(begin, end - 1))

    def _source(self, db: str, name: str):
        """Documents, their collection, how paths resolve, and the columns that queries return."""
        if (own := self.attached.get(f"{db}.{name}")) is not None:
            docs = own.docs
            if own.id_column:
                docs = docs.withColumn("__id", F.concat(F.lit("0" * 8), F.lpad(F.lower(F.hex(F.col(own.id_column).cast("long"))), 24, "0")))
            return docs, own.coll, lambda p: (own.columns[p], own.coll.fields[p]) if p in own.columns else None, docs.columns
        coll = self.catalog.collection(db, name)
        resolve = lambda p: (F.col(coll.column(p)), coll.fields[p]) if p in coll.fields else None
        return self._stored(db, name, coll), coll, resolve, ["__id", "document"]

    def _entries(self, docs: DataFrame, index: Index, resolve) -> DataFrame:
        found = [resolve(p) for p in index.paths]
        if None in found:
            return docs.filter(F.lit(False)).select(*[F.lit(None).cast("string").alias(f"k{i}") for i in range(len(found))])
        keys = [byte_prefix(c, n) if n is not None and k == STRING else c for (c, k), (_, n) in zip(found, index.fields, strict=True)]
        ids = [F.col("__id")] if "__id" in docs.columns else []
        for c, _ in found:
            docs = docs.filter(c.isNotNull())
        return docs.select(*[c.alias(f"k{i}") for i, c in enumerate(keys)], *ids)
