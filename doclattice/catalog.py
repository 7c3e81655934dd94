"""What the engine knows of databases, collections, fields and indexes; JSON files beside the data."""

from __future__ import annotations

import json
import uuid
from dataclasses import asdict, dataclass, field

from pyspark.sql import SparkSession

from doclattice.errors import BadRequest, SchemaConflict, failures


@dataclass
class Index:
    fields: list[tuple[str, int | None]]
    ready: bool = False
    #: Batches of the collection that the index table has.
    batches: int = 0
    #: When a worker last took the index's building on (seconds), 0 if none is at it.
    locked: float = 0.0
    #: Folders of the index table, in the order in which they were added.
    folders: list[str] = field(default_factory=list)

    @property
    def paths(self) -> list[str]:
        return [p for p, _ in self.fields]


@dataclass
class Collection:
    #: Leaf paths and kinds, in the order in which they came up; the n-th is stored in column f<n>.
    fields: dict[str, str] = field(default_factory=dict)
    indexes: dict[str, Index] = field(default_factory=dict)
    #: The folder of each batch, in order.
    folders: list[str] = field(default_factory=list)
    #: The number and folder of the last micro-batch that each stream has inserted.
    streams: dict[str, tuple[int, str]] = field(default_factory=dict)

    @property
    def batches(self) -> int:
        return len(self.folders)

    def column(self, path: str) -> str:
        return f"f{list(self.fields).index(path)}"

    def affected(self, leaves) -> set[str]:
        """Indexes with any of the paths among their fields."""
        paths = {p for p, _ in leaves}
        return {n for n, i in self.indexes.items() if paths & set(i.paths)}


@dataclass
class Catalog:
    version: int = 0
    collections: dict[str, Collection] = field(default_factory=dict)

    def collection(self, db: str, name: str) -> Collection:
        try:
            return self.collections[f"{db}.{name}"]
        except KeyError:
            raise BadRequest(f"no collection {db}.{name}") from None

    def to_json(self) -> str:
        return json.dumps(asdict(self), indent=1)

    @classmethod
    def from_json(cls, text: str) -> Catalog:
        raw = json.loads(text)
        found = {}
        for name, c in raw["collections"].items():
            indexes = {n: Index([tuple(f) for f in i["fields"]], i["ready"], i["batches"], i["locked"], i["folders"]) for n, i in c["indexes"].items()}
            found[name] = Collection(c["fields"], indexes, c["folders"], {k: tuple(v) for k, v in c["streams"].items()})
        return cls(raw["version"], found)


class Store:
    """The catalog's files, by Hadoop's file systems: one for each version, whole or not there. A
    version is written beside its place and renamed to it, which fails if another writer was first;
    so of two writers that read the same version one gets SchemaConflict, and readers see the last
    whole version. The rename is what decides where it doesn't replace files (as HDFS's); on local
    file systems a look at the place before it has to do."""

    KEPT = 10

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root
        self.jvm = spark.sparkContext._jvm
        with failures():
            self.fs = self._path("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/catalog{name}")

    def versions(self) -> list[int]:
        """Numbers of the files that are there, in order."""
        if not self.fs.exists(self._path("")):
            return []
        names = [f.getPath().getName() for f in self.fs.listStatus(self._path(""))]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def load(self) -> Catalog:
        with failures():
            if not (found := self.versions()):
                return Catalog()
            stream = self.fs.open(self._path(f"/{found[-1]}.json"))
            try:
                return Catalog.from_json(bytes(stream.readAllBytes()).decode())
            finally:
                stream.close()

    def save(self, catalog: Catalog, expected: int) -> None:
        """Write the catalog as the version after `expected`."""
        with failures():
            before = self.versions()
            found = self.load().version
            if found != expected:
                raise SchemaConflict(f"the catalog is at version {found}, not {expected}")
            number = before[-1] + 1 if before else 0
            draft, place = self._path(f"/{uuid.uuid4().hex}.draft"), self._path(f"/{number}.json")
            stream = self.fs.create(draft, False)
            try:
                stream.write(bytearray(catalog.to_json().encode()))
            finally:
                stream.close()
            done = False
            try:
                done = not self.fs.exists(place) and self.fs.rename(draft, place)
            finally:
                if not done:
                    self.fs.delete(draft, False)
            if not done:
                raise SchemaConflict(f"another writer saved the catalog after version {expected}")
            for old in before[: -self.KEPT]:
                self.fs.delete(self._path(f"/{old}.json"), False)
