"""Helpers shared by the operators: inputs, shipping code to workers, scratch tables."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import os
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROOT = str(Path(__file__).resolve().parents[2])
_SCRATCH: list[tuple[SparkSession, str]] = []


def is_local(spark: SparkSession) -> bool:
    """Whether driver and executors are one process, so that a folder of this machine will do."""
    master = spark.sparkContext.master
    return master == "local" or master.startswith("local[")


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package: from this machine's path where workers run here, from
    an archive that Spark sends to them elsewhere. Once for each application."""
    sc = spark.sparkContext
    if sc.environment.get("DOCLATTICE_SHIPPED") == sc.applicationId:
        return
    known = sc.environment.get("PYTHONPATH", "").split(os.pathsep)
    if ROOT not in known:
        sc.environment["PYTHONPATH"] = os.pathsep.join([x for x in known if x] + [ROOT])
    if not is_local(spark):
        folder = tempfile.mkdtemp()  # the driver serves the archive from here until it ends
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        path = Path(folder, f"doclattice-{uuid.uuid4().hex}.zip")
        with zipfile.ZipFile(path, "w") as archive:
            for p in sorted(Path(ROOT, "doclattice").rglob("*.py")):
                archive.write(p, p.relative_to(ROOT))
        sc.addPyFile(str(path))
    sc.environment["DOCLATTICE_SHIPPED"] = sc.applicationId


def tidy(run: Callable) -> Callable:
    """run, a function of Arrow batches, which gives freed memory back to the system at its end: a
    worker that waits for its next task would keep it."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):  # elsewhere than with glibc
            ctypes.CDLL(None).malloc_trim(0)

    return wrapped


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id as long, text with null as empty, and the further columns; nothing else is read."""
    ship(docs.sparkSession)
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
        *more,
    )


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def counted(big: DataFrame, small: DataFrame, keys: list[str], rows: int) -> DataFrame:
    """big joined with small, which has each of the keys once, with the number `copies` of its rows in
    big. Keys with a large share of big's `rows` rows are at most 4 for each partition; those are
    broadcast, so that no task gets all rows of one. Both are read more than once."""
    bound = max(64, rows // (4 * partitions(big.sparkSession)))
    hot = small.filter(F.col("copies") > bound)
    others = big.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(small, keys)
    return big.join(F.broadcast(hot), keys).unionByName(others).drop("copies")


def scratch_dir(spark: SparkSession) -> str:
    """The cluster's shared folder (spark.checkpoint.dir). Where none is set, a folder of this machine
    in local mode; on a cluster that is an error, as executors wouldn't share it."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not is_local(spark):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        where = Path(tempfile.gettempdir(), "doclattice-scratch").as_uri()
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(where)
    return where


def stored(df: DataFrame) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back: lineage ends here, and a lost
    executor costs nothing. The folder is removed when the driver's Python ends."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark).rstrip('/')}/doclattice/{uuid.uuid4().hex}"
    df.write.parquet(path)
    _SCRATCH.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def scratch_paths() -> list[str]:
    """The scratch tables that are there, in the order in which they were written."""
    return [path for _, path in _SCRATCH]


def drop_stored(spark: SparkSession, paths: list[str] | None = None) -> None:
    """Remove scratch tables (all, if none are named); call it once results that read them are written."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    gone = set(scratch_paths() if paths is None else paths)
    _SCRATCH[:] = [x for x in _SCRATCH if x[1] not in gone]
    for path in gone:
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(conf).delete(where, True)


@atexit.register
def _at_exit() -> None:
    if _SCRATCH:
        try:
            drop_stored(_SCRATCH[-1][0])
        except Exception:  # noqa: BLE001  the JVM may be gone already
            pass
