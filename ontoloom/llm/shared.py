"""What the operators of this subpackage share: tables in the cluster's shared folder, code for the workers, columns."""

from __future__ import annotations

import atexit
import tempfile
import uuid
import weakref
import zipfile
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side of a join goes to every executor only when it was counted and has at most so many rows of a few numbers each.
BROADCAST_ROWS = 1_000_000

#: Rows of an Arrow batch where the session has Spark's default of 10,000: rows here are whole texts.
ARROW_ROWS, ARROW_DEFAULT = "1000", "10000"

#: Whether what a statement has shuffled goes when it ends. Else it stays until the driver happens to collect its garbage, long after a table
#: was written of it.
CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_archives: weakref.WeakKeyDictionary = weakref.WeakKeyDictionary()
_own_dirs: dict[str, tempfile.TemporaryDirectory] = {}


def ship(spark: SparkSession) -> None:
    """Make this package importable in the Python workers, whatever folder the driver was started from, and keep Arrow batches small."""
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == ARROW_DEFAULT:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS)
    context = spark.sparkContext
    if context in _archives:
        return
    package = Path(__file__).resolve().parents[1]
    folder = _archives[context] = tempfile.TemporaryDirectory(prefix="ontoloom-code-")
    archive = Path(folder.name) / f"{package.name}.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for p in sorted(package.rglob("*.py")):
            z.write(p, p.relative_to(package.parent))
    context.addPyFile(str(archive))


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a folder of this process where the session names none (tests, one machine)."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_dirs:
        _own_dirs[app] = tempfile.TemporaryDirectory(prefix="ontoloom-")
    return f"file://{_own_dirs[app].name}"


class Tables:
    """Tables that an operator writes to cut lineage: any executor can be lost afterwards without work being done again.

    ``drop`` removes the ones that are no longer read; the rest goes when the session ends.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, {}
        atexit.register(self.drop)

    def write(self, df: DataFrame) -> DataFrame:
        path = f"{shared_dir(self.spark)}/t-{uuid.uuid4().hex}"
        before = self.spark.conf.get(CLEAN, None)
        self.spark.conf.set(CLEAN, "true")
        try:
            df.write.option("compression", "zstd").parquet(path)
        finally:
            self.spark.conf.unset(CLEAN) if before is None else self.spark.conf.set(CLEAN, before)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[path] = out
        return out

    def drop(self, *tables: DataFrame) -> None:
        context = self.spark.sparkContext
        if context._jsc is None:
            return
        for path in [p for p, t in self.paths.items() if not tables or any(t is x for x in tables)]:
            self.paths.pop(path)
            try:
                at = context._jvm.org.apache.hadoop.fs.Path(path)
                at.getFileSystem(context._jsc.hadoopConfiguration()).delete(at, True)
            except Exception:  # noqa: BLE001  the JVM may be gone when the process ends
                return


def semi(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows of df whose key is in ids (distinct keys): by a broadcast if ids was counted to be small, else by a shuffle."""
    if ids.count() <= BROADCAST_ROWS:
        ids = F.broadcast(ids)
    return df.join(ids, key, "left_semi")


def held_out(doc_id: str, mod: int, remainder: int) -> Column:
    """Whether crc32 of the id as text leaves this remainder; a null id is not held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % mod == remainder, F.lit(False))


def batches(it: Iterator[pa.RecordBatch], rows: int = 512, size: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most so many rows and, but for single rows, about so many bytes."""
    for b in it:
        step = max(1, min(rows, b.num_rows * size // max(1, b.nbytes)))
        for k in range(0, b.num_rows, step):
            yield b.slice(k, step)
        pa.default_memory_pool().release_unused()
