"""Tables written to the cluster's shared folder: they cut lineage in loops and are read again by later queries."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: A join side is broadcast only after a count of at most so many rows.
BROADCAST_ROWS = 1_000_000

_own: dict[str, tempfile.TemporaryDirectory] = {}
_written: list[tuple[SparkSession, str]] = []


def folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` where the session names one; else a folder of this process, for one machine."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = tempfile.TemporaryDirectory(prefix="ontoloom-graph-")
    return f"file://{_own[app].name}"


def materialized(df: DataFrame) -> DataFrame:
    """The same rows, read from a table that was just written."""
    path = f"{folder(df.sparkSession)}/g-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append((df.sparkSession, path))
    return df.sparkSession.read.schema(df.schema).parquet(path)


@atexit.register
def _clean() -> None:
    for spark, path in _written:
        context = spark.sparkContext
        if context._jsc is None:
            return
        try:
            at = context._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(context._jsc.hadoopConfiguration()).delete(at, True)
        except Exception:  # noqa: BLE001  the JVM may be gone when the process ends
            return
