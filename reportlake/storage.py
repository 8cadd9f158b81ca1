"""The shared folder of a session, and tables written there."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The cluster's checkpoint folder. Where the session names none, a private one - under a local master only,
    since other executors would not see it; elsewhere that is an error."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    held = sc._jsc.sc().getCheckpointDir()
    if named is None and held.isDefined():
        named = held.get()
    if named is None:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = f"file://{tempfile.mkdtemp(prefix='reportlake-shared-')}"
    if not held.isDefined():
        sc.setCheckpointDir(named)
    return named


def fresh_folder(spark: SparkSession, tag: str) -> str:
    """A new folder below the shared one, deleted when the driver's Python ends."""
    path = f"{shared_folder(spark).rstrip('/')}/{tag}-{uuid.uuid4().hex}"
    atexit.register(remove, spark, path)
    return path


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder through Hadoop's file system; after the JVM has gone this does nothing."""
    try:
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # noqa: BLE001 - best effort at interpreter exit
        pass


def stored(df: DataFrame, tag: str) -> DataFrame:
    """A table written to the shared folder and read again."""
    path = fresh_folder(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def small_batches(spark: SparkSession, rows: int = 1000, size: int = 4 << 20) -> Iterator[None]:
    """What is written meanwhile meets Python in Arrow batches of so many rows and bytes at most: long texts fill Spark's usual
    10,000 rows with hundreds of MB once tasks have as many rows. A session's own lower settings stay."""
    before = {}
    for name, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", rows), ("spark.sql.execution.arrow.maxBytesPerBatch", size)):
        now = spark.conf.get(name, None)
        if not (now or "").isdecimal() or not 0 < int(now) <= most:
            before[name] = now
            spark.conf.set(name, str(most))
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)
