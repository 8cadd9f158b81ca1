"""Shared helpers of the training-data operators."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import gc
import mmap
import os
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..storage import fresh_folder as scratch, remove as delete, shared_folder as checkpoint_dir, stored as written

__all__ = ["checkpoint_dir", "delete", "scratch", "written"]


def trim() -> None:
    """Give freed memory back to the system: Python workers are used again and keep it otherwise."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):  # a C library without it
        ctypes.CDLL(None).malloc_trim(0)


def trimmed(run: Callable) -> Callable:
    """A function for mapInArrow that gives its memory back when its task ends."""

    @functools.wraps(run)
    def outer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        trim()

    return outer


def few_rows_a_batch(spark: SparkSession, most: int = 2000) -> None:
    """Arrow batches of fewer rows than Spark's default, since texts make long rows: a batch is held on both sides of
    the pipe. A session's own lower setting stays."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(name, "10000"))
    if now <= 0 or now > most:
        spark.conf.set(name, str(most))


def plan_bytes(df: DataFrame) -> int:
    """Optimizer's estimate of a plan's size; for a scan, its file size."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def partitions(df: DataFrame, target_bytes: int = 16 << 20, expand: float = 1.0) -> int:
    """Shuffle partitions of about target_bytes for the rows of df; at least the session's setting."""
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    size = plan_bytes(df)
    return least if size > 1 << 60 else max(least, min(200_000, int(size * expand / target_bytes) + 1))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def utf8(column: pa.Array) -> tuple:
    """(offsets, bytes) of a string or binary Arrow column as numpy arrays, nulls as empty; no copies of text."""
    import numpy as np

    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, off, data = column.buffers()
    kind = np.int64 if wide else np.int32
    if len(column) == 0 or off is None:
        return np.zeros(len(column) + 1, np.int64), np.zeros(0, np.uint8)
    offsets = np.frombuffer(off, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return offsets, np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)


def blob(array) -> bytes:
    return array.tobytes()


# ---------------------------------------------------------------------------- files beside Spark's own writers


def open_output(uri: str):
    """Binary stream for a new file in the shared folder: local mounts directly, other stores through pyarrow."""
    kind, path = _place(uri)
    if kind == "local":
        os.makedirs(os.path.dirname(path), exist_ok=True)
        return open(path, "wb")
    from pyarrow import fs

    store, where = fs.FileSystem.from_uri(uri)
    return store.open_output_stream(where)


def open_input(uri: str):
    """Seekable binary stream of a file written by open_output."""
    kind, path = _place(uri)
    if kind == "local":
        return open(path, "rb")
    from pyarrow import fs

    store, where = fs.FileSystem.from_uri(uri)
    return store.open_input_file(where)


def mapped(uri: str):
    """The bytes of a file written by open_output: mapped into memory under a local mount, so that workers of a machine
    share its pages; read whole from other stores."""
    with open_input(uri) as f:
        return mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ) if _place(uri)[0] == "local" else f.read()


def file_size(uri: str) -> int:
    kind, path = _place(uri)
    if kind == "local":
        return os.path.getsize(path)
    from pyarrow import fs

    store, where = fs.FileSystem.from_uri(uri)
    return store.get_file_info(where).size


def _place(uri: str) -> tuple[str, str]:
    if uri.startswith("file:"):
        rest = uri[5:]
        return "local", "/" + rest.lstrip("/")
    return ("other", uri) if "://" in uri else ("local", uri)


# ---------------------------------------------------------------------------- connected components


def components(edges: DataFrame) -> DataFrame:
    """(id, component) of the ends of an edge table (a, b): the smallest id that each can reach.

    Rounds of star contraction (large-star, then small-star): each node points to the smallest node near it, until a
    round changes nothing, which takes about log(nodes)**2 rounds. Rows are narrow; each round is written to the
    shared folder, which cuts its lineage, and the one before is deleted.
    """
    spark = edges.sparkSession

    def step(df: DataFrame) -> tuple[DataFrame, str, tuple]:
        path = scratch(spark, "components")
        df.write.parquet(path)
        kept = spark.read.schema(df.schema).parquet(path)
        mark = [F.count(F.lit(1)), *[F.sum(F.xxhash64(*c).cast("decimal(38,0)")) for c in (("a", "b"), ("b", "a", F.lit(1)))]]
        return kept, path, tuple(kept.agg(*mark).first())

    now, path, mark = step(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    while mark[0]:
        # Large-star: larger neighbours move to the smallest of the neighbourhood (the node included).
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # Small-star: a node and its smaller neighbours move to the smallest of them.
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b")))
        old, past = path, mark
        now, path, mark = step(small.where("a <> b").distinct())
        delete(spark, old)
        if mark == past:
            break
    return now.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(
        now.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct()
    )


def release(spark: SparkSession) -> None:
    """Let the context cleaner drop shuffle files of finished steps: it learns of them when the JVM collects garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
