"""Results held between reads: frames of a session by file signature, payloads on disk by plan and input for all sessions.

Both let the least recently used go first. Empty results are held like others; a failed refresh of a frame falls back to
what is held; a payload whose input files changed is made anew.
"""

from __future__ import annotations

import hashlib
import json
import re
import threading
import time
import uuid
from collections import OrderedDict
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..storage import remove

#: Frames held, and how long a browsed dataset counts as fresh.
HELD, FRESH_SECONDS = 6, 6 * 3600
#: Fixed value: payloads held.
PAYLOADS = 64


def signature(spark: SparkSession, path: str) -> tuple:
    """Path, time and size of a file or folder, through Hadoop's file system: works for any store."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return (path, fs.getFileStatus(where).getModificationTime(), fs.getContentSummary(where).getLength())


class FrameCache:
    """Persisted frames by key; a failed refresh falls back to what is held."""

    def __init__(self, held: int = HELD, fresh: float = FRESH_SECONDS):
        self.held, self.fresh, self.lock = held, fresh, threading.Lock()
        self.frames: OrderedDict[tuple, tuple[float, DataFrame]] = OrderedDict()

    def get(self, key: tuple, load: Callable[[], DataFrame], refresh: bool = False) -> DataFrame:
        with self.lock:
            old = self.frames.get(key)
            if old and not refresh and time.time() - old[0] < self.fresh:
                self.frames.move_to_end(key)
                return old[1]
            try:
                frame = load().persist()
            except Exception:
                if old:
                    return old[1]
                raise
            self.frames[key] = (time.time(), frame)
            self.frames.move_to_end(key)
            while len(self.frames) > self.held:
                self.frames.popitem(last=False)[1][1].unpersist()
            return frame


def plan_text(df: DataFrame) -> str:
    """A plan in canonical form, so that equal queries read alike in any session."""
    conf, name = df.sparkSession.conf, "spark.sql.debug.maxToStringFields"
    before = conf.get(name, None)
    conf.set(name, "100000")
    try:
        text = df._jdf.queryExecution().optimizedPlan().canonicalized().toString()
    finally:
        conf.unset(name) if before is None else conf.set(name, before)
    return re.sub(r"#\d+L?", "#", text)


class Payloads:
    """Results as Parquet below a folder that sessions share, by plan, input files and tag.

    The key is a digest of the plan in canonical form and of path, time and size of each input file. Python functions are in a
    plan by name only and tables made on the driver by size only, so plans that hold such need a tag that says which. A
    payload counts once its facts are written, which is last; then the least recently used beyond ``held`` go.
    """

    def __init__(self, spark: SparkSession, root: str, held: int = PAYLOADS):
        self.spark, self.root, self.held, self.lock = spark, root.rstrip("/"), held, threading.Lock()
        self.path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self.fs = self.path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def key(self, df: DataFrame, tag: str = "") -> str:
        text = plan_text(df)
        if not tag and ("PythonUDF" in text or "InPandas" in text or "InArrow" in text or "LocalRelation" in text or "LogicalRDD" in text):
            raise ValueError("a plan with Python functions or rows of the driver needs a tag")
        files = sorted(signature(self.spark, f) for f in df.inputFiles())
        return hashlib.sha256(json.dumps([text, files, tag]).encode()).hexdigest()

    def _entries(self) -> list[tuple[str, str, str]]:
        """(last use, key, folder) of finished payloads, the least recent first."""
        if not self.fs.exists(self.path(f"{self.root}/used")):
            return []
        found = [x.getPath().getName().split("-") for x in self.fs.listStatus(self.path(f"{self.root}/used"))]
        last: dict[tuple[str, str], str] = {}
        for at, key, folder in found:
            last[key, folder] = max(at, last.get((key, folder), ""))
        return sorted((at, key, folder) for (key, folder), at in last.items())

    def _use(self, key: str, folder: str) -> None:
        """A new sign of use, in place of older ones."""
        old = [x.getPath() for x in self.fs.listStatus(self.path(f"{self.root}/used"))] if self.fs.exists(self.path(f"{self.root}/used")) else []
        self.fs.create(self.path(f"{self.root}/used/{time.time_ns():020d}-{key}-{folder}"), False).close()
        for x in old:
            if x.getName().endswith(f"-{key}-{folder}"):
                self.fs.delete(x, False)

    def get(self, df: DataFrame, tag: str = "") -> DataFrame:
        """The result of df, from its payload, which is made if there is none."""
        key = self.key(df, tag)
        with self.lock:
            have = [folder for _, k, folder in self._entries() if k == key]
            folder = have[-1] if have else uuid.uuid4().hex
            if not have:
                df.write.parquet(f"{self.root}/data/{folder}")
            self._use(key, folder)
            for _, k, gone in self._entries()[: -self.held]:
                for x in self.fs.listStatus(self.path(f"{self.root}/used")):
                    if x.getPath().getName().endswith(f"-{k}-{gone}"):
                        self.fs.delete(x.getPath(), False)
                remove(self.spark, f"{self.root}/data/{gone}")
        return self.spark.read.schema(df.schema).parquet(f"{self.root}/data/{folder}")

    def keys(self) -> list[str]:
        """Keys that are held, the least recently used first."""
        return [k for _, k, _ in self._entries()]
