"""Progress events of runs as rows that any session can follow: stage, progress, complete, error, and signs of life.

An event is a small file in a folder of the run, written through Hadoop's file system, so it costs no Spark job. Events of a run are
numbered from 0 without gaps, each once, in the order told; after complete or error a run is over and takes no more. While
nothing is told for ``alive`` seconds a keep-alive is. ``ProgressListener`` tells what streaming queries do.

Cases: no event, or no folder yet, is an empty table; progress of 0 out of 0 is 0 percent; a message may hold anything.
"""

from __future__ import annotations

import json
import threading
import uuid
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.listener import StreamingQueryListener

from ..sources.reports import exists

#: Seconds between signs of life, and an event's columns.
ALIVE = 15.0
EVENT = "run string, number long, at string, event string, data string"
LAST = ("complete", "error")


class Events:
    """The events of one run, below a folder that other sessions read; safe to share among threads."""

    def __init__(self, spark: SparkSession, root: str, run: str | None = None, alive: float = ALIVE):
        self.run, self.alive, self.root = run or uuid.uuid4().hex, alive, f"{root.rstrip('/')}"
        self.jvm, self.conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        self.number, self.lock, self.over = 0, threading.Lock(), threading.Event()
        self.told = threading.Event()
        self.keeper = threading.Thread(target=self._keep_alive, daemon=True)
        self.keeper.start()

    def _keep_alive(self) -> None:
        while not self.over.is_set():
            self.told.clear()
            if not self.told.wait(self.alive) and not self.over.is_set():
                self._tell("keepalive", {})

    def _tell(self, event: str, data: dict) -> None:
        with self.lock:
            if self.over.is_set():
                return
            row = {"run": self.run, "number": self.number, "at": datetime.now(timezone.utc).isoformat(), "event": event, "data": json.dumps(data, default=str)}
            place = self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{self.run}-{self.number:08d}.json")
            out = place.getFileSystem(self.conf).create(place, False)
            try:
                out.write((json.dumps(row) + "\n").encode())
            finally:
                out.close()
            self.number += 1
            if event in LAST:
                self.over.set()
        self.told.set()

    def stage(self, stage: str, message: str = "") -> None:
        self._tell("stage", {"stage": stage, "message": message})

    def progress(self, completed: int, total: int, description: str = "") -> None:
        self._tell("progress", {"completed": completed, "total": total, "description": description, "percent": round(100 * completed / total) if total else 0})

    def complete(self, message: str = "", **more) -> None:
        self._tell("complete", {"message": message} | more)

    def error(self, message: str) -> None:
        self._tell("error", {"message": message})

    def __enter__(self) -> Events:
        return self

    def __exit__(self, kind, error, trace) -> None:
        """complete, or error with what was raised, unless the run has told its end."""
        self.error(f"{kind.__name__}: {error}") if kind else self.complete()


def read_events(spark: SparkSession, root: str, run: str | None = None, after: int = -1) -> DataFrame:
    """Events of a run (or of all), those after a number; ``frame`` is the event in the form of server-sent events."""
    if not exists(spark, root):
        rows = spark.createDataFrame([], EVENT)
    else:
        rows = spark.read.schema(EVENT).json(root)
    frame = F.when(F.col("event") == "keepalive", F.lit(": keepalive\n\n")).otherwise(F.concat(F.lit("event: "), "event", F.lit("\ndata: "), "data", F.lit("\n\n")))
    chosen = rows.where(F.col("number") > after) if run is None else rows.where((F.col("run") == run) & (F.col("number") > after))
    return chosen.withColumn("frame", frame)


def follow(spark: SparkSession, root: str) -> DataFrame:
    """The same as a stream: each event once."""
    return spark.readStream.schema(EVENT).json(root)


class ProgressListener(StreamingQueryListener):
    """Tells a run's events from the streaming queries of a session: a stage as one starts, progress at each batch with
    rows (rows so far), complete when the last running one ends, error when one fails.

    names: the queries to heed by name; all of the session without.
    """

    def __init__(self, events: Events, names: tuple[str, ...] = ()):
        self.events, self.names = events, names
        self.rows: dict[str, int] = {}
        self.name: dict[str, str] = {}

    def onQueryStarted(self, event) -> None:
        if not self.names or event.name in self.names:
            self.rows[str(event.id)], self.name[str(event.id)] = 0, event.name or "stream"
            self.events.stage(event.name or "stream", f"query {event.id} started")

    def onQueryProgress(self, event) -> None:
        p = event.progress
        if str(p.id) in self.rows and p.numInputRows:
            self.rows[str(p.id)] += p.numInputRows
            n = self.rows[str(p.id)]
            self.events.progress(n, n, f"{self.name[str(p.id)]}: batch {p.batchId}, {p.numInputRows} rows")

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        if str(event.id) not in self.rows:
            return
        n = self.rows.pop(str(event.id))
        if event.exception:
            self.events.error(event.exception.splitlines()[0])
        elif not self.rows:
            self.events.complete(f"{n} rows")
