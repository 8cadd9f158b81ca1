"""The scheduled refresh: a run takes what has come since the last one, tells of it as events, and ends.

    python -m reportlake.streaming.refresh INCOMING TARGET STATE [--key url]

STATE holds the stream's checkpoint and the events. A run that fails leaves an error event and is made good by the next
one: the checkpoint names the files that are done, and rows whose key the target has are not appended again.
Cases: nothing new leaves the target as it is; an empty or missing target is begun; rows without a key are rows like
others to the stream, and are appended as top_up_stream says; repeated rows of one run are one by key.
"""

from __future__ import annotations

import argparse
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..session import build, ship
from ..sources.reports import exists
from .progress import Events
from .topup import top_up_stream


def refresh(spark: SparkSession, incoming: str, target: str, state: str, key: str = "url", clean: Callable[[DataFrame], DataFrame] | None = None) -> tuple[int, int]:
    """(rows before, rows after) of the target."""
    with Events(spark, f"{state}/events", f"refresh-{uuid.uuid4().hex}") as events:
        events.stage("read", incoming)
        before = spark.read.parquet(target).count() if exists(spark, target) else 0
        schema = spark.read.parquet(incoming).schema
        after = top_up_stream(spark, incoming, target, f"{state}/checkpoint", schema, key, clean)
        events.progress(after - before, after - before, "rows")
    return before, after


def main(arguments: list[str] | None = None, spark: SparkSession | None = None) -> tuple[int, int]:
    parser = argparse.ArgumentParser(description=__doc__)
    for name in ("incoming", "target", "state"):
        parser.add_argument(name)
    parser.add_argument("--key", default="url")
    given = parser.parse_args(arguments)
    spark = spark or build()
    ship(spark)
    before, after = refresh(spark, given.incoming, given.target, given.state, given.key)
    print(f"{after - before} new of {after} rows")
    return before, after


if __name__ == "__main__":
    main()
