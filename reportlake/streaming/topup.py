"""Incremental runs as Structured Streaming: new report files appended once, resumable; event windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.tables import new_rows


def top_up_stream(spark: SparkSession, incoming: str, target: str, checkpoint: str, schema, key: str = "url", clean=None) -> int:
    """Take the report files that have come since the last run; append rows whose key the target lacks.

    The checkpoint remembers finished files, so a run that broke off goes on where it was; the anti-join makes a
    batch that is taken twice harmless. Returns the rows of the target.
    """
    source = spark.readStream.schema(schema).parquet(incoming)

    def take(batch: DataFrame, _: int) -> None:
        rows = clean(batch) if clean else batch
        try:
            seen = spark.read.parquet(target).select(key)
        except Exception as e:  # noqa: BLE001 - the first run finds no target
            if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
                raise
            seen = spark.createDataFrame([], batch.select(key).schema)
        new_rows(seen, rows, key).write.mode("append").parquet(target)

    query = source.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.parquet(target).count()


def event_windows(events: DataFrame, width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Counts and sums of events by tumbling window and type; works on a batch or a stream. An extension."""
    marked = events.withWatermark("ts", late) if events.isStreaming else events
    w = marked.groupBy(F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return w.select(F.col("window.start").alias("start"), "event_type", "n", "total")
