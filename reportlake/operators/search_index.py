"""The ranked search from a stored inverted index: postings by stem, appended to as reports come in.

A posting is (stem, word, field, key, places): where a word stands in a field's normal form. Postings lie in ``buckets``
folders by stem, in order of stem and word within a file, so that a query reads the row groups of its own stems; a
table of the distinct words says which others a phrase may begin or end in. Places settle phrases, so no text is read.
Files are written by ranges of (bucket, stem, word, key): a stem that a third of all reports hold is spread over tasks.

An append writes the postings of reports that are not there yet, then their keys, then one row in ``batches``; readers
see the batches that have their row, so what a broken append left behind does not count, and its reports are taken again.

Cases: null and blank fields have no postings; a report with a null key is not indexed; rows that repeat a key within an
append are indexed once (any of them); an empty table appends nothing; extra columns are ignored, clashing names
included; a query of no letter or digit finds nothing.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import vocabulary as V
from ..functions.text import search_text, stem
from ..sources.reports import exists
from ..storage import small_batches
from .search import forms, least_score, query_terms

POSTINGS = "batch string, bucket int, stem string, word string, field string, key string, places array<int>"
#: Postings that a task holds before it hands them on, and those of one report more.
POSTINGS_HELD = 20_000


class SearchIndex:
    """An index below a folder that the cluster shares. Keys are held as text."""

    def __init__(self, spark: SparkSession, root: str, fields: dict[str, int] = V.SEARCH_FIELDS, buckets: int = 64):
        self.spark, self.root, self.fields, self.buckets = spark, root.rstrip("/"), dict(fields), buckets
        if exists(spark, f"{self.root}/facts"):
            self.buckets = json.loads(spark.read.text(f"{self.root}/facts").first()[0])["buckets"]
        else:
            spark.createDataFrame([(json.dumps({"buckets": buckets}),)], "value string").coalesce(1).write.text(f"{self.root}/facts")

    # ------------------------------------------------------------------ writing

    def append(self, reports: DataFrame, key: str = "report_id") -> int:
        """Index the reports whose key is not there yet; how many."""
        fields = [f for f in self.fields if f in reports.columns]
        texts = F.array(*[F.struct(F.lit(f).alias("field"), search_text(F.col(f).cast("string")).alias("text")) for f in fields])
        rows = reports.select(F.col(key).cast("string").alias("key"), texts.alias("texts")).where("key is not null").dropDuplicates(["key"])
        if (known := self._table("keys")) is not None:
            rows = rows.join(known.select("key"), "key", "left_anti")
        batch, most = uuid.uuid4().hex, POSTINGS_HELD

        def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                keys, field, words, where = [], [], [], []
                for k, texts in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    for t in texts:
                        at: dict[str, list[int]] = {}
                        for i, w in enumerate(t["text"].split()):
                            at.setdefault(w, []).append(i)
                        keys += [k] * len(at)
                        field += [t["field"]] * len(at)
                        words += at
                        where += at.values()
                    # Marks the report as seen, words or none.
                    keys.append(k)
                    for column in (field, words, where):
                        column.append(None)
                    if len(keys) >= most:
                        yield posted(keys, field, words, where)
                        keys, field, words, where = [], [], [], []
                yield posted(keys, field, words, where)

        def posted(keys: list, field: list, words: list, where: list) -> pa.RecordBatch:
            columns = [pa.array(keys, pa.string()), pa.array(field, pa.string()), pa.array(words, pa.string()), pa.array(where, pa.list_(pa.int32()))]
            return pa.RecordBatch.from_arrays(columns, ["key", "field", "word", "places"])

        made = rows.mapInArrow(places, "key string, field string, word string, places array<int>")
        named = made.withColumn("stem", stem(F.col("word"))).withColumn("bucket", F.when(F.col("word").isNotNull(), F.pmod(F.hash("stem"), F.lit(self.buckets))).otherwise(-1)).withColumn("batch", F.lit(batch))
        spread = named.repartitionByRange("bucket", "stem", "word", "key").sortWithinPartitions("bucket", "stem", "word", "key")
        with small_batches(self.spark):
            spread.select("stem", "word", "field", "key", "places", "batch", "bucket").write.mode("append").partitionBy("batch", "bucket").parquet(f"{self.root}/postings")
        mine = self._postings(batch)
        mine.where("bucket = -1").select("batch", "key").write.mode("append").partitionBy("batch").parquet(f"{self.root}/keys")
        mine.where("bucket <> -1").select("batch", "word", "stem").distinct().write.mode("append").partitionBy("batch").parquet(f"{self.root}/words")
        n = self.spark.read.schema("key string, batch string").parquet(f"{self.root}/keys").where(F.col("batch") == batch).count()
        self.spark.createDataFrame([(batch, n)], "batch string, n long").coalesce(1).write.mode("append").json(f"{self.root}/batches")
        return n

    # ------------------------------------------------------------------ reading

    def _batches(self) -> list[str]:
        """Finished appends: a row each."""
        if not exists(self.spark, f"{self.root}/batches"):
            return []
        return [r["batch"] for r in self.spark.read.schema("batch string, n long").json(f"{self.root}/batches").where("n > 0").collect()]

    def _postings(self, *batches: str) -> DataFrame:
        return self.spark.read.schema(POSTINGS).parquet(f"{self.root}/postings").where(F.col("batch").isin(*batches))

    def _table(self, name: str) -> DataFrame | None:
        done = self._batches()
        if not done:
            return None
        schema = {"keys": "key string, batch string", "words": "word string, stem string, batch string"}[name]
        return self.spark.read.schema(schema).parquet(f"{self.root}/{name}").where(F.col("batch").isin(*done))

    def _of_stems(self, stems: list[str]) -> DataFrame:
        """Postings of some stems: their folders and row groups alone are read."""
        numbers = self.spark.createDataFrame([(s,) for s in stems], "stem string").select(F.pmod(F.hash("stem"), F.lit(self.buckets)))
        return self._postings(*self._batches()).where(F.col("bucket").isin(*{r[0] for r in numbers.collect()}) & F.col("stem").isin(*stems))

    def _phrases(self, plain: str) -> DataFrame:
        """(key, field) in which a phrase stands: its first word may end a word there, its last one may begin one."""
        parts = plain.split()
        if len(parts) == 1:
            wanted = {0: F.contains("word", F.lit(plain))}
        else:
            wanted = {k: F.col("word") == w for k, w in enumerate(parts)} | {0: F.endswith(F.col("word"), F.lit(parts[0])), len(parts) - 1: F.startswith(F.col("word"), F.lit(parts[-1]))}
        part = F.filter(F.array(*[F.when(c, F.lit(k)) for k, c in wanted.items()]), lambda x: x.isNotNull())
        met = self._table("words").groupBy("word", "stem").agg(F.first(part).alias("parts")).where(F.size("parts") > 0).withColumn("bucket", F.pmod(F.hash("stem"), F.lit(self.buckets)))
        at = self._postings(*self._batches()).join(met, ["bucket", "stem", "word"]).select("key", "field", "places", F.explode("parts").alias("part"))
        if len(parts) == 1:
            return at.select("key", "field").distinct()
        starts = at.select("key", "field", "part", F.explode("places").alias("place")).withColumn("start", F.col("place") - F.col("part"))
        return starts.groupBy("key", "field", "start").agg(F.countDistinct("part").alias("n")).where(F.col("n") == len(parts)).select("key", "field").distinct()

    def search(self, query: str) -> DataFrame:
        """key, score of the reports at or above the least score; no order."""
        plain, tokens, stems = query_terms(query)
        if not stems or not self._batches():
            return self.spark.createDataFrame([], "key string, score double")
        least = 1 if len(stems) <= 2 else 2
        weight = F.coalesce(*[F.when(F.col("field") == f, F.lit(float(w))) for f, w in self.fields.items()])
        all_forms = {w: s for s in stems for w in forms(s)}
        words = self._of_stems(stems).where(F.col("word").isin(*all_forms)).select("key", "field", "stem", F.lit(None).cast("boolean").alias("phrase"), reduce(lambda a, b: a + b, [F.when(F.col("word") == t, F.lit(2.5)).otherwise(0.0) for t in tokens]).alias("points"))
        phrases = self._phrases(plain).select("key", "field", F.lit(None).cast("string").alias("stem"), F.lit(True).alias("phrase"), F.lit(6.0).alias("points"))
        by_stem = words.unionByName(phrases).groupBy("key", "field", "stem").agg((F.sum("points") + F.max(F.when(F.col("stem").isNotNull(), 1.0).otherwise(0.0))).alias("points"), F.max("phrase").alias("phrase"))
        total = by_stem.groupBy("key").agg(F.sum(F.col("points") * weight).alias("points"), F.countDistinct("stem").alias("met"), F.coalesce(F.max("phrase"), F.lit(False)).alias("phrase"))
        score = F.col("points") + F.when(F.col("met") == len(stems), F.lit(10.0)).otherwise(0.0)
        return total.where((F.col("met") >= least) | F.col("phrase")).select("key", score.alias("score")).where(F.col("score") >= least_score(stems))

    def search_reports(self, reports: DataFrame, query: str, key: str = "report_id") -> DataFrame:
        """Reports that are found, best first, newest first among equals, with ``score``; keys that reports lack are left out."""
        hits = self.search(query).select(F.col("key").alias("hit of the index"), F.col("score").alias("score of the index"))
        both = reports.join(hits, F.col(key).cast("string") == F.col("hit of the index"))
        out = both.select(*[reports[f"`{c}`"] for c in reports.columns if c != "score"], F.col("score of the index").alias("score"))
        last = [F.col(c) for c in ("report_id", "url", "id") if c in reports.columns]
        return out.orderBy(F.desc("score"), *([F.desc_nulls_last("date")] if "date" in reports.columns else []), *last)
