"""Sinks: CSV, versioned tables, bundles, JSON payloads, shared workbooks, action logs.

Nulls are written as each format has them (CSV: empty fields; JSON: left out); repeated rows are written as often as they are
there, in no order; empty tables give files without rows; all columns are written under their own names.
"""

from __future__ import annotations

import io
import json
import re
import uuid
import zipfile
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T

from ..operators.rows import name_of
from ..storage import remove, stored

#: Titles and size of shared workbooks.
TITLE = re.compile(r"^[A-Za-z0-9 -]+$")
TITLE_LENGTH, SNAPSHOT_BYTES = 120, 12_500_000


def write_csv(df: DataFrame, path: str, single: bool = False) -> None:
    (df.coalesce(1) if single else df).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def write_version(df: DataFrame, root: str, meta: dict) -> str:
    """A new version beside the old ones, with its facts; readers take the last that has them."""
    version = datetime.now(timezone.utc).strftime("%Y%m%dT%H%M%S%f")
    df.write.parquet(f"{root}/v={version}")
    facts = json.dumps({"version": version, "columns": df.columns} | meta)
    df.sparkSession.createDataFrame([(version, facts)], "version string, facts string").coalesce(1).write.mode("append").json(f"{root}/_meta")
    return version


def read_version(spark: SparkSession, root: str) -> tuple[DataFrame, dict]:
    last = spark.read.schema("version string, facts string").json(f"{root}/_meta").orderBy(F.desc("version")).first()
    return spark.read.parquet(f"{root}/v={last['version']}"), json.loads(last["facts"])


def write_in_batches(rows: DataFrame, path: str, step, key: str = "url", size: int = 250, waves: int = 100) -> DataFrame:
    """step(rows) written so that an interrupted run goes on where it stopped. The result is the whole output.

    Rows are taken in order of the key (null first) in batches of ``size``; rows that share a key are in one batch. A job
    writes one batch, or several where there would be more than ``waves`` jobs. A manifest beside the data has a row for each finished job: its
    last key, rows and digest of what went in, rows of what came out. A run that goes on first checks that the input up to the last key is
    what the finished jobs had, and that their output is all there, else ValueError; the input may have grown behind it. What a
    broken job left behind has no row in the manifest and goes. step: a function from DataFrame to DataFrame that
    keeps the key; it may drop rows.

    Cases: an empty table gives an empty output; repeated rows are kept; rows without a key are the first batch.
    """
    from .reports import exists

    spark, column = rows.sparkSession, F.col(name_of(key))
    kind = rows.select(column.alias("key")).schema["key"].dataType
    schema = T.StructType([T.StructField("job", T.StringType()), T.StructField("last", kind), T.StructField("rows_in", T.LongType()), T.StructField("digest", T.StringType()), T.StructField("rows_out", T.LongType())])
    manifest = f"{path}/_manifest"

    def facts(of: DataFrame) -> tuple[int, int]:
        """Rows, and the sum of their hashes."""
        h = F.xxhash64(F.to_json(F.struct(*[F.col(name_of(c)) for c in of.columns]))).cast("decimal(38,0)")
        n, d = of.agg(F.count(F.lit(1)), F.coalesce(F.sum(h), F.lit(0))).first()
        return n, int(d)

    def job_rows(job: str) -> int:
        return spark.read.parquet(f"{path}/job={job}").count() if exists(spark, f"{path}/job={job}") else 0

    done = spark.read.schema(schema).parquet(manifest).collect() if exists(spark, manifest) else []  # a row for each job
    left = rows
    if done:
        last = max((r["last"] for r in done if r["last"] is not None), default=None)
        before = column.isNull() if last is None else column.isNull() | (column <= F.lit(last))
        if facts(rows.where(before)) != (sum(r["rows_in"] for r in done), sum(int(r["digest"]) for r in done)):
            raise ValueError("the output is no beginning of the input")
        if any(job_rows(r["job"]) != r["rows_out"] for r in done):
            raise ValueError("finished output is missing")
        left = rows.where(~before)
    for job in jobs_of(spark, path):
        if job not in {r["job"] for r in done}:
            remove(spark, f"{path}/job={job}")
    cuts = boundaries(left.select(column.alias("key")), size, waves)
    for k, low in enumerate(cuts):
        high = cuts[k + 1] if k + 1 < len(cuts) else None
        mine = left if k == 0 else left.where(column >= F.lit(low))
        mine = mine if high is None else mine.where(column.isNull() | (column < F.lit(high)) if k == 0 else column < F.lit(high))
        job = uuid.uuid4().hex
        step(mine).write.parquet(f"{path}/job={job}")
        n, digest = facts(mine)
        row = (job, mine.agg(F.max(column)).first()[0], n, str(digest), job_rows(job))
        spark.createDataFrame([row], schema).coalesce(1).write.mode("append").parquet(manifest)
    found = jobs_of(spark, path)
    # Each job's folder is read for itself: read as partitions, "job" would hide a column of that name.
    return spark.read.parquet(*[f"{path}/job={job}" for job in found]) if found else step(rows)


def jobs_of(spark: SparkSession, path: str) -> list[str]:
    """Jobs that have a folder below a path."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = [x.getPath().getName() for x in fs.listStatus(where)] if fs.exists(where) else []
    return [x.removeprefix("job=") for x in names if x.startswith("job=")]


def boundaries(keys: DataFrame, size: int, most: int) -> list:
    """First keys of batches of about ``size`` rows in order of the key, of more where there would be over ``most`` batches.

    Ranks come from counts of ranges and places within them, so no task sorts all keys. No rows, no batch.
    """
    held = stored(keys.repartitionByRange(F.col("key").asc_nulls_first()).withColumn("part", F.spark_partition_id()), "batch-keys")
    first, n = [], 0
    for r in held.groupBy("part").count().orderBy("part").toLocalIterator():  # a row for each range
        first += [F.lit(r["part"]), F.lit(n)]
        n += r["count"]
    if not n:
        return []
    step = size * max(1, -(-n // (size * most)))
    rank = F.create_map(*first)[F.col("part")] + F.row_number().over(Window.partitionBy("part").orderBy(F.col("key").asc_nulls_first())) - 1
    cuts = [r["key"] for r in held.withColumn("rank", rank).where(F.col("rank") % step == 0).orderBy("rank").collect()]  # most rows at most
    return [x for k, x in enumerate(cuts) if k == 0 or (x is not None and x != cuts[k - 1])]


def write_themes(spark: SparkSession, path: str, reply: str) -> None:
    """A model's raw reply beside earlier ones, with its time."""
    now = datetime.now(timezone.utc).isoformat()
    spark.createDataFrame([(now, reply)], "at string, reply string").coalesce(1).write.mode("append").json(path)


def read_split_json(spark: SparkSession, text: str) -> DataFrame | None:
    """A snapshot as JSON of columns and data; None where the text is none or blank."""
    facts = json.loads(text) if text and text.strip() else None
    if not facts or not facts.get("columns"):
        return None
    rows = [tuple(None if v is None else str(v) for v in r) for r in facts["data"]]
    return spark.createDataFrame(rows, ", ".join(f"`{c}` string" for c in facts["columns"]))


def bundle(frames: dict[str, DataFrame], script: str | None = None, most_rows: int = 100_000, kind: str = "csv") -> tuple[str, bytes]:
    """A download: one CSV, or a ZIP of several and of the script. For results of a size to look at, which is checked."""
    files = {}
    for name, df in frames.items():
        rows = df.limit(most_rows + 1).toPandas()
        if len(rows) > most_rows:
            raise ValueError(f"{name} has more than {most_rows} rows; use write_csv")
        files[f"{name}.{kind}"] = rows.to_csv(index=False, sep={"csv": ",", "tsv": "\t"}[kind]).encode()
    if len(files) == 1 and script is None:
        return next(iter(files.items()))
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, data in files.items():
            z.writestr(name, data)
        if script is not None:
            z.writestr("script.py", script)
    return "bundle.zip", out.getvalue()


def payload(df: DataFrame) -> DataFrame:
    """A JSON object for each row."""
    return df.select(F.to_json(F.struct(*df.columns)).alias("json"))


class Workbooks:
    """Shared snapshots on Parquet; every save is a row, the last one of an id holds."""

    SCHEMA = "share_number long, public_id string, edit_token string, title string, snapshot string, created_at string, updated_at string"

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _now(self) -> str:
        return datetime.now(timezone.utc).isoformat()

    def _append(self, row: tuple) -> None:
        self.spark.createDataFrame([row], self.SCHEMA).coalesce(1).write.mode("append").parquet(self.path)

    @staticmethod
    def _check(title: str, snapshot: str) -> None:
        if not TITLE.match(title) or len(title) > TITLE_LENGTH:
            raise ValueError("a title has letters, digits, spaces and hyphens, 120 at most")
        if len(snapshot.encode()) > SNAPSHOT_BYTES:
            raise ValueError("the snapshot is too large")

    def all(self) -> DataFrame:
        try:
            return self.spark.read.schema(self.SCHEMA).parquet(self.path)
        except Exception as e:  # noqa: BLE001
            if "PATH_NOT_FOUND" in str(e):
                return self.spark.createDataFrame([], self.SCHEMA)
            raise

    def get(self, public_id: str):
        return self.all().where(F.col("public_id") == public_id).orderBy(F.desc("updated_at")).first()

    def create(self, title: str, snapshot: dict) -> dict:
        text = json.dumps(snapshot)
        self._check(title, text)
        number = (self.all().agg(F.max("share_number")).first()[0] or 0) + 1
        now = self._now()
        row = (number, str(uuid.uuid4()), str(uuid.uuid4()), title, text, now, now)
        self._append(row)
        return dict(zip(("share_number", "public_id", "edit_token"), row, strict=False))

    def save(self, public_id: str, edit_token: str, title: str, snapshot: dict) -> None:
        old = self.get(public_id)
        if old is None:
            raise KeyError(public_id)
        if old["edit_token"] != edit_token:
            raise PermissionError("the edit token does not fit")
        text = json.dumps(snapshot)
        self._check(title, text)
        self._append((old["share_number"], public_id, edit_token, title, text, old["created_at"], self._now()))

    def clone(self, public_id: str, title: str | None = None) -> dict:
        old = self.get(public_id)
        return self.create(title or old["title"], json.loads(old["snapshot"]))
