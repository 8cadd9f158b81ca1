"""Report tables: CSV, Parquet, the view over the test tables, and load_reports.

Rows without a valid date are left out of what is sorted by date; null texts stay null; repeated rows stay; ties of a
date go by url and id; empty tables give empty tables; extra columns are kept.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import vocabulary as V
from ..functions.text import flat_description
from ..storage import remove

THEMES = ["theme_returned", "theme_bulk", "theme_discounted", "theme_promo", "theme_urgent"]
VIEW_COLUMNS = ["report_id", "url", "date", "coroner", "area", "receiver", "investigation", "circumstances", "concerns", *THEMES]
#: Report ids that are sent to all tasks, so that lines of other orders are left out where they are read: 16 MB of ids.
IDS_SENT = 2_000_000
SECTIONS = ["url", "id", "date", "coroner", "area", "receiver", "investigation", "circumstances", "concerns"]


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """A report CSV, newest first: index columns dropped, rows without an ISO date dropped."""
    raw = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    kept = raw.select(*[F.col(f"`{c}`") for c in raw.columns if not c.startswith("Unnamed") and c != "_c0"])
    dated = kept.withColumn("date", F.try_to_date("date", "yyyy-MM-dd")).where("date is not null")
    return dated.orderBy(F.desc("date"), *[c for c in ("url", "id") if c in dated.columns])


def report_view(spark: SparkSession, sf_dir: str, columns: Sequence[str] | None = None) -> DataFrame:
    """A report-shaped view of the test tables: a row for each document, with its order's facts.

    With columns, only the tables that those need are read and joined: a plan cannot know that the joined keys are
    unique, so it would keep joins whose columns nobody reads. Most lines are of orders without a report: up to ``IDS_SENT``
    reports, which are counted, their lines alone are joined, grouped and shuffled; beyond that, all are grouped.
    """
    t = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    wanted = [c for c in VIEW_COLUMNS if columns is None or c in columns or c == "report_id"]
    lines = t("lineitem")
    if {"receiver", *THEMES[:4]} & set(wanted) and t("documents").count() <= IDS_SENT:
        lines = lines.join(F.broadcast(t("documents").select(F.col("doc_id").alias("l_orderkey"))), "l_orderkey", "left_semi")
    out = t("documents").select(F.col("doc_id").alias("report_id"), "text").join(t("orders"), F.col("o_orderkey") == F.col("report_id"))
    if {"coroner", "area"} & set(wanted):
        out = out.join(t("customer").select("c_custkey", "c_name", "c_nationkey"), F.col("c_custkey") == F.col("o_custkey"), "left")
    if "area" in wanted:
        out = out.join(t("nation").select("n_nationkey", "n_name"), F.col("n_nationkey") == F.col("c_nationkey"), "left")
    if set(THEMES[:4]) & set(wanted):
        facts = (
            lines.join(t("part").select("p_partkey", "p_type"), F.col("l_partkey") == F.col("p_partkey"))
            .groupBy(F.col("l_orderkey").alias("fact_key")).agg(
                (F.max(F.when(F.col("l_returnflag") == "R", 1).otherwise(0)) == 1).alias("theme_returned"),
                (F.max("l_quantity") >= 45).alias("theme_bulk"), (F.max("l_discount") >= 0.09).alias("theme_discounted"),
                (F.max(F.when(F.col("p_type") == "PROMO", 1).otherwise(0)) == 1).alias("theme_promo"),
            )
        )
        out = out.join(facts, F.col("report_id") == F.col("fact_key"), "left")
    if "receiver" in wanted:
        names = (
            lines.select("l_orderkey", "l_suppkey").join(t("supplier").select("s_suppkey", "s_name"), F.col("l_suppkey") == F.col("s_suppkey"))
            .groupBy(F.col("l_orderkey").alias("name_key")).agg(F.array_join(F.array_sort(F.collect_set("s_name")), "; ").alias("receiver"))
        )
        out = out.join(names, F.col("report_id") == F.col("name_key"), "left")
    line = lambda k: F.nullif(F.split_part("text", F.lit("\n"), F.lit(k)), F.lit(""))
    rest = F.nullif(F.array_join(F.filter(F.split("text", "\n"), lambda _, i: i > 1), "\n"), F.lit(""))  # the third line and all after it
    made = {
        "url": F.concat(F.lit("https://reports.example.org/"), F.col("report_id").cast("string")), "date": F.col("o_orderdate").cast("date"),
        "coroner": F.col("c_name"), "area": F.col("n_name"), "investigation": line(1), "circumstances": line(2), "concerns": rest,
        "theme_urgent": F.col("o_orderpriority") == "1-URGENT",
    }
    return out.select(*[made[c].alias(c) if c in made else F.col(c) for c in wanted])


#: The same view in DuckDB SQL.
VIEW_SQL = """li AS (SELECT l_orderkey, max(CASE WHEN l_returnflag='R' THEN 1 ELSE 0 END) AS returned, max(l_quantity) AS mq,
  max(l_discount) AS md, max(CASE WHEN p_type='PROMO' THEN 1 ELSE 0 END) AS promo
  FROM lineitem JOIN part ON l_partkey=p_partkey GROUP BY l_orderkey),
rc AS (SELECT l_orderkey, string_agg(s_name, '; ' ORDER BY s_name) AS receiver
  FROM (SELECT DISTINCT l_orderkey, s_name FROM lineitem JOIN supplier ON l_suppkey=s_suppkey) AS x GROUP BY l_orderkey),
reports AS (SELECT d.doc_id AS report_id, concat('https://reports.example.org/', CAST(d.doc_id AS varchar)) AS url,
  CAST(o.o_orderdate AS date) AS "date", c.c_name AS coroner, n.n_name AS area, rc.receiver AS receiver,
  nullif(split_part(d.text, chr(10), 1), '') AS investigation, nullif(split_part(d.text, chr(10), 2), '') AS circumstances,
  nullif(array_to_string((string_split(d.text, chr(10)))[3:], chr(10)), '') AS concerns,
  li.returned=1 AS theme_returned, li.mq>=45 AS theme_bulk, li.md>=0.09 AS theme_discounted, li.promo=1 AS theme_promo,
  o.o_orderpriority='1-URGENT' AS theme_urgent
  FROM documents AS d JOIN orders AS o ON o.o_orderkey=d.doc_id LEFT JOIN customer AS c ON c.c_custkey=o.o_custkey
  LEFT JOIN nation AS n ON n.n_nationkey=c.c_nationkey LEFT JOIN li ON li.l_orderkey=d.doc_id LEFT JOIN rc ON rc.l_orderkey=d.doc_id)"""


def read_theme_schema(spark: SparkSession, path: str, prefix: str = "theme_") -> DataFrame:
    """theme, description from a JSON file {"themes": {name: description}} or {name: description}; prefix and Markdown signs off."""
    raw = spark.read.option("wholetext", True).text(path).select(F.coalesce(F.get_json_object("value", "$.themes"), F.col("value")).alias("j"))
    pairs = raw.select(F.explode(F.from_json("j", "map<string,string>")).alias("k", "v"))
    return pairs.select(F.regexp_replace("k", f"^{prefix}", "").alias("theme"), F.regexp_replace(flat_description(F.col("v")), r"[*`]", "").alias("description"))


def collection_names(wanted: str | Sequence[str], known: dict[str, str] = V.COLLECTIONS) -> list[str]:
    """Columns of collections, each once, in the order asked; unknown names are an error that lists the known."""
    names = [wanted] if isinstance(wanted, str) else list(wanted)
    out: list[str] = []
    for n in names:
        key = n.strip().lower()
        if key not in known:
            raise ValueError(f"unknown collection {n!r}; known: {', '.join(sorted(known))}")
        if known[key] not in out:
            out.append(known[key])
    return out


def in_collections(reports: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Reports that any of the flags marks; null is no. A single flag's column has said all it can and goes."""
    flags = [F.coalesce(F.col(c).cast("boolean"), F.lit(False)) for c in columns]
    kept = reports.where(reduce(lambda a, b: a | b, flags, F.lit(False)))
    return kept.drop(columns[0]) if len(columns) == 1 else kept


def between(reports: DataFrame, start: str = "2000-01-01", end: str = "2050-01-01", today: date | None = None) -> DataFrame:
    """Reports of a period, both days included; the end is today at most."""
    last = min(date.fromisoformat(end), today or date.today())
    if date.fromisoformat(start) > last:
        raise ValueError("the period starts after it ends")
    return reports.where(F.col("date").between(F.lit(start).cast("date"), F.lit(last)))


def exists(spark: SparkSession, path: str) -> bool:
    """Whether there is a file or folder, through Hadoop's file system: for any store."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def cached_dataset(spark: SparkSession, source: str, cache: str, refresh: bool = False) -> str:
    """The path of a dataset's copy as Parquet in a cache folder, made once from a source in any store (CSV by its name, else
    Parquet). refresh deletes the copy first. A copy that broke off does not count; no source and no copy is FileNotFoundError."""
    if refresh:
        remove(spark, cache)
    if not exists(spark, f"{cache}/_SUCCESS"):
        if not exists(spark, source):
            raise FileNotFoundError(source)
        (read_csv(spark, source) if source.endswith(".csv") else spark.read.parquet(source)).write.mode("overwrite").parquet(cache)
    return cache


def load_reports(
    spark: SparkSession, path: str, start_date: str = "2000-01-01", end_date: str = "2050-01-01", n_reports: int | None = None,
    refresh: bool = False, collection: str | Sequence[str] | None = None, known: dict[str, str] = V.COLLECTIONS,
) -> DataFrame:
    """Reports of a period and of collections, newest first, the first n of them. CSV by its name, else Parquet."""
    if n_reports is not None and n_reports < 1:
        raise ValueError("n_reports must be positive")
    if refresh:
        spark.catalog.refreshByPath(path)
    if not exists(spark, path):
        raise FileNotFoundError(path)
    found = read_csv(spark, path) if path.endswith(".csv") else spark.read.parquet(path)
    found = between(found, start_date, end_date)
    if collection is not None:
        found = in_collections(found, collection_names(collection, known))
    found = found.orderBy(F.desc("date"), *[c for c in ("url", "id") if c in found.columns])
    return found.limit(n_reports) if n_reports is not None else found
