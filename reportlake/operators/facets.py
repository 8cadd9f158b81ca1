"""Filters, facets and dashboard aggregates.

Null and blank values count as "Not specified" or not at all, as each function says; ties go by lower-cased name, then
name; repeated rows count as they are; empty tables give empty tables or zeros; extra columns are kept or ignored.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.text import dashboard_value, first_seen, lit_array, receivers

BLANK = "Not specified"


def facet_filter(reports: DataFrame, coroners: Sequence[str] = (), areas: Sequence[str] = (), receiver: Sequence[str] = ()) -> DataFrame:
    """Within a facet any value, across facets all; case does not matter; a missing column matches nothing."""
    tests: list[Column] = []
    for name, values in (("coroner", coroners), ("area", areas), ("receiver", receiver)):
        if not values:
            continue
        wanted = [v.strip().lower() for v in values]
        if name not in reports.columns:
            tests.append(F.lit(False))
        elif name == "receiver":
            tests.append(F.arrays_overlap(F.transform(receivers(F.col(name)), lambda x: F.lower(x)), lit_array(wanted)))
        else:
            tests.append(F.coalesce(F.lower(F.trim(name)).isin(wanted), F.lit(False)))
    return reports.where(reduce(lambda a, b: a & b, tests)) if tests else reports


def top_values(reports: DataFrame, column: str, n: int = 12) -> DataFrame:
    """The most common values, blank as its own; ties by lower-cased name, then name."""
    v = dashboard_value(F.col(column))
    counted = reports.select(F.when(v == "", BLANK).otherwise(v).alias("name")).groupBy("name").agg(F.count(F.lit(1)).alias("n"))
    return counted.orderBy(F.desc("n"), F.lower("name"), "name").limit(n)


def top_receivers(reports: DataFrame, n: int = 12) -> DataFrame:
    """The most common receivers, each once in a report (first spelling); reports without one count as blank."""
    named = first_seen(receivers(F.col("receiver")))
    each = reports.select(F.explode(F.when(F.size(named) == 0, F.array(F.lit(BLANK))).otherwise(named)).alias("name"))
    return each.groupBy("name").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.lower("name"), "name").limit(n)


def monthly(reports: DataFrame) -> DataFrame:
    return reports.where("date is not null").groupBy(F.date_format("date", "yyyy-MM").alias("month")).agg(F.count(F.lit(1)).alias("n")).orderBy("month")


def totals(reports: DataFrame) -> DataFrame:
    """One row: reports, receiver links, distinct coroners, first and last date."""
    who = F.nullif(dashboard_value(F.col("coroner")), F.lit(""))
    return reports.agg(
        F.count(F.lit(1)).alias("reports"), F.coalesce(F.sum(F.size(first_seen(receivers(F.col("receiver"))))), F.lit(0)).cast("long").alias("receiver_links"),
        F.countDistinct(who).alias("coroners"), F.min("date").alias("earliest"), F.max("date").alias("latest"),
    )


def options(reports: DataFrame, column: str) -> DataFrame:
    """Distinct values of a facet, sorted without regard to case."""
    each = reports.select(F.explode(receivers(F.col(column))).alias("value")) if column == "receiver" else reports.select(dashboard_value(F.col(column)).alias("value"))
    return each.where("value <> ''").distinct().orderBy(F.lower("value"), "value")


def melted(reports: DataFrame, themes: Sequence[str], key: str = "report_id") -> DataFrame:
    """(key, theme) of the themes that hold."""
    return reports.select(key, F.explode(F.filter(F.array(*[F.when(F.col(t), F.lit(t)) for t in themes]), lambda x: x.isNotNull())).alias("theme"))


def flag_counts(reports: DataFrame, flags: dict[str, str]) -> DataFrame:
    """Rows (label, n) from one pass over flag columns; label 'custom' counts all rows."""
    sums = [F.count(F.lit(1)).alias("custom"), *[F.coalesce(F.sum(F.col(c).cast("int")), F.lit(0)).cast("long").alias(n) for n, c in flags.items()]]
    one = reports.agg(*sums)
    return one.select(F.explode(F.create_map(*[x for n in one.columns for x in (F.lit(n), F.col(n))])).alias("label", "n"))


def theme_counts(reports: DataFrame, themes: Sequence[str], without: str | None = None) -> DataFrame:
    """(theme, n) above 0, most first; the active collection's own column left out."""
    rows = flag_counts(reports, {t: t for t in themes if t != without}).where("label <> 'custom' and n > 0")
    return rows.select(F.col("label").alias("theme"), "n").orderBy(F.desc("n"), "theme")


def page(reports: DataFrame, number: int, size: int = 100) -> DataFrame:
    """A page of reports, newest first; a number beyond the ends means the nearest page.

    The slice is a top-k by offset and limit; nothing is ranked in one task.
    """
    last = max(1, -(-reports.count() // size))
    k = min(max(1, number), last)
    return reports.orderBy(F.desc_nulls_last("date"), "report_id").offset((k - 1) * size).limit(size)


def theme_summary(reports: DataFrame, themes: dict[str, str]) -> DataFrame:
    """Theme, Description, Count and % of all reports (one place), most common first. themes: column and description."""
    rows = flag_counts(reports, {t: t for t in themes})
    total = rows.where("label = 'custom'").select(F.col("n").alias("total"))
    said = F.create_map(*[F.lit(x) for pair in themes.items() for x in pair])
    both = rows.where("label <> 'custom'").crossJoin(F.broadcast(total))  # one row at the right
    percent = F.round(F.col("n") * 100.0 / F.greatest(F.lit(1), F.col("total")), 1).cast("double")
    return both.select(F.col("label").alias("Theme"), F.try_element_at(said, F.col("label")).alias("Description"), F.col("n").alias("Count"), percent.alias("%")).orderBy(F.desc("Count"), "Theme")


def dedupe_ids(reports: DataFrame, column: str = "row_id", seed: str = "url") -> DataFrame:
    """Row ids unique: blank and repeated ones get a digest of the row's key instead.

    Of the rows of an id the one with the least key keeps it. Rows meet by id and key, never by id alone, so a blank
    or repeated id of very many rows is spread.
    """
    held = reports.select(F.struct("*").alias("row"), F.coalesce(F.trim(F.col(column)), F.lit("")).alias("id"), F.col(seed).cast("string").alias("key"))
    nth = F.row_number().over(Window.partitionBy("id", "key").orderBy(F.xxhash64("row")))
    first = held.groupBy("id").agg(F.min("key").alias("least"))
    both = held.withColumn("nth", nth).join(first, "id")
    fresh = F.sha2(F.concat_ws("|", "key", "id", F.col("nth").cast("string")), 256)
    keeps = (F.col("id") != "") & F.col("key").eqNullSafe(F.col("least")) & (F.col("nth") == 1)
    return both.select(*[F.when(keeps, F.col(f"row.`{c}`")).otherwise(fresh).alias(c) if c == column else F.col(f"row.`{c}`") for c in reports.columns])
