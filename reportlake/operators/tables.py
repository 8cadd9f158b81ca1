"""Refreshing, comparing, excluding and restoring rows; top-up; sampling.

Null is blank where values are compared; a null key matches no row and so counts as new; rows that repeat a key are
kept as they are, but that new rows come in once for each key; empty tables give empty results or zeros; extra
columns are kept.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.text import identifier
from ..storage import stored
from .rows import fields_of, name_of, whole


def replace_columns(old: DataFrame, new: DataFrame, fields: Sequence[str], key: str = "url") -> DataFrame:
    """Columns taken from another table by key (null where it has no row); column order stays."""
    return old.drop(*fields).join(new.select(key, *fields), key, "left").select(*old.columns)


def refresh_columns(old: DataFrame, new: DataFrame, fields: Sequence[str], key: str = "url") -> DataFrame:
    """Like replace_columns, but what the other table lacks stays as it is."""
    fresh = new.select(F.col(name_of(key)).alias("key"), F.struct(*[F.col(name_of(f)) for f in fields]).alias("fresh"))
    both = whole(old).join(fresh, F.col(f"row.{name_of(key)}") == F.col("key"), "left")
    return both.select(*[F.coalesce(F.col(f"fresh.{name_of(c)}"), F.col(f"row.{name_of(c)}")).alias(c) if c in fields else F.col(f"row.{name_of(c)}").alias(c) for c in old.columns])


def changes(old: DataFrame, new: DataFrame, fields: Sequence[str], key: str = "url") -> DataFrame:
    """One row: keys in both tables, and changed rows by field (null is blank)."""
    both = old.select(key, *[F.col(f).alias(f"o_{f}") for f in fields]).join(new.select(key, *[F.col(f).alias(f"n_{f}") for f in fields]), key)
    differs = lambda f: F.coalesce(F.col(f"o_{f}").cast("string"), F.lit("")) != F.coalesce(F.col(f"n_{f}").cast("string"), F.lit(""))
    return both.agg(F.count(F.lit(1)).alias("rows"), *[F.coalesce(F.sum(differs(f).cast("long")), F.lit(0)).cast("long").alias(f"changed_{f}") for f in fields])


def audit(old: DataFrame, raw: DataFrame, new: DataFrame, field: str, key: str = "url") -> DataFrame:
    """old, raw and new value of a field side by side, for rows that changed."""
    three = old.select(key, F.col(field).alias("old")).join(raw.select(key, F.col(field).alias("raw")), key, "left").join(new.select(key, F.col(field).alias("new")), key, "left")
    return three.where(~F.col("old").eqNullSafe(F.col("new")))


def new_rows(seen: DataFrame, found: DataFrame, key: str = "url") -> DataFrame:
    """Rows whose key is not there yet, one for each key."""
    return found.dropDuplicates([key]).join(seen.select(key), key, "left_anti")


def top_up(base: DataFrame, found: DataFrame, key: str = "url") -> DataFrame:
    return base.unionByName(new_rows(base, found, key), allowMissingColumns=True)


def exclude(active: DataFrame, excluded: DataFrame | None, keys: DataFrame, reason: str, key: str = "report_id") -> tuple[DataFrame, DataFrame]:
    """Rows moved out with a reason; an earlier entry of the same row is replaced."""
    out = active.join(keys.select(key).distinct(), key, "left_semi").withColumn("reason", F.lit(reason))
    before = excluded.join(out.select(key), key, "left_anti") if excluded is not None else None
    return active.join(keys.select(key), key, "left_anti"), (before.unionByName(out, allowMissingColumns=True) if before is not None else out)


def restore(active: DataFrame, excluded: DataFrame, keys: DataFrame, key: str = "report_id") -> tuple[DataFrame, DataFrame]:
    """Rows moved back, unless their key is active already."""
    back = excluded.join(keys.select(key).distinct(), key, "left_semi")
    fresh = back.join(active.select(key), key, "left_anti").drop("reason")
    return active.unionByName(fresh, allowMissingColumns=True), excluded.join(keys.select(key), key, "left_anti")


def signature(df: DataFrame, columns: Sequence[str], key: str) -> DataFrame:
    """SHA-256 over sorted row digests' sums: the same for any order of rows."""
    row = F.sha2(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("∅")) for c in [key, *columns]]), 256)
    part = lambda k: F.sum(F.conv(F.substr(row, F.lit(1 + 12 * k), F.lit(12)), 16, 10).cast("decimal(38,0)")).cast("string")
    return df.agg(F.count(F.lit(1)).cast("string").alias("n"), *[part(k).alias(f"p{k}") for k in range(4)]).select(F.sha2(F.concat_ws("|", "n", "p0", "p1", "p2", "p3"), 256).alias("signature"))


def allocation(strata: DataFrame, size: int, column: str = "year") -> list[tuple[int, int, int]]:
    """(stratum, rows, take): proportional, one each at least, trimmed in turn to the size.

    With more strata than the size the smallest strata give way.
    """
    counts = sorted((r[column], r["count"]) for r in strata.groupBy(column).count().collect())  # a row for each stratum
    total = sum(n for _, n in counts)
    take = [min(n, max(1, round(size * n / total))) for _, n in counts]
    while sum(take) > size and any(x > 1 for x in take):
        for k, x in enumerate(take):
            if sum(take) > size and x > 1:
                take[k] = x - 1
    for k in sorted(range(len(take)), key=lambda k: counts[k][1])[: max(0, sum(take) - size)]:
        take[k] = 0
    room = size - sum(take)
    for k, (_, n) in enumerate(counts):
        more = min(room, n - take[k])
        take[k], room = take[k] + more, room - more
    return [(s, n, t) for (s, n), t in zip(counts, take, strict=True)]


def stratified_sample(df: DataFrame, size: int, seed: int = 67, day: str = "date", key: str = "report_id") -> DataFrame:
    """A sample by year (none is -1) in proportion, rows picked by a seeded hash: the same on any cluster.

    Picked among years, keys and hashes alone, below a threshold of the hash that leaves a few more than wanted (raised
    where it left too few); rows come by a semi-join with the picked keys. Of rows that share a key all or some come.
    """
    if size <= 0:
        return df
    narrow = stored(df.select(F.coalesce(F.year(day), F.lit(-1)).alias("y"), F.xxhash64(key, F.lit(seed)).alias("h"), F.col(key).alias("id")), "sample-keys")
    plan = allocation(narrow.select(F.col("y").alias("year")), size)
    if not plan:
        return df.limit(0)
    room = 2.0**64
    # A year's share of hashes, with a margin of ten standard deviations: fewer than wanted come with no chance to speak of.
    cuts = [(s, t, -(2.0**63) + room * min(1.0, (t + 10 * t**0.5 + 20) / n)) for s, n, t in plan]
    share = df.sparkSession.createDataFrame(cuts, "y int, take int, cut double")  # a row for each year
    for cut in (F.col("h").cast("double") <= F.col("cut"), F.lit(True)):
        few = narrow.join(F.broadcast(share), "y").where(cut).withColumn("salt", F.pmod("h", F.lit(64)))
        # First within shares of a year, then among what those leave: no task sorts a year whole.
        for by in (["y", "salt"], ["y"]):
            few = few.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy("h", "id"))).where("place <= take")
        few = stored(few.select("id", "h"), "sample")
        if few.count() == sum(t for _, _, t in plan):
            break
    picked = few.groupBy("id").agg(F.count(F.lit(1)).alias("many"))
    both = whole(df).join(F.broadcast(picked), F.col(f"row.{name_of(key)}").eqNullSafe(F.col("id")))  # size rows at most
    nth = both.withColumn("nth", F.row_number().over(Window.partitionBy("id").orderBy(F.xxhash64("row"))))
    return nth.where("nth <= many").select(*fields_of(df))


def decoys(df: DataFrame, flag: str, n: int = 73, seed: int = 1, key: str = "report_id") -> DataFrame:
    """All positives, and n seeded negatives."""
    negative = df.where(~F.coalesce(F.col(flag), F.lit(False))).orderBy(F.xxhash64(key, F.lit(seed)), key).limit(n)
    return df.where(F.col(flag)).unionByName(negative)


def changed_rows(df: DataFrame, before: str, after: str) -> DataFrame:
    """One row: how many rows differ between two columns (null is blank), and how many there are."""
    differs = F.coalesce(F.col(before).cast("string"), F.lit("")) != F.coalesce(F.col(after).cast("string"), F.lit(""))
    return df.agg(F.coalesce(F.sum(differs.cast("long")), F.lit(0)).cast("long").alias("changed"), F.count(F.lit(1)).alias("n"))


def any_null(columns: Sequence[str]):
    return reduce(lambda a, b: a | b, [F.col(c).isNull() for c in columns])


def batches(items: Sequence[str], size: int) -> list[list[str]]:
    return [list(items[i : i + size]) for i in range(0, len(items), size)]


def index_column(spec: Column) -> Column:
    """'2,5-7' as the array 2, 5, 6, 7, each once, in order; null for null. The same as index_ranges, for columns."""
    parts = F.filter(F.transform(F.split(spec, ","), lambda x: F.trim(x)), lambda x: x != "")
    ends = lambda x: F.transform(F.split(x, "-"), lambda y: F.trim(y).cast("int"))
    return F.array_distinct(F.flatten(F.transform(parts, lambda x: F.sequence(F.get(ends(x), F.lit(0)), F.try_element_at(ends(x), F.lit(-1))))))


def unique_names(df: DataFrame, column: str, name: str = "name", prefix: str = "theme_") -> DataFrame:
    """``name``: a safe identifier of a text column, repeated ones with _2, _3 and so on in order of the text.

    For a dimension such as themes: rows of one identifier meet in one task.
    """
    safe = identifier(F.col(column), prefix)
    nth = F.row_number().over(Window.partitionBy(safe).orderBy(F.col(column)))
    return df.withColumn(name, F.when(nth > 1, F.concat(safe, F.lit("_"), nth.cast("string"))).otherwise(safe))


def index_ranges(spec: str) -> list[int]:
    """'2,5-7' as 2, 5, 6, 7, each once, in order."""
    out: dict[int, None] = {}
    for part in filter(None, (p.strip() for p in spec.split(","))):
        low, _, high = part.partition("-")
        first, last = int(low), int(high or low)
        if first > last:
            raise ValueError(f"the range {part} runs backwards")
        out.update(dict.fromkeys(range(first, last + 1)))
    return list(out)
