"""Tabulation, text lengths, and agreement between raters.

Nulls count as blank texts of length 0, or as not rated; empty tables give the row or the zeros that each function
names; ties and repeated rows count as they are; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.text import word_count


def tabulate(df: DataFrame, columns: Sequence[str], labels: Sequence[str] | None = None, count_col: str = "Count", pct_col: str = "Percentage") -> DataFrame:
    """Category, count and share of all rows: a row for a boolean column, a row for each value of another.

    Boolean columns take one pass together; a column that holds nothing but null, or 0 and 1, counts as boolean.
    """
    labels = list(labels or columns)
    if len(labels) != len(columns):
        raise ValueError("labels and columns differ in number")
    if missing := [c for c in columns if c not in df.columns]:
        raise KeyError(f"unknown columns: {', '.join(missing)}")
    kinds = dict(df.dtypes)
    numeric = [c for c in columns if kinds[c] in ("int", "bigint", "double", "float", "smallint", "tinyint", "void", "string")]
    facts = df.agg(F.count(F.lit(1)).alias("_n"), *[F.coalesce(F.bool_and(F.col(c).cast("string").isin("0", "1", "0.0", "1.0", "true", "false")), F.lit(True)).alias(c) for c in numeric]).first()
    flag = [c for c in columns if kinds[c] == "boolean" or (c in numeric and facts[c])]
    total = F.lit(max(1, facts["_n"]))
    order = {c: k for k, c in enumerate(columns)}
    parts = []
    if flag:
        sums = df.agg(*[F.coalesce(F.sum(F.col(c).cast("string").isin("true", "1", "1.0").cast("int")), F.lit(0)).cast("long").alias(c) for c in flag])
        rows = F.array(*[F.struct(F.lit(order[c]).alias("o"), F.lit(labels[order[c]]).alias("Category"), F.col(c).alias("n")) for c in flag])
        parts.append(sums.select(F.inline(rows)))
    for c in columns:
        if c not in flag:
            name = F.concat(F.lit(f"{labels[order[c]]}: "), F.col(c).cast("string"))
            parts.append(df.where(F.col(c).isNotNull()).groupBy(name.alias("Category")).agg(F.count(F.lit(1)).alias("n")).select(F.lit(order[c]).alias("o"), "Category", "n"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.orderBy("o", F.desc("n"), "Category").select("Category", F.col("n").alias(count_col), (F.col("n") * 100.0 / total).alias(pct_col))


def length_stats(lengths: DataFrame, column: str = "n", threshold: int | None = None) -> DataFrame:
    """One row of exact statistics of a length column; an empty table gives zeros."""
    c = F.col(column)
    zero = lambda x: F.coalesce(x, F.lit(0.0)).cast("double")
    pct = lambda q: zero(F.percentile(c, q))
    aggs = [
        F.count(F.lit(1)).alias("reports"), F.coalesce(F.sum(c), F.lit(0)).cast("long").alias("total"), zero(F.avg(c)).alias("mean"), pct(0.5).alias("median"),
        zero(F.var_pop(c)).alias("variance"), zero(F.stddev_pop(c)).alias("std"), F.coalesce(F.min(c), F.lit(0)).cast("long").alias("min"), F.coalesce(F.max(c), F.lit(0)).cast("long").alias("max"),
        pct(0.25).alias("q1"), pct(0.75).alias("q3"), pct(0.9).alias("p90"), pct(0.95).alias("p95"),
    ]
    if threshold is not None:
        within = c <= threshold
        aggs += [F.coalesce(F.sum(F.when(within, c)), F.lit(0)).cast("long").alias("within_total"), F.coalesce(F.sum(within.cast("int")), F.lit(0)).cast("long").alias("within_reports")]
    out = lengths.agg(*aggs)
    return out.withColumn("range", F.col("max") - F.col("min")).withColumn("iqr", F.col("q3") - F.col("q1"))


def length_table(lengths: DataFrame, threshold: int, step: int = 100, column: str = "n") -> DataFrame:
    """Reports at or below each limit, and their share: limits a step apart, the threshold among them.

    Lengths fall into bins first; a limit's count is the running sum of the bins up to it, made in blocks of bins, so
    that neither the limits nor the bins meet in one task or on the driver. An empty table gives zeros.
    """
    if step <= 0 or threshold < 0:
        raise ValueError("step must be positive and threshold not negative")
    spark = lengths.sparkSession
    start = threshold % step or step
    top = max(lengths.agg(F.max(column)).first()[0] or 0, threshold)
    bins = lengths.where(F.col(column).isNotNull()).groupBy(F.greatest(F.lit(0), F.ceil((F.col(column) - start) / step)).cast("long").alias("k")).agg(F.count(F.lit(1)).alias("n"))
    every = spark.range(0, max(0, -(-(top + step - start) // step))).select(F.col("id").alias("k")).join(bins, "k", "left").select("k", F.floor(F.col("k") / 4096).alias("block"), F.coalesce("n", F.lit(0)).alias("n"))
    blocks = every.groupBy("block").agg(F.sum("n").alias("own"))
    before = blocks.withColumn("before", F.sum("own").over(Window.orderBy("block")) - F.col("own")).select("block", "before")  # a row for 4096 limits
    upto = F.sum("n").over(Window.partitionBy("block").orderBy("k")) + F.col("before")
    rows = every.join(before, "block").select((F.col("k") * step + start).alias("limit"), upto.alias("reports"))
    if threshold == 0:
        rows = rows.unionByName(lengths.agg(F.coalesce(F.sum((F.col(column) <= 0).cast("int")), F.lit(0)).alias("reports")).select(F.lit(0).cast("long").alias("limit"), "reports"))
    total = lengths.count()
    return rows.select("limit", F.col("reports").cast("long").alias("reports"), (F.col("reports") * 100.0 / max(1, total)).cast("double").alias("percent"))


def histogram(lengths: DataFrame, bins: int | str = 20, column: str = "n") -> DataFrame:
    """Counts in equal bins from the least to the greatest length.

    bins "auto": as narrow as the narrower of Sturges' rule and the Freedman-Diaconis rule asks for.
    """
    c = F.col(column)
    low, high, n, q1, q3 = lengths.agg(F.min(c), F.max(c), F.count(c), F.percentile(c, 0.25), F.percentile(c, 0.75)).first()
    if low is None:
        return lengths.sparkSession.createDataFrame([], "bin int, low double, n long")
    if bins == "auto":
        widths = [(high - low) / (math.log2(n) + 1), 2 * (q3 - q1) / n ** (1 / 3)]
        bins = max(1, math.ceil((high - low) / min(w for w in widths if w > 0))) if high > low else 1
    wide = (high - low) / bins or 1.0
    return lengths.where(c.isNotNull()).groupBy(F.least(F.lit(bins - 1), F.floor((c - low) / wide)).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n")).select("bin", (F.lit(float(low)) + F.col("bin") * wide).alias("low"), "n")


def lengths(reports: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``n``: words of the sections together, by row. A report's own column of that name is read, and gives way."""
    return reports.withColumn("n", word_count(F.concat_ws(" ", *[F.col(c) for c in columns])))


def confusion(df: DataFrame, predicted: str, actual: str) -> DataFrame:
    """Accuracy, sensitivity and specificity; null where a denominator is 0."""
    p, a = F.col(predicted), F.col(actual)
    count = lambda c: F.coalesce(F.sum(c.cast("int")), F.lit(0)).cast("double")
    m = df.agg(count(p & a).alias("tp"), count(~p & ~a).alias("tn"), count(p & ~a).alias("fp"), count(~p & a).alias("fn"))
    over = lambda x, y: F.try_divide(x, y)
    tp, tn, fp, fn = (F.col(c) for c in ("tp", "tn", "fp", "fn"))
    return m.select(over(tp + tn, tp + tn + fp + fn).alias("accuracy"), over(tp, tp + fn).alias("sensitivity"), over(tn, tn + fp).alias("specificity"))


def cohen_kappa(df: DataFrame, a: str, b: str) -> DataFrame:
    """Agreement, kappa, z under independence (Fleiss, Cohen and Everitt 1969) and the 95 % interval from it."""
    cells = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(F.col(a).cast("string").alias("x"), F.col(b).cast("string").alias("y")).count()
    return _kappa(cells)


def _kappa(cells: DataFrame) -> DataFrame:
    n = cells.agg(F.sum("count").alias("n"), F.sum(F.when(F.col("x") == F.col("y"), F.col("count"))).alias("same"))
    rows = cells.groupBy(F.col("x").alias("k")).agg(F.sum("count").alias("r"))
    cols = cells.groupBy(F.col("y").alias("k")).agg(F.sum("count").alias("c"))
    both = rows.join(cols, "k", "full").crossJoin(F.broadcast(n))  # one row at the right
    p, q = F.coalesce(F.col("r"), F.lit(0)) / F.col("n"), F.coalesce(F.col("c"), F.lit(0)) / F.col("n")
    sums = both.agg(F.max("n").alias("n"), F.coalesce(F.max("same"), F.lit(0)).alias("same"), F.sum(p * q).alias("pe"), F.sum(p * q * (p + q)).alias("s"))
    po, pe = F.col("same") / F.col("n"), F.col("pe")
    k = F.try_divide(po - pe, 1 - pe)
    se = F.try_divide(F.sqrt(F.greatest(F.lit(0.0), pe + pe * pe - F.col("s"))), (1 - pe) * F.sqrt("n"))
    return sums.select(po.alias("agreement"), k.alias("kappa"), F.try_divide(k, se).alias("z"), (k - 1.96 * se).alias("low"), (k + 1.96 * se).alias("high"))


def fleiss_kappa(df: DataFrame, raters: Sequence[str]) -> DataFrame:
    """Fleiss' kappa of rows that all raters have rated, its z and 95 % interval (Fleiss, Nee and Landis 1979)."""
    m = len(raters)
    votes = df.dropna(subset=list(raters)).select(F.array(*[F.col(r).cast("string") for r in raters]).alias("v"))
    # The sum of squared counts of a row's categories is the sum, over its votes, of how many agree with each.
    agree = F.aggregate(F.transform("v", lambda x: F.size(F.filter("v", lambda y: y == x))), F.lit(0), lambda a, x: a + x)
    p_i = votes.select(((agree - m) / (m * (m - 1))).alias("p")).agg(F.avg("p").alias("po"), F.count(F.lit(1)).alias("items"))
    counted = votes.select(F.explode("v").alias("k")).groupBy("k").count()
    total = counted.agg(F.sum("count").alias("t"))
    share = counted.crossJoin(F.broadcast(total)).select((F.col("count") / F.col("t")).alias("p"))  # one row at the right
    p, q = F.col("p"), 1 - F.col("p")
    p_k = share.agg(F.sum(p * p).alias("pe"), F.sum(p * q).alias("pq"), F.sum(p * q * (q - p)).alias("skew"))
    both = p_i.crossJoin(F.broadcast(p_k))  # one row each
    kappa = F.try_divide(F.col("po") - F.col("pe"), 1 - F.col("pe"))
    spread = F.col("pq") * F.col("pq") - F.col("skew")
    se = F.sqrt(F.try_divide(F.lit(2.0) * F.greatest(F.lit(0.0), spread), F.col("pq") * F.col("pq") * F.col("items") * (m * (m - 1))))
    return both.select("items", F.col("po").alias("agreement"), kappa.alias("kappa"), F.try_divide(kappa, se).alias("z"), (kappa - 1.96 * se).alias("low"), (kappa + 1.96 * se).alias("high"))


def windows(df: DataFrame, day: Column, start: str, end: str) -> DataFrame:
    """Rows before, within and after a period, and with no valid date."""
    where = F.when(day.isNull(), "invalid").when(day < F.lit(start).cast("date"), "before").when(day > F.lit(end).cast("date"), "after").otherwise("within")
    return df.select(where.alias("window")).groupBy("window").agg(F.count(F.lit(1)).alias("n"))
