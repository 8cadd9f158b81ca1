"""Canonical areas: exact lookup by precedence, and a fuzzy best match.

A null area, or one of no letter or digit that no alias is, is 'Other'; repeated reports are matched alike; of equally good
aliases the one with another just as good is none; empty tables give empty results, an empty alias table 'Other' throughout; the
report's own columns are kept whatever their names, but those named as the four of the result give way to them.
"""

from __future__ import annotations

from collections.abc import Iterator
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.text import match_key
from ..storage import stored
from .rows import fields_of, whole

#: Least similarity of the best candidate, and how far the second must be behind.
LEAST, MARGIN = 0.88, 0.03
STRATEGIES = ("exact_only", "exact_then_fuzzy", "fuzzy_only")


def lookup(areas: DataFrame) -> DataFrame:
    """One row for each key and spelling from a dimension table (alias, canonical, kind: allowed, synonym, legacy)."""
    rank = {"synonym": 0, "legacy": 1, "allowed": 2}
    order = F.coalesce(*[F.when(F.col("kind") == k, F.lit(r)) for k, r in rank.items()])
    raw = areas.select(F.trim("alias").alias("key"), order.alias("place"), "canonical", F.concat(F.lit("raw_"), "kind").alias("method"), F.lit(True).alias("raw"))
    keyed = areas.select(match_key(F.col("alias")).alias("key"), (order + 3).alias("place"), "canonical", F.concat(F.lit("normalised_"), "kind").alias("method"), F.lit(False).alias("raw"))
    return raw.unionByName(keyed).groupBy("key", "raw").agg(F.min(F.struct("place", "canonical", "method")).alias("hit")).select("key", "raw", "hit.*")


def match_areas(reports: DataFrame, areas: DataFrame, column: str = "area", strategy: str = "exact_then_fuzzy") -> DataFrame:
    """area_canonical ('Other' if none), match_method, match_score, matched_value for each row.

    Only the distinct area values meet the table, so the fuzzy step is a small job whatever the reports' number.
    """
    if strategy not in STRATEGIES:
        raise ValueError(f"strategy must be one of {', '.join(STRATEGIES)}")
    table = lookup(areas)
    values = reports.select(F.col(f"`{column}`").alias("value")).where("value is not null").distinct()
    by_raw = table.where("raw").select(F.col("key").alias("k1"), F.struct("place", "canonical", "method", F.col("key").alias("matched")).alias("h1"))
    by_key = table.where("not raw").select(F.col("key").alias("k2"), F.struct("place", "canonical", "method", F.col("key").alias("matched")).alias("h2"))
    exact = (
        values.join(by_raw, F.trim("value") == F.col("k1"), "left").join(by_key, match_key(F.col("value")) == F.col("k2"), "left")
        .withColumn("hit", F.coalesce("h1", "h2")).select("value", "hit")
    )
    one = exact.where("hit is not null").select("value", "hit.canonical", "hit.method", F.lit(1.0).alias("score"), "hit.matched")
    parts = [one] if strategy != "fuzzy_only" else []
    if strategy != "exact_only":
        left = exact.where("hit is null").select("value") if strategy == "exact_then_fuzzy" else values
        parts.append(fuzzy(left, areas))
    found = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    # The report goes as one struct, so that none of its columns is meant by another's name.
    hits = found.select("value", F.struct("canonical", "method", "score", "matched").alias("hit"))
    joined = whole(reports).join(hits, F.col(f"row.`{column}`") == F.col("value"), "left")
    made = {
        "area_canonical": F.coalesce("hit.canonical", F.lit("Other")), "match_method": F.coalesce("hit.method", F.lit("none")),
        "match_score": F.col("hit.score"), "matched_value": F.col("hit.matched"),
    }
    return joined.select(*fields_of(reports, without=made), *[c.alias(name) for name, c in made.items()])


def bigrams(key: Column) -> Column:
    """Letter pairs of a key with the number of their occurrence: 'banana' as ba1, an1, na1, an2, na2."""
    pairs = F.transform(F.sequence(F.lit(1), F.length(key) - 1), lambda i: F.substr(key, i, F.lit(2)))
    nth = F.transform(pairs, lambda p, i: F.concat(p, F.size(F.filter(F.slice(pairs, F.lit(1), i + 1), lambda q: q == p)).cast("string")))
    return F.when(F.length(key) > 1, nth).otherwise(F.array().cast("array<string>"))


def candidates(values: DataFrame, known: DataFrame) -> DataFrame:
    """(key, alias key) pairs whose similarity can be above the floor; both sides: a column ``key`` of distinct keys.

    With M letters in matching blocks of keys of n and m letters, similarity is 2 * M / (n + m). The n - M letters outside
    take away two pairs of letters each at most, and the m - M put between take one, so at least 3 * M - n - m - 1 pairs
    are shared; with the floor f that is (1.5 * f - 1) * (n + m) - 1, and m is at least n * f / (2 - f). So many of a key's pairs must be
    shared that one of its rarest few is: those alone are joined. Rare first is by their number in the alias table.
    Keys under three letters can only be equal to be similar enough, and meet as such.
    """
    floor = LEAST - MARGIN
    need = F.greatest(F.lit(1), F.ceil((1.5 * floor - 1) * (F.length("key") * (2 / (2 - floor))) - 1 - 1e-6))
    counts = known.select(F.explode(bigrams(F.col("key"))).alias("pair")).groupBy("pair").agg(F.count(F.lit(1)).alias("n"))

    def rarest(df: DataFrame, name: str) -> DataFrame:
        pairs = df.where(F.length("key") > 2).select("key", need.alias("need"), F.explode(bigrams(F.col("key"))).alias("pair"))
        ranked = pairs.join(counts, "pair", "left").groupBy("key", "need").agg(F.sort_array(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "pair"))).alias("p"))
        kept = F.slice("p", F.lit(1), F.greatest(F.lit(1), F.size("p") - F.col("need") + 1).cast("int"))
        return ranked.select(F.col("key").alias(name), F.explode(kept.getField("pair")).alias("pair"))

    short, long = 2 / (2 - floor) - 1, (2 - floor) / floor  # of lengths
    fits = F.length("alias").between(F.length("key") * short, F.length("key") * long)
    met = rarest(values, "key").join(rarest(known, "alias"), "pair").where(fits).select("key", "alias").distinct()
    equal = values.where(F.length("key") < 3).join(known.select("key"), "key", "left_semi").select("key", F.col("key").alias("alias"))
    return met.unionByName(equal)


def fuzzy(values: DataFrame, areas: DataFrame) -> DataFrame:
    """Ratcliff-Obershelp best match of each value among the aliases, if good enough and clearly ahead.

    Values meet the aliases of candidates(); the similarity itself is taken of these alone, and the best two of a value
    are ranked. Rows of the alias table that share a key are candidates each. No table is sent to all tasks.
    """
    floor = LEAST - MARGIN
    keyed = stored(values.select("value", match_key(F.col("value")).alias("key")).where("key <> ''"), "fuzzy-values")
    known = stored(areas.select(match_key(F.col("alias")).alias("key"), "canonical").where("key <> ''"), "fuzzy-aliases")

    def similar(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for key, alias in zip(f["key"], f["alias"], strict=True):
                m = SequenceMatcher(None, key, alias)
                if m.quick_ratio() > floor and (r := m.ratio()) > floor:
                    rows.append((key, alias, r))
            yield pd.DataFrame(rows, columns=["key", "alias", "score"])

    pairs = candidates(keyed.select("key").distinct(), known.select("key").distinct()).repartition("key", "alias")
    scored = pairs.mapInPandas(similar, "key string, alias string, score double").join(known.withColumnRenamed("key", "alias"), "alias")
    order = Window.partitionBy("key").orderBy(F.desc("score"), "alias", "canonical")
    best = scored.withColumn("place", F.row_number().over(order)).where("place <= 2")
    two = best.groupBy("key").agg(F.min_by(F.struct("canonical", "alias", "score"), "place").alias("one"), F.max(F.when(F.col("place") == 2, F.col("score"))).alias("second"))
    good = two.where((F.col("one.score") >= LEAST) & (F.col("second").isNull() | (F.col("one.score") - F.col("second") >= MARGIN)))
    return keyed.join(good, "key").select("value", F.col("one.canonical").alias("canonical"), F.lit("fuzzy").alias("method"), F.col("one.score").alias("score"), F.col("one.alias").alias("matched"))
