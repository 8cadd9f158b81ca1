"""Rule tags of receivers and areas, driven by rule tables.

A null or blank receiver or area meets no rule; repeated rows are tagged alike; an empty table stays empty; other
columns are kept.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import vocabulary as V
from ..functions.text import let, lit_array, match_key, receivers, segment_key


def rule(keys: Column, spec: dict) -> Column:
    """Whether any of some segment keys (segment_key) meets a rule (see vocabulary.TAG_RULES)."""

    def segment(padded: Column) -> Column:
        key = F.trim(padded)
        found = [F.exists(lit_array(spec["contains"]), lambda p: F.contains(padded, p))] if spec.get("contains") else []
        found += [key.startswith(p) for p in spec.get("startswith", ())]
        for p in spec.get("endswith", ()):
            clear = [~F.contains(key, F.lit(x)) for x in spec.get("unless", ())]
            found.append(reduce(lambda a, b: a & b, clear, F.endswith(key, F.lit(p))))
        return reduce(lambda a, b: a | b, found, F.lit(False))

    return F.coalesce(F.exists(keys, segment), F.lit(False))


def rules_met(receiver: Column, rules: dict[str, dict]) -> Column:
    """A struct of booleans, one for each rule, from segment keys that are made once."""
    return let(F.transform(receivers(receiver), segment_key), lambda keys: F.struct(*[rule(keys, spec).alias(name) for name, spec in rules.items()]))


def tag_collections(
    reports: DataFrame, rules: dict[str, dict] = V.TAG_RULES, areas: DataFrame | None = None, area_tag: str = "theme_welsh",
    row_mask: Column | None = None, receiver_column: str = "receiver", area_column: str = "area",
) -> DataFrame:
    """Tag columns by rule; rows outside row_mask keep what they have. areas: a column ``area`` of names that tag."""
    out = reports

    def put(df: DataFrame, name: str, value: Column) -> DataFrame:
        old = F.col(name) if name in df.columns else F.lit(None).cast("boolean")
        return df.withColumn(name, value if row_mask is None else F.when(row_mask, value).otherwise(old))

    if rules:
        # A name of its own, so that no column of the input is meant.
        met = "rules met " + " ".join(sorted(reports.columns))
        out = out.withColumn(met, rules_met(F.col(receiver_column), rules))
        for name in rules:
            out = put(out, name, F.col(f"`{met}`.`{name}`"))
        out = out.drop(met)
    if areas is not None:
        # Names of their own again.
        key, hit = (f"{x} of tagged areas {' '.join(sorted(out.columns))}" for x in ("key", "hit"))
        keys = areas.select(match_key(F.col("area")).alias(key), F.lit(True).alias(hit)).where(F.col(f"`{key}`") != "").distinct()
        met = out.join(keys, match_key(F.col(f"`{area_column}`")) == F.col(f"`{key}`"), "left")
        out = put(met, area_tag, F.coalesce(F.col(f"`{hit}`"), F.lit(False))).drop(key, hit)
    return out


def pending(reports: DataFrame, columns: list[str], recompute_all: bool = False) -> Column:
    """Mask of rows to tag: any of the columns null, or all rows where one is missing."""
    if recompute_all or any(c not in reports.columns for c in columns):
        return F.lit(True)
    return reduce(lambda a, b: a | b, [F.col(c).isNull() for c in columns])
