"""Lexical ranked search, generated from the query as column expressions.

Null and blank fields hold nothing; a query of no letter or digit finds nothing; repeated reports are found as often as
they are there, equal scores by date, newest first; empty tables give no rows; other columns are kept, and one of the
input that is called ``score`` gives way to the result's.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import vocabulary as V
from ..functions.text import ENDINGS, let, search_text, stem_word


def query_terms(query: str, stop_words=V.STOP_WORDS) -> tuple[str, list[str], list[str]]:
    """Normal form of a query, its words (repeats kept), its distinct stems."""
    plain = re.sub(r"[^a-z0-9]+", " ", re.sub("[’']", "", query.strip().lower())).strip()
    every = plain.split()
    chosen = [w for w in every if len(w) > 1 and w not in set(stop_words)] or every
    return plain, chosen, list(dict.fromkeys(stem_word(w) for w in chosen))


def least_score(stems: list[str]) -> float:
    return V.LEAST_SCORES[min(3, max(1, len(stems)))]


def forms(of: str) -> list[str]:
    """All words whose stem is a given one: itself, with one of the endings, or 'ies' for its 'y'."""
    tried = [of, *[of + e for e in ENDINGS], *([of[:-1] + "ies"] if of.endswith("y") else [])]
    return [w for w in tried if stem_word(w) == of]


def score(columns: Sequence[str], query: str, fields: dict[str, int] = V.SEARCH_FIELDS) -> Column:
    """A report's score: phrase 6, word 2.5 and stem 1 times the field's weight, 10 for all stems.

    Words are looked for as letters between blanks in a field's normal form, and a stem as any of the few words that have
    it, so that no text is taken apart. A row in which no stem of the query occurs as letters scores nothing and is
    not brought into normal form: every word that a stem stands for begins with it, but for its last letter where that is a y.
    """
    plain, tokens, stems = query_terms(query)
    present = {f: w for f, w in fields.items() if f in columns}
    if not stems or not present:
        return F.lit(0.0)
    one = lambda c, x: F.when(c, F.lit(float(x))).otherwise(0.0)
    add = lambda xs: reduce(lambda a, b: a + b, xs, F.lit(0.0))
    any_of = lambda xs: reduce(lambda a, b: a | b, xs)
    least = 1 if len(stems) <= 2 else 2

    def facts(padded: Column) -> Column:
        """padded: a field's normal form with a blank at either end."""
        word = lambda w: F.contains(padded, F.lit(f" {w} "))
        return F.array(F.contains(padded, F.lit(plain)), *[word(t) for t in tokens], *[any_of([word(w) for w in forms(s)]) for s in stems])

    def total(found: Column) -> Column:
        """found: facts of each field, in order."""
        of = [F.get(found, F.lit(k)) for k in range(len(present))]
        fact = lambda f, k: F.get(f, F.lit(k))
        weights = [6.0, *[2.5] * len(tokens), *[1.0] * len(stems)]
        points = [one(fact(f, k), w * x) for f, w in zip(of, present.values(), strict=True) for k, x in enumerate(weights)]
        met = add([one(any_of([fact(f, 1 + len(tokens) + k) for f in of]), 1) for k in range(len(stems))])
        return let(met, lambda m: F.when((m >= least) | any_of([fact(f, 0) for f in of]), add(points) + one(m == len(stems), 10)).otherwise(0.0))

    letters = [s[:-1] if s.endswith("y") and len(s) > 3 else s for s in stems]
    raw = F.lower(F.concat_ws(" ", *[F.translate(F.col(f).cast("string"), "'’", "") for f in present]))
    maybe = any_of([F.contains(raw, F.lit(x)) for x in letters])
    padded = lambda f: F.concat(F.lit(" "), search_text(F.col(f).cast("string")), F.lit(" "))
    return F.when(maybe, let(F.array(*[let(padded(f), facts) for f in present]), total)).otherwise(0.0)


def scored(reports: DataFrame, query: str, fields: dict[str, int] = V.SEARCH_FIELDS) -> DataFrame:
    """Reports with their score."""
    return reports.withColumn("score", score(reports.columns, query, fields))


def search(reports: DataFrame, query: str) -> DataFrame:
    """Reports at or above the least score, best first, newest first among equals."""
    _, _, stems = query_terms(query)
    kept = [F.col(f"`{c}`") for c in reports.columns if c != "score"]
    if not stems:
        return reports.select(*kept, F.lit(0.0).alias("score")).where("false")
    last = [c for c in ("report_id", "url", "id") if c in reports.columns]
    # A generator, unlike a filter, is not pushed below the score, which is then computed once.
    good = F.explode(F.filter(F.array(score(reports.columns, query)), lambda x: x >= least_score(stems)))
    return reports.select(*kept, good.alias("score")).orderBy(F.desc("score"), F.desc_nulls_last("date"), *last)
