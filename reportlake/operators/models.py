"""Text-model operators: screening, feature extraction, summaries, theme discovery, cleaning.

A model is any object with ``generate(prompts: list[str], schema: dict | None) -> list[str]`` that can be pickled.
Prompts are column expressions; distinct prompts that the cache lacks meet the model in mapInPandas, a few at a
time, with retries; replies are written to the shared folder, so no later action calls the model again.

Cases: null sections are left out of a prompt, and a report of nothing but nulls has an empty one; reports with equal
prompts are asked once and have equal replies, repeated rows too; an empty table asks nothing; all other columns are kept, whatever
their names; a column named as a result's gives way to it.
"""

from __future__ import annotations

import copy
import json
import random
import re
import threading
import time
import urllib.error
import urllib.request
import warnings
from collections.abc import Callable, Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from typing import Any, Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions.text import first_words, labelled, repaired_json, word_count
from ..storage import small_batches, stored
from .rows import fields_of, name_of, whole

SECTIONS = ("investigation", "circumstances", "concerns")


class TextModel(Protocol):
    def generate(self, prompts: list[str], schema: dict | None = None) -> list[str]: ...


@dataclass
class KeywordModel:
    """Deterministic stand-in: Yes where a prompt's text holds a keyword; canned fields for structured replies."""

    keyword: str = ""
    fields: dict[str, Any] = field(default_factory=dict)

    def generate(self, prompts: list[str], schema: dict | None = None) -> list[str]:
        out = []
        for p in prompts:
            body = p.split("\n\n", 1)[-1]
            if schema is not None:
                out.append(json.dumps({k: self.fields.get(k, body.split()[0] if body.split() else None) for k in schema}))
            elif self.keyword:
                out.append("Yes" if self.keyword.lower() in body.lower() else "No")
            else:
                out.append(body.upper())
        return out


class ChatModel:
    """A model behind an HTTP endpoint of the usual chat form, several prompts at a time, replies in order.

    post: (url, headers, body) to the reply's JSON; the default uses the standard library. Rate limits and failed
    connections are tried again by with_retries. ``workers`` bounds the calls of one task, ask(partitions) the tasks.
    """

    def __init__(self, url: str, model: str, key: str | None = None, workers: int = 8, temperature: float = 0.0, seed: int | None = None, timeout: float = 120, post: Callable | None = None):
        self.url, self.model, self.key, self.workers = url, model, key, max(1, workers)
        self.temperature, self.seed, self.timeout, self.post = float(temperature), seed, timeout, post

    def generate(self, prompts: list[str], schema: dict | None = None) -> list[str]:
        with ThreadPoolExecutor(self.workers) as pool:
            return list(pool.map(lambda p: with_retries(lambda: self._one(p, schema)), prompts))

    def _one(self, prompt: str, schema: dict | None) -> str:
        body = {"model": self.model, "temperature": self.temperature, "messages": [{"role": "user", "content": prompt}]}
        if self.seed is not None:
            body["seed"] = self.seed
        if schema is not None:
            body["response_format"] = {"type": "json_object"}
        headers = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {self.key}"} if self.key else {})
        return (self.post or self._post)(f"{self.url.rstrip('/')}/chat/completions", headers, body)["choices"][0]["message"]["content"]

    def _post(self, url: str, headers: dict, body: dict) -> dict:
        request = urllib.request.Request(url, json.dumps(body).encode(), headers)
        try:
            with urllib.request.urlopen(request, timeout=self.timeout) as r:  # noqa: S310 - the caller's endpoint
                return json.load(r)
        except urllib.error.HTTPError as e:
            if e.code in (429, 502, 503, 504):
                raise Transient(str(e)) from e
            raise
        except (urllib.error.URLError, TimeoutError) as e:
            raise Transient(str(e)) from e


class Transient(Exception):
    """A failure worth another try: rate limit, connection, time-out."""


def with_retries(call: Callable[[], Any], longest: float = 60.0, base: float = 1.0) -> Any:
    """Exponential back-off with full jitter, no more than ``longest`` seconds in all."""
    waited, k = 0.0, 0
    while True:
        try:
            return call()
        except Transient:
            pause = random.uniform(0, base * 2**k)  # noqa: S311
            if waited + pause > longest:
                raise
            time.sleep(pause)
            waited, k = waited + pause, k + 1


def ask(prompts: DataFrame, model: TextModel, schema: dict | None = None, batch: int = 64, attempts: int = 2, partitions: int | None = None, calls: int | None = None, progress: Callable[[int], None] | None = None) -> DataFrame:
    """(prompt_sha, reply, error) of the distinct prompts of a ``prompt`` column. Written once, read often.

    calls bounds the requests in flight over all tasks of the cluster: there are as many tasks as that at most, and a
    model with ``workers`` gets its task's share of them, so that tasks times workers stays within (each attempt that Spark
    runs twice counts twice). partitions bounds the tasks alone. A reply that is no object of the schema is asked
    again, ``attempts`` times; what fails in the end has an error and no reply. progress: called on the driver with
    the number of prompts done, every second and at the end.
    """
    if calls is not None:
        if calls < 1:
            raise ValueError("calls must be positive")
        partitions = min(calls, partitions or prompts.sparkSession.sparkContext.defaultParallelism)
        if hasattr(model, "workers"):
            model = copy.copy(model)
            model.workers = max(1, min(model.workers, calls // partitions))
    done = prompts.sparkSession.sparkContext.accumulator(0)

    def valid(reply: str) -> bool:
        if schema is None:
            return True
        try:
            return isinstance(json.loads(reply), dict)
        except ValueError:
            return False

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for lo in range(0, len(f), batch):
                some = f.iloc[lo : lo + batch]
                texts = some["prompt"].tolist()
                replies: list[str | None] = [None] * len(texts)
                error: list[str | None] = [None] * len(texts)
                left = list(range(len(texts)))
                for _ in range(attempts):
                    if not left:
                        break
                    try:
                        got = with_retries(lambda left=left: model.generate([texts[k] for k in left], schema))
                    except Exception as e:  # noqa: BLE001 - becomes the row's error
                        for k in left:
                            error[k] = f"Error: {e}"
                        break
                    for k, r in zip(left, got, strict=True):
                        replies[k], error[k] = (r, None) if valid(r) else (None, f"Error: not an object: {r[:200]}")
                    left = [k for k in left if error[k]]
                done.add(len(texts))
                yield pd.DataFrame({"prompt_sha": some["prompt_sha"], "reply": replies, "error": error})

    distinct = prompts.where("prompt is not null").select(F.sha2("prompt", 256).alias("prompt_sha"), "prompt").dropDuplicates(["prompt_sha"])
    if partitions:
        distinct = distinct.repartition(partitions)
    replies = distinct.mapInPandas(run, "prompt_sha string, reply string, error string")
    if progress is None:
        with small_batches(prompts.sparkSession):
            return stored(replies, "replies")
    over = threading.Event()

    def tell() -> None:
        while not over.wait(1.0):
            progress(done.value)

    teller = threading.Thread(target=tell, daemon=True)
    teller.start()
    try:
        with small_batches(prompts.sparkSession):
            return stored(replies, "replies")
    finally:
        over.set()
        teller.join()
        progress(done.value)


def answered(prompted: DataFrame, replies: DataFrame) -> DataFrame:
    """prompted (row, prompt and what else it has) with ``reply`` and ``error``, null where nothing was asked."""
    return prompted.withColumn("prompt_sha", F.sha2("prompt", 256)).join(replies, "prompt_sha", "left")


class Cache:
    """Replies by prompt digest, on Parquet; written together once in ``gather`` calls, so that plans stay short."""

    gather = 8

    def __init__(self, known: DataFrame | None = None):
        self.known = known

    def answer(self, prompts: DataFrame, model: TextModel, schema: dict | None = None, **options) -> DataFrame:
        keyed = prompts.where("prompt is not null").withColumn("prompt_sha", F.sha2("prompt", 256))
        missing = keyed.join(self.known.select("prompt_sha"), "prompt_sha", "left_anti") if self.known is not None else keyed
        fresh = ask(missing.select("prompt"), model, schema, **options)
        good = fresh.where("error is null")
        both = self.known.unionByName(good) if self.known is not None else good
        # Whatever is asked twice is held once; errors are not held, so they are asked again.
        self.calls = getattr(self, "calls", 0) + 1
        self.known = stored(both, "replies") if self.calls % self.gather == 0 else both
        return self.known.unionByName(fresh.where("error is not null"))

    def export(self, path: str) -> None:
        if self.known is None:
            raise ValueError("the cache is empty")
        self.known.write.mode("overwrite").parquet(path)

    @classmethod
    def load(cls, spark, path: str) -> Cache:
        return cls(spark.read.parquet(path))


def report_text(columns: Sequence[str], collapse: bool = True) -> Column:
    """'Label: value' text of sections, labels from the column names."""
    text = labelled([(c.replace("_", " ").capitalize(), F.col(c).cast("string")) for c in columns])
    return F.trim(F.regexp_replace(text, r"\s+", " ")) if collapse else text


def screen(
    reports: DataFrame, model: TextModel, query: str, columns: Sequence[str] = SECTIONS, filter_df: bool = True, result_col: str = "matches_query",
    produce_spans: bool = False, drop_spans: bool = False, cache: Cache | None = None, key: str = "report_id",
) -> DataFrame:
    """Reports that a model says match a query, or all of them with its verdict (null where it failed)."""
    if not query or not query.strip():
        raise ValueError("the search query is empty")
    if model is None:
        raise ValueError("screening needs a model")
    prompted = whole(reports, prompt=F.concat(F.lit(f"Does this report match the query? Answer Yes or No. Query: {query.strip()}\n\n"), report_text(columns)))
    schema = {"matches": "bool", "spans": "str"} if produce_spans else None
    joined = answered(prompted, (cache or Cache()).answer(prompted.select("prompt"), model, schema))
    says = F.lower(F.get_json_object("reply", "$.matches")) if produce_spans else F.lower(F.trim("reply"))
    verdict = F.when(F.col("reply").isNotNull(), says.rlike("^(yes|true)"))
    spans = F.nullif(F.trim(F.get_json_object("reply", "$.spans")), F.lit("")).alias(f"spans_{result_col}")
    more = [spans] if produce_spans and not drop_spans else []
    if filter_df:
        return joined.where(verdict).select(*fields_of(reports, [f"spans_{result_col}"] if more else []), *more)
    return joined.select(*fields_of(reports, [result_col, *([f"spans_{result_col}"] if more else [])]), *more, verdict.alias(result_col))


#: Python names of feature types and theirs in Spark.
TYPES = {"str": T.StringType(), "int": T.LongType(), "float": T.DoubleType(), "bool": T.BooleanType()}


def extract(
    reports: DataFrame, model: TextModel, features: dict[str, str], columns: Sequence[str] = SECTIONS, allowed: dict[str, Sequence[str]] | None = None,
    produce_spans: bool = False, drop_spans: bool = False, instructions: str = "", skip_if_present: bool = True, cache: Cache | None = None,
) -> DataFrame:
    """Typed features of each report; each span column stands before its feature. Rows that failed have nulls.

    allowed: values of an enumerated feature; others become null. With skip_if_present, a feature that all its
    columns hold already keeps its value and only rows with a gap are asked.
    """
    if model is None:
        raise ValueError("extraction needs a model")
    wanted = {}
    for name, kind in features.items():
        if produce_spans:
            wanted[f"spans_{name}"] = "str"
        wanted[name] = kind
    names = json.dumps(wanted)
    ask_for = F.concat(F.lit(f"Fill the fields {names} from the report. {instructions}\n\n"), report_text(columns))
    present = [n for n in wanted if n in reports.columns]
    gap = ~F.lit(skip_if_present and len(present) == len(wanted))
    for n in present:
        gap = gap | F.col(name_of(n)).isNull()
    prompted = whole(reports, prompt=F.when(gap, ask_for), gap=gap)
    schema = T.StructType([T.StructField(n, TYPES[k]) for n, k in wanted.items()])
    replies = (cache or Cache()).answer(prompted.select("prompt"), model, wanted)
    joined = answered(prompted, replies).withColumn("found", F.from_json(repaired_json(F.col("reply")), schema))
    out = []
    for n in wanted:
        value = F.col(f"found.{name_of(n)}")
        if wanted[n] == "str":
            value = F.nullif(F.trim(value), F.lit("")) if n.startswith("spans_") else value
        if allowed and n in allowed:
            value = F.when(value.isin(*allowed[n]), value)
        out.append((F.when(F.col("gap"), value).otherwise(F.col(f"row.{name_of(n)}")) if n in present else value).alias(n))
    kept = [c for c, n in zip(out, wanted, strict=True) if not (drop_spans and n.startswith("spans_"))]
    return joined.select(*fields_of(reports, wanted), *kept)


def summarise(reports: DataFrame, columns: Sequence[str] = SECTIONS, result_col: str = "summary", trim_approach: str = "truncate", intensity: str | None = None, max_words: int | None = None, max_tokens: int | None = None, model: TextModel | None = None, tokenizer: str | None = None) -> DataFrame:
    """A text for each report: sections cut to a number of words or tokens (by a tokenizer file), or a model's summary."""
    if trim_approach not in ("truncate", "summarise"):
        raise ValueError("trim_approach is truncate or summarise")
    if max_words is not None and max_tokens is not None:
        raise ValueError("give max_words or max_tokens, not both")
    if trim_approach == "truncate" and intensity is not None:
        raise ValueError("an intensity needs trim_approach='summarise'")
    text = report_text(columns, collapse=False)
    if trim_approach == "truncate":
        if max_tokens is not None:
            text = first_tokens(text, max_tokens, tokenizer)
        return reports.withColumn(result_col, first_words(text, max_words) if max_words is not None else text)
    if model is None:
        raise ValueError("summaries need a model")
    prompted = whole(reports, prompt=F.concat(F.lit(f"Summarise the report ({intensity or 'medium'}).\n\n"), report_text(columns)))
    return answered(prompted, ask(prompted.select("prompt"), model)).select(*fields_of(reports, [result_col]), F.col("reply").alias(result_col))


def token_counts(c: Column, tokenizer: str | None = None) -> Column:
    """Tokens of a text by a tokenizer file (of the tokenizers library); without one, its words. Null has none."""
    if tokenizer is None:
        return word_count(c)

    def count(s: pd.Series) -> pd.Series:
        from tokenizers import Tokenizer

        known = Tokenizer.from_file(tokenizer)
        return pd.Series([0 if t is None else len(known.encode(t, add_special_tokens=False).ids) for t in s])

    return F.pandas_udf(count, "long")(c)


def first_tokens(c: Column, n: int, tokenizer: str | None = None) -> Column:
    """A text cut to a number of tokens; without a tokenizer file, to as many words."""
    if tokenizer is None:
        return first_words(c, n)

    def cut(s: pd.Series) -> pd.Series:
        from tokenizers import Tokenizer

        known = Tokenizer.from_file(tokenizer)
        ids = [None if t is None else known.encode(t, add_special_tokens=False).ids for t in s]
        return pd.Series([t if x is None or len(x) <= n else known.decode(x[: max(0, n)], skip_special_tokens=False) for t, x in zip(s, ids, strict=True)], dtype=object)

    return F.pandas_udf(cut, "string")(c)


def tokens(texts: DataFrame, column: str = "summary", tokenizer: str | None = None) -> DataFrame:
    """``tokens`` of each text."""
    return texts.withColumn("tokens", token_counts(F.col(column), tokenizer))


def discover_themes(summaries: DataFrame, model: TextModel, column: str = "summary", warn: int = 100_000, error: int = 500_000, most: int | None = None, least: int | None = None, seeds: Sequence[str] = (), extra: str = "", tokenizer: str | None = None) -> dict[str, str]:
    """Theme names and descriptions from one prompt over all summaries; the token guard keeps it bounded."""
    total = tokens(summaries, column, tokenizer).agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("n")).first()["n"]
    if total > error:
        raise ValueError(f"the summaries have {total} tokens; the limit is {error}")
    if total > warn:
        warnings.warn(f"the summaries have {total} tokens, more than {warn}", stacklevel=2)
    texts = [r[0] for r in summaries.select(column).where(F.col(column).isNotNull()).orderBy(column).collect()]  # bounded by the guard
    bounds = f"at least {least} and at most {most}" if least and most else f"at least {least}" if least else f"at most {most}" if most else "a fitting number of"
    reply = model.generate([f"Name {bounds} themes; seeds: {', '.join(seeds)}. {extra}\n\n" + "\n".join(texts)], {"themes": "map"})[0]
    return parse_themes(reply)


def parse_themes(raw: str) -> dict[str, str]:
    """Themes of a reply: fences and byte-order marks off, bare keys and trailing commas repaired, descriptions flat."""
    text = raw.lstrip("﻿").strip()
    if m := re.match(r"(?s)^```\w*\s*(.*?)\s*```$", text):
        text = m[1]
    try:
        found = json.loads(text)
    except ValueError:
        text = re.sub(r"([{,]\s*)([A-Za-z_]\w*)\s*:", r'\1"\2":', text)
        found = json.loads(re.sub(r",(\s*[}\]])", r"\1", text))
    if not isinstance(found, dict):
        raise ValueError("the reply is no object")
    found = found.get("themes", found)
    return {str(k): _flat(v) for k, v in found.items()}


def _flat(v: Any) -> str:
    if isinstance(v, dict):
        return _flat(next((v[k] for k in ("description", "details", "detail", "text") if k in v), ""))
    return "; ".join(map(_flat, v)) if isinstance(v, list) else str(v)


def clean_column(reports: DataFrame, model: TextModel, column: str, instruction: str) -> DataFrame:
    """A column rewritten by a model; nulls are not asked, and failures keep what was there."""
    own = F.col(name_of(column))
    prompted = whole(reports, prompt=F.when(own.isNotNull(), F.concat(F.lit(f"{instruction}\n\n"), own)))
    good = F.when(~F.coalesce(F.col("reply").startswith("Error"), F.lit(False)), F.col("reply"))
    joined = answered(prompted, ask(prompted.select("prompt"), model))
    return joined.select(*[F.coalesce(good, F.col(f"row.{name_of(c)}")).alias(c) if c == column else F.col(f"row.{name_of(c)}").alias(c) for c in reports.columns])


def fill_missing(reports: DataFrame, model: TextModel, fields: Sequence[str], text: str) -> DataFrame:
    """Null fields of reports from their text; rows without a gap are not asked."""
    gap = F.lit(False)
    for f in fields:
        gap = gap | F.col(name_of(f)).isNull()
    prompted = whole(reports, prompt=F.when(gap, F.concat(F.lit(f"Give the fields {', '.join(fields)}.\n\n"), F.coalesce(F.col(name_of(text)), F.lit("")))))
    wanted = {f: "str" for f in fields}
    schema = T.StructType([T.StructField(f, T.StringType()) for f in fields])
    joined = answered(prompted, ask(prompted.select("prompt"), model, wanted)).withColumn("found", F.from_json("reply", schema))
    own = lambda c: F.col(f"row.{name_of(c)}")
    return joined.select(*[F.coalesce(own(c), F.col(f"found.{name_of(c)}").cast(dict(reports.dtypes)[c])).alias(c) if c in fields else own(c).alias(c) for c in reports.columns])


@F.udtf(returnType="theme string, description string")
class ThemeRows:
    """A reply's themes as rows, for LATERAL joins: ``SELECT * FROM replies, LATERAL theme_rows(reply)``.

    Replies that are null or no object, and objects without a theme, give no row.
    """

    def eval(self, reply: str):
        try:
            found = parse_themes(reply) if reply else {}
        except ValueError:
            found = {}
        yield from found.items()


def register(spark) -> None:
    """The table functions of this module in SQL."""
    spark.udtf.register("theme_rows", ThemeRows)


def cascade(reports: DataFrame, stages: dict[str, dict[str, Column]], order: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """Each field from the first stage, in the order given, that has it."""
    if unknown := [s for s in order if s not in stages]:
        raise ValueError(f"unknown stages: {', '.join(unknown)}")
    return reports.select("*", *[F.coalesce(*[stages[s][f] for s in order if f in stages[s]], F.lit(None).cast("string")).alias(f) for f in fields])
