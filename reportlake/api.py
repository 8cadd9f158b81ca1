"""Class facade over the operators: LLM, Scraper, Screener, Extractor, Cleaner. Each call returns a new DataFrame."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from .functions import text as X
from .operators import canonical, models, stats, tables, tagging
from .sources import html
from .storage import stored

DEFAULTS = {"date": False, "coroner": False, "area": False, "receiver": False, "investigation": True, "circumstances": True, "concerns": True}
TEXTS = ("investigation", "circumstances", "concerns")


def _chosen(flags: dict[str, bool]) -> list[str]:
    unknown = {k.removeprefix("include_") for k in flags} - set(DEFAULTS)
    if unknown:
        raise ValueError(f"unknown sections: {', '.join(sorted(unknown))}")
    wanted = DEFAULTS | {k.removeprefix("include_"): v for k, v in flags.items()}
    return [k for k, v in wanted.items() if v]


class Screener:
    """Reports that match a query, by a model's verdict."""

    def __init__(self, llm=None, reports: DataFrame | None = None, key: str = "report_id", **include: bool):
        self.llm, self.reports, self.key, self.columns = llm, reports, key, _chosen(include)
        self.cache = models.Cache()

    def screen_reports(self, reports: DataFrame | None = None, search_query: str | None = None, filter_df: bool = True, result_col_name: str = "matches_query", produce_spans: bool = False, drop_spans: bool = False) -> DataFrame:
        table = reports if reports is not None else self.reports
        if table is None:
            raise ValueError("no reports")
        columns = [c for c in self.columns if c in table.columns]
        self.reports = models.screen(table, self.llm, search_query or "", columns, filter_df, result_col_name, produce_spans, drop_spans, self.cache, self.key)
        return self.reports


class Extractor:
    """Features, summaries, themes and their tables."""

    def __init__(self, *, llm=None, reports: DataFrame | None = None, tokenizer: str | None = None, **include: bool):
        """tokenizer: a tokenizer file by which tokens are counted; without one they are words."""
        self.llm, self.reports, self.tokenizer, self.columns = llm, reports, tokenizer, _chosen(include)
        self.reset()

    def reset(self) -> Extractor:
        self.cache, self.features, self.summaries, self.themes = models.Cache(), [], None, None
        return self

    def _columns(self, texts_only: bool = False) -> list[str]:
        return [c for c in self.columns if c in self.reports.columns and (c in TEXTS or not texts_only)]

    def extract_features(self, reports: DataFrame | None = None, *, feature_model: dict[str, str] | None = None, produce_spans: bool = False, drop_spans: bool = False, force_assign: bool = False, allow_multiple: bool = False, extra_instructions: str | None = None, skip_if_present: bool = True, allowed: dict[str, Sequence[str]] | None = None) -> DataFrame:
        """feature_model: names and types (str, int, float, bool), or a class with such annotations."""
        if reports is not None:
            self.reports = reports
        model = feature_model if feature_model is not None else ({t: "bool" for t in self.themes} if self.themes else None)
        if model is None:
            raise ValueError("no feature model")
        if not isinstance(model, dict):
            model = {n: getattr(t, "__name__", str(t).split(" ")[0]) for n, t in model.__annotations__.items()}
        said = [extra_instructions or "", "Always choose a value." if force_assign else "Leave unknown fields null.", "Several values may apply." if allow_multiple else ""]
        self.features = [*self.features, *[n for n in model if n not in self.features]]
        self.reports = models.extract(self.reports, self.llm, model, self._columns(), allowed, produce_spans, drop_spans, " ".join(filter(None, said)), skip_if_present, self.cache)
        return self.reports

    def summarise(self, result_col_name: str = "summary", trim_approach: str = "truncate", summarise_intensity: str | None = None, max_tokens: int | None = None, max_words: int | None = None) -> DataFrame:
        self.summaries = (result_col_name, models.summarise(self.reports, self._columns(True), result_col_name, trim_approach, summarise_intensity, max_words, max_tokens, self.llm, self.tokenizer))
        self.trimmed = (trim_approach, summarise_intensity, max_tokens, max_words)
        return self.summaries[1]

    def estimate_tokens(self, col_name: str | None = None) -> int:
        if self.summaries is None:
            raise ValueError("summarise first")
        name, df = self.summaries
        return models.tokens(df, col_name or name, self.tokenizer).agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0]

    def discover_themes(self, *, warn_exceed: int = 100_000, error_exceed: int = 500_000, max_themes: int | None = None, min_themes: int | None = None, extra_instructions: str | None = None, seed_topics: Sequence[str] | str = (), trim_approach: str = "truncate", summarise_intensity: str | None = None, max_tokens: int | None = None, max_words: int | None = None) -> dict[str, str]:
        """Themes of all summaries, which are made anew only where there are none or they were trimmed otherwise."""
        if self.llm is None:
            raise ValueError("theme discovery needs a model")
        if trim_approach == "summarise":
            if max_tokens is not None or max_words is not None:
                raise ValueError("max_tokens and max_words need trim_approach='truncate'")
            summarise_intensity = summarise_intensity or "medium"
        if self.summaries is None or self.trimmed != (trim_approach, summarise_intensity, max_tokens, max_words):
            self.summarise(self.summaries[0] if self.summaries else "summary", trim_approach, summarise_intensity, max_tokens, max_words)
        seeds = seed_list(seed_topics) if isinstance(seed_topics, str) else list(seed_topics)
        name, df = self.summaries
        self.themes = models.discover_themes(df, self.llm, name, warn_exceed, error_exceed, max_themes, min_themes, seeds, extra_instructions or "", self.tokenizer)
        return self.themes

    def count(self, *, as_: str = "stats", measure: str = "words", threshold: int | None = None, step: int = 100, bins: int | str = "auto") -> DataFrame:
        """Words or tokens of the sections: as_ stats, table or hist."""
        if measure not in ("words", "tokens"):
            raise ValueError("measure is words or tokens")
        n = stats.lengths(self.reports, self._columns(True))
        if measure == "tokens":
            text = F.concat_ws(" ", *[F.col(c) for c in self._columns(True)])
            n = self.reports.withColumn("n", models.token_counts(text, self.tokenizer))
        if as_ == "stats":
            return stats.length_stats(n, threshold=threshold)
        if as_ == "table":
            return stats.length_table(n, threshold or 0, step)
        if as_ == "hist":
            return stats.histogram(n, bins)
        raise ValueError("as_ is stats, table or hist")

    def tabulate(self, columns: Sequence[str] | None = None, labels: Sequence[str] | None = None, *, count_col: str = "Count", pct_col: str = "Percentage", df: DataFrame | None = None) -> DataFrame:
        if columns is None and not self.features:
            raise RuntimeError("extract features first")
        return stats.tabulate(df if df is not None else self.reports, columns or self.features, labels, count_col, pct_col)

    def export_cache(self, path: str) -> None:
        self.cache.export(path)

    def import_cache(self, path: str) -> None:
        self.cache = models.Cache.load(self.reports.sparkSession, path)


def seed_list(text: str) -> list[str]:
    """Seed topics from JSON (list, or object whose keys count) or from lines."""
    import json

    try:
        found = json.loads(text)
        return [str(x) for x in found]
    except (ValueError, TypeError):
        return [x.strip() for x in text.splitlines() if x.strip()]


class Cleaner:
    """Sections rewritten by a model; areas and receivers put into canonical form without one."""

    SECTIONS = ("coroner", "area", "receiver", "investigation", "circumstances", "concerns")

    def __init__(self, reports: DataFrame, llm=None, areas: DataFrame | None = None, prompts: dict[str, str] | None = None, **include: bool):
        self.reports, self.llm, self.areas = reports, llm, areas
        self.columns = [c for c in self.SECTIONS if include.get(f"include_{c}", True)]
        if missing := [c for c in self.columns if c not in reports.columns]:
            raise ValueError(f"missing columns: {', '.join(missing)}")
        self.prompts = {c: f"Correct the {c} of a report; change nothing else." for c in self.columns} | (prompts or {})

    def generate_prompt_template(self) -> dict[str, str]:
        return {c: f"{self.prompts[c]}\n\n[TEXT]" for c in self.columns}

    def clean_reports(self, anonymise: bool = False, strategy: str = "exact_then_fuzzy") -> DataFrame:
        out = self.reports
        for c in self.columns:
            if self.llm is not None:
                said = self.prompts[c] + (" Replace personal names by [NAME]." if anonymise and c in TEXTS else "")
                out = models.clean_column(out, self.llm, c, said)
            if c == "area" and self.areas is not None:
                matched = canonical.match_areas(out, self.areas, "area", strategy)
                out = matched.withColumn("area", F.when(F.col("area").isNotNull(), F.col("area_canonical"))).select(*self.reports.columns)
            if c == "receiver":
                out = out.withColumn("receiver", X.clean_receiver_list(F.col("receiver")))
        return out

    def match_area(self, area: str, strategy: str = "exact_only") -> tuple:
        """(canonical area, method, score, matched value) of one area."""
        if self.areas is None:
            raise ValueError("no area table")
        one = self.reports.sparkSession.createDataFrame([(area,)], "area string")
        r = canonical.match_areas(one, self.areas, "area", strategy).first()
        return (r["area_canonical"], r["match_method"], r["match_score"], r["matched_value"])


class Scraper:
    """Report pages to report rows: links of index pages, fields of pages, fallbacks for what is missing.

    fetch: a function from address to HTML (sessions, limits and delays are its own); pages are fetched in tasks.
    cascade: which of html, text and llm fill a field, in order; text takes a table (url, text) of documents.
    """

    def __init__(self, spark: SparkSession, fetch: Callable[[str], str | None], category: str = "all", templates: dict[str, str] | None = None, configs: Sequence[html.FieldConfig] | None = None, sections: Sequence[html.SectionConfig] = (), documents: DataFrame | None = None, llm=None, order: Sequence[str] = ("html", "text", "llm"), workers: int = 10):
        if unknown := [x for x in order if x not in ("html", "text", "llm")]:
            raise ValueError(f"unknown stages: {', '.join(unknown)}")
        if "llm" in order and "html" in order and list(order).index("llm") < list(order).index("html"):
            raise ValueError("the model only fills what the pages leave open, so it comes after them")
        if workers < 1:
            raise ValueError("workers must be positive")
        self.spark, self.fetch, self.category, self.templates = spark, fetch, category, templates or {}
        self.configs = list(configs) if configs is not None else html.default_configs()
        self.sections, self.documents, self.llm, self.order, self.workers = list(sections), documents, llm, list(order), workers
        self.links: list[str] = []
        self.reports: DataFrame | None = None

    def get_report_links(self) -> list[str]:
        """Links of the category's index pages, from the first page until one has none; each once."""
        found = html.crawl(self.fetch, lambda k: html.category_url(self.category, self.templates, k))
        self.links = list(dict.fromkeys(found))
        return self.links

    def _pages(self, links: Sequence[str]) -> DataFrame:
        fetch = self.fetch

        def get(s: pd.Series) -> pd.Series:
            return s.map(fetch)

        rows = self.spark.createDataFrame([(x,) for x in links], "url string").repartition(self.workers)
        return stored(rows.withColumn("html", F.pandas_udf(get, "string")("url")), "pages")

    def _fields(self, links: Sequence[str]) -> DataFrame:
        names = [c.name for c in self.configs]
        pages = self._pages(links).where(html.document_link_udf()("html").isNotNull())
        out = html.fields(pages, self.configs) if "html" in self.order else pages.select("*", *[F.lit(None).cast("string").alias(n) for n in names])
        out = out.select("url", *names)
        if "text" in self.order and self.documents is not None:
            both = out.join(self.documents.select("url", F.col("text").alias("document_text")), "url", "left")
            out = html.section_fallback(both, self.sections, "document_text").drop("document_text")
        return out

    def scrape_reports(self) -> DataFrame:
        """A row for each linked page that has a document; pages without one are left out."""
        if not self.links:
            self.get_report_links()
        self.reports = self._fields(self.links)
        if "llm" in self.order and self.llm is not None:
            self.run_llm_fallback()
        return self.reports

    def run_llm_fallback(self, reports: DataFrame | None = None) -> DataFrame:
        """Null fields from a document's text by the model."""
        if self.llm is None:
            raise ValueError("the fallback needs a model")
        table = reports if reports is not None else self.reports
        if table is None:
            raise ValueError("no reports")
        if self.documents is None:
            raise ValueError("no documents")
        names = [c.name for c in self.configs if c.name in table.columns]
        both = table.join(self.documents.select("url", F.col("text").alias("document_text")), "url", "left")
        filled = models.fill_missing(both, self.llm, names, "document_text").drop("document_text")
        dated = [c.name for c in self.configs if c.date and c.name in names]
        self.reports = filled.withColumns({c: X.spoken_date(F.col(c)) for c in dated}) if dated else filled
        return self.reports

    def rescrape_fields(self, fields: Sequence[str], reports: DataFrame | None = None) -> DataFrame:
        """Some fields fetched anew; what is not found again becomes null, everything else stays."""
        table = reports if reports is not None else self.reports
        if table is None:
            raise ValueError("no reports")
        if unknown := [f for f in fields if f not in [c.name for c in self.configs]]:
            raise ValueError(f"unknown fields: {', '.join(unknown)}")
        links = [r["url"] for r in table.select("url").where("url is not null").distinct().collect()]  # pages to fetch again
        self.reports = tables.replace_columns(table, self._fields(links).select("url", *fields), list(fields))
        return self.reports

    def top_up(self, old: DataFrame | None = None) -> DataFrame:
        """Old rows, and those of links that they do not have; the old ones alone where there is nothing new."""
        table = old if old is not None else self.reports
        if table is None:
            raise ValueError("no reports")
        known = {r["url"] for r in table.join(self.spark.createDataFrame([(x,) for x in self.get_report_links()], "url string"), "url", "left_semi").select("url").collect()}
        fresh = [x for x in self.links if x not in known]
        self.reports = table.unionByName(self._fields(fresh), allowMissingColumns=True) if fresh else table
        return self.reports


LLM = models.ChatModel
apply_collection_columns = tagging.tag_collections
