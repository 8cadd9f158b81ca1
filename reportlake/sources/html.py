"""Fields of HTML pages: first paragraph with a keyword, section after a heading, links; index and crawl helpers."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ..functions import vocabulary as V
from ..functions.text import clean_text, gated, report_id, sandwich, spoken_date


@dataclass(frozen=True)
class FieldConfig:
    """How a field is found: paragraph keywords in order, else a section heading; literals off, length bounds."""

    name: str
    keywords: tuple[str, ...] = ()
    section: str | None = None
    headings: tuple[str, ...] = ()
    remove: tuple[str, ...] = ()
    shortest: int | None = None
    longest: int | None = None
    date: bool = False


class _Page(HTMLParser):
    """Paragraph texts, what follows each bold heading inside its parent, and links with their classes."""

    def __init__(self):
        super().__init__()
        self.paragraphs: list[str] = []
        self.sections: list[tuple[str, str]] = []
        self.links: list[tuple[str, str, str]] = []
        self.stack: list[dict] = []

    def handle_starttag(self, tag, attrs):
        if tag in ("br", "img", "meta", "link", "hr", "input"):
            return
        a = dict(attrs)
        self.stack.append({"tag": tag, "text": [], "head": None, "rest": []})
        if tag == "a" and a.get("href"):
            outer = " ".join(x.get("class", "") for x in self.stack)
            self.links.append((a["href"], a.get("class") or "", outer))
        self.stack[-1]["class"] = a.get("class") or ""

    def handle_data(self, data):
        for x in self.stack:
            x["text"].append(data)

    def handle_endtag(self, tag):
        if not any(x["tag"] == tag for x in self.stack):
            return
        while self.stack:
            x = self.stack.pop()
            text = "".join(x["text"])
            if x["tag"] == "p":
                self.paragraphs.append(text)
            parent = self.stack[-1] if self.stack else None
            if parent is not None and x["tag"] == "strong":
                if parent["head"] is None:
                    parent["head"], parent["start"] = text, len("".join(parent["text"]))
            if x["head"] is not None:
                self.sections.append((x["head"], text[x["start"] :]))
            if x["tag"] == tag:
                break


def page(html: str | None) -> _Page:
    p = _Page()
    p.feed(html or "")
    p.close()
    return p


def paragraph(html: str | None, keywords: Sequence[str]) -> str | None:
    """The first paragraph that holds a keyword; earlier keywords win over earlier paragraphs."""
    found = page(html).paragraphs
    return next((t for k in keywords for t in found if k in t), None)


def section(html: str | None, heading: str) -> str | None:
    """What follows the first bold heading with a text, in its parent."""
    return next((t for h, t in page(html).sections if heading.lower() in h.lower()), None)


def paragraphs_udf(keywords: Sequence[str]):
    return F.pandas_udf(lambda s: s.map(lambda x: paragraph(x, keywords)), "string")


def sections_udf(heading: str):
    return F.pandas_udf(lambda s: s.map(lambda x: section(x, heading)), "string")


def document_link(html: str | None) -> str | None:
    """The link of the attached document: inside a file block, else a button; null if the page has none."""
    links = page(html).links
    block = [h for h, _, outer in links if "wp-block-file" in outer]
    button = [h for h, own, _ in links if "govuk-button" in own]
    return (block or button or [None])[0]


def document_link_udf():
    return F.pandas_udf(lambda s: s.map(document_link), "string")


def card_links(html: str | None) -> list[str]:
    """Links of an index page's cards, in order."""
    return [h for h, own, _ in page(html).links if "card__link" in own.split()]


def title_udf():
    """Text of the title element."""

    def title(html: str | None) -> str | None:
        low = (html or "").lower()
        a = low.find("<title>")
        b = low.find("</title>", a)
        return html[a + 7 : b].strip() if 0 <= a < b else None

    return F.pandas_udf(lambda s: s.map(title), "string")


def fields(pages: DataFrame, configs: Sequence[FieldConfig], html: str = "html") -> DataFrame:
    """A column for each field: found, literals off, dates normalised, null outside the length bounds."""
    out = pages
    for c in configs:
        raw: Column = paragraphs_udf(list(c.keywords))(html) if c.keywords else F.lit(None).cast("string")
        for heading in [*([c.section] if c.section else []), *c.headings]:
            raw = F.coalesce(raw, sections_udf(heading)(html))
        value = gated(raw, c.remove, c.shortest, c.longest)
        out = out.withColumn(c.name, spoken_date(value) if c.date else value)
    if "id" in [c.name for c in configs]:
        out = out.withColumn("id", report_id(F.col("id")))
    return out


def default_configs(values: dict[str, dict] = V.FIELD_CONFIGS) -> list[FieldConfig]:
    """Field configurations from plain values."""
    return [FieldConfig(name, **{k: tuple(v) if isinstance(v, list) else v for k, v in facts.items()}) for name, facts in values.items()]


NOT_PDF = "N/A: Source file not PDF"


def document_texts(files: DataFrame, parse: Callable[[bytes], str]) -> DataFrame:
    """path, text of files as ``spark.read.format("binaryFile")`` gives them; parse: a PDF's bytes to its text.

    Files that are no .pdf have no text; those that the parser refuses have a text that says so.
    """

    def text(path: pd.Series, content: pd.Series) -> pd.Series:
        out = []
        for p, data in zip(path, content, strict=True):
            try:
                out.append(parse(data) if p.lower().endswith(".pdf") else None)
            except Exception:  # noqa: BLE001 - the text says so
                out.append(NOT_PDF)
        return pd.Series(out, dtype=object)

    return files.select("path", clean_text(F.pandas_udf(text, "string")("path", "content")).alias("text"))


@dataclass(frozen=True)
class SectionConfig:
    """What stands between the first start found and the nearest end after it; literals off, length bounds."""

    name: str
    starts: tuple[str, ...]
    ends: tuple[str, ...] = ()
    remove: tuple[str, ...] = ()
    shortest: int | None = None
    longest: int | None = None


def section_fallback(reports: DataFrame, configs: Sequence[SectionConfig], text: str = "text") -> DataFrame:
    """Null fields filled from a document's text; fields with a value stay as they are."""
    held = {c.name: c for c in configs if c.name in reports.columns}
    found = {n: F.nullif(gated(sandwich(F.col(text), c.starts, c.ends), c.remove, c.shortest, c.longest), F.lit("")) for n, c in held.items()}
    return reports.select(*[F.coalesce(F.col(c), found[c].cast(dict(reports.dtypes)[c])).alias(c) if c in found else F.col(c) for c in reports.columns])


def category_url(category: str, templates: dict[str, str], page_number: int) -> str:
    """Index page of a category by its template, without regard to case."""
    key = category.strip().lower()
    if key not in templates:
        raise ValueError(f"unknown category {category!r}; known: {', '.join(sorted(templates))}")
    return templates[key].format(page=page_number)


def crawl(fetch, url_of_page, most: int = 10_000) -> list[str]:
    """Card links of index pages from the first on, until a page has none. fetch: url to HTML."""
    out: list[str] = []
    for k in range(1, most + 1):
        links = card_links(fetch(url_of_page(k)))
        if not links:
            break
        out += links
    return out


def truthy_cells(s: pd.Series) -> pd.Series:
    """Spreadsheet answers as booleans: yes, true, 1 against no, false, 0; else null."""
    words = s.astype("string").str.strip().str.lower()
    return words.map({"yes": True, "true": True, "1": True, "no": False, "false": False, "0": False})
