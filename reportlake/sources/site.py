"""A site of reports as a Spark data source: index pages of cards, each a link to a report's page.

    spark.dataSource.register(ReportSite)
    spark.read.format("report_site").option("index", "https://example.org/reports/page/{page}/").load()
    spark.readStream.format("report_site").options(...).load()

A batch read makes partitions of index pages; a partition fetches its index pages and the pages that they link to. The
driver looks only for the last index page, by doubling and halving. The stream's offset is the number of cards that the site has,
counted from the oldest: the newest come first on an index, so those between two offsets are the first cards of it.

Options: ``index`` (a template with {page}), ``first`` (number of the first index page, 1), ``pagesPerPartition`` (1),
``delay`` (seconds between requests of a partition, 1), ``timeout`` (60), ``retries`` (30), ``get``
(module:function for other ways to fetch, see fetch.Get). Columns: place (from the oldest, 1 on), index_page, url, status,
html, document (link of the attached file).

Cases: a site without cards gives no rows; a card that comes up twice is two rows; pages that are not there keep their row with
status and null html; a page without a document has null there. A stream sees a report once, as long as none is taken
off the site meanwhile: then places move, and a batch read with top_up finds what is missing.
"""

from __future__ import annotations

import importlib
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import urljoin

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from .fetch import Manners, Session, get_url
from .html import card_links, document_link

COLUMNS = "place long, index_page int, url string, status int, html string, document string"


class Site:
    """What both readers know of a site."""

    def __init__(self, options):
        self.index = options.get("index")
        if not self.index or "{page}" not in self.index:
            raise ValueError("the option index must be a template with {page}")
        self.first = int(options.get("first", "1"))
        self.per_partition = max(1, int(options.get("pagesPerPartition", "1")))
        pause = float(options.get("delay", "1"))
        self.manners = Manners(delay=(pause, 2 * pause), timeout=float(options.get("timeout", "60")), retries=int(options.get("retries", "30")))
        self.getter = options.get("get", "")

    def session(self) -> Session:
        get = get_url
        if self.getter:
            module, _, name = self.getter.partition(":")
            get = getattr(importlib.import_module(module), name)
        return Session(self.manners, get)

    def cards(self, session: Session, page: int) -> list[str]:
        """Absolute links of an index page's cards; none beyond the last page."""
        url = self.index.format(page=page)
        answer = session.fetch(url)
        if answer["error"]:
            raise OSError(f"{url}: {answer['error']}")
        if answer["status"] != 200:
            return []
        return [urljoin(url, x) for x in card_links(answer["body"].decode("utf-8", "replace"))]

    def size(self, session: Session) -> tuple[int, int, int]:
        """(index pages, cards of a full page, cards in all): pages double until one is empty, then the gap is halved."""
        per_page = len(self.cards(session, self.first))
        if not per_page:
            return 0, 0, 0
        low, high, found = 0, 1, per_page  # the page first + low has cards
        while n := len(self.cards(session, self.first + high)):
            low, high, found = high, 2 * high, n
        while high - low > 1:
            middle = (low + high) // 2
            if n := len(self.cards(session, self.first + middle)):
                low, found = middle, n
            else:
                high = middle
        return low + 1, per_page, low * per_page + found

    def rows(self, session: Session, index_page: int, first: int, last: int, newest: int) -> Iterator[tuple]:
        """Rows of the cards first to last of an index page; newest: the place of its first card."""
        for k, url in enumerate(self.cards(session, index_page)):
            if first <= k <= last:
                answer = session.fetch(url)
                html = answer["body"].decode("utf-8", "replace") if answer["status"] == 200 else None
                link = document_link(html) if html else None
                yield newest - k, index_page, url, answer["status"], html, urljoin(url, link) if link else None


@dataclass
class Pages(InputPartition):
    """Index pages with their range of cards: (page, first, last, place of the first card)."""

    parts: list[tuple[int, int, int, int]]


class Reader(DataSourceReader):
    def __init__(self, site: Site):
        self.site = site

    def partitions(self) -> list[Pages]:
        pages, per_page, cards = self.site.size(self.site.session())
        every = [(self.site.first + k, 0, 1 << 30, cards - k * per_page) for k in range(pages)]
        n = self.site.per_partition
        return [Pages(every[k : k + n]) for k in range(0, len(every), n)] or [Pages([])]

    def read(self, partition: Pages) -> Iterator[tuple]:
        session = self.site.session()
        for part in partition.parts:
            yield from self.site.rows(session, *part)


class StreamReader(DataSourceStreamReader):
    def __init__(self, site: Site):
        self.site = site

    def initialOffset(self) -> dict:
        return {"cards": 0}

    def latestOffset(self) -> dict:
        return {"cards": self.site.size(self.site.session())[2]}

    def partitions(self, start: dict, end: dict) -> list[Pages]:
        _, per_page, cards = self.site.size(self.site.session())
        newest, oldest = cards - min(end["cards"], cards), cards - start["cards"] - 1  # as the index lists them, 0 on
        parts = []
        for k in range(newest // per_page, oldest // per_page + 1) if per_page and oldest >= newest else ():
            parts.append((self.site.first + k, max(0, newest - k * per_page), min(per_page - 1, oldest - k * per_page), cards - k * per_page))
        n = self.site.per_partition
        return [Pages(parts[k : k + n]) for k in range(0, len(parts), n)]

    def read(self, partition: Pages) -> Iterator[tuple]:
        session = self.site.session()
        for part in partition.parts:
            yield from self.site.rows(session, *part)


class ReportSite(DataSource):
    @classmethod
    def name(cls) -> str:
        return "report_site"

    def schema(self) -> str:
        return COLUMNS

    def reader(self, schema) -> Reader:
        return Reader(Site(self.options))

    def streamReader(self, schema) -> StreamReader:
        return StreamReader(Site(self.options))
