"""Links of outlets' search pages and of archive listings: anchors inside their containers, crawled while pages bring new ones."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from html.parser import HTMLParser
from typing import NamedTuple
from urllib.parse import quote_plus, urljoin

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
SECTION = re.compile(r"/[a-z][a-z0-9-]*")


class Containers(HTMLParser):
    """Hrefs of anchors by container: each element of the tag (and class, if one is given) with all anchors inside it; without a tag, the page is the container."""

    def __init__(self, tag: str | None = None, class_: str | None = None):
        super().__init__(convert_charrefs=True)
        self.tag, self.class_ = tag, class_
        self.found: list[list[str]] = [] if tag else [[]]
        self.stack: list[tuple[str, list[str] | None]] = []

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        given = {k: v or "" for k, v in attrs}
        mine = tag == self.tag and (self.class_ is None or self.class_ in given.get("class", "").split())
        if mine:
            self.found.append([])
        if tag not in VOID:
            self.stack.append((tag, self.found[-1] if mine else None))
        if tag == "a":
            for _, links in self.stack:
                if links is not None:
                    links.append(given.get("href", ""))
            if not self.tag:
                self.found[0].append(given.get("href", ""))

    def handle_endtag(self, tag: str) -> None:
        for k in range(len(self.stack) - 1, -1, -1):
            if self.stack[k][0] == tag:
                del self.stack[k:]
                return

    @classmethod
    def of(cls, page: str | None, tag: str | None = None, class_: str | None = None) -> list[list[str]]:
        reader = cls(tag, class_)
        reader.feed(page or "")
        reader.close()
        return reader.found


class Outlet(NamedTuple):
    """How an outlet is searched: url with {q}, the parameter of further pages (None: one page), the container of results and the form of their links."""

    domain: str
    search_url: str
    page_parameter: str | None = "page"
    tag: str | None = None
    class_: str | None = None
    pattern: str = ""


def crawl(fetch: Callable[[str], str | None], outlet: Outlet, query: str, most: int) -> Iterator[tuple[int, int, str]]:
    """(page, place, url) of the outlet's links in the order of its pages, each url once.

    It ends with `most` links, with a page that brings none that is new, that can't be
    fetched, or after the first where the outlet has no further ones.
    """
    seen: set[str] = set()
    page = 1
    while len(seen) < most:
        url = outlet.search_url.format(q=quote_plus(query))
        if page > 1:
            if not outlet.page_parameter:
                return
            url += f"&{outlet.page_parameter}={page}"
        html = fetch(url)
        if html is None:
            return
        before = len(seen)
        for links in Containers.of(html, outlet.tag, outlet.class_):
            for place, href in enumerate(links):
                full = urljoin(url, href).split("#")[0]
                if outlet.domain in full and full not in seen and re.search(outlet.pattern, href) and len(seen) < most:
                    seen.add(full)
                    yield page, place, full
        if len(seen) == before:
            return
        page += 1


class Site(InputPartition):
    def __init__(self, outlet: Outlet):
        super().__init__(outlet.domain)
        self.outlet = outlet


def search_source(name: str, fetch: Callable[[str], str | None], outlets: list[Outlet], query: str, most: int = 40) -> type[DataSource]:
    """A data source class of (outlet, page, place, url): one partition an outlet, whose pages follow one another; fetch(url) is a page or None."""

    class Reader(DataSourceReader):
        def partitions(self) -> list[Site]:
            return [Site(o) for o in outlets]

        def read(self, partition: Site) -> Iterator[tuple]:
            for found in crawl(fetch, partition.outlet, query, most):
                yield partition.outlet.domain, *found

    class Search(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return "outlet string, page int, place int, url string"

        def reader(self, schema) -> Reader:
            return Reader()

    return Search


def story_links(pages: DataFrame, tag: str | None, class_: str | None = None, marker: str = "") -> DataFrame:
    """(url, hint, page) of archive pages(url, html): the first link that holds the marker in each story container, and the section that the container's first one-part link hints at.

    Without a tag there are no containers: every such link of a page counts, without a
    hint. A url that several stories name keeps the first hint of the first page by url.
    A null html has no stories, links lose their fragment, empty ones are left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for base, html in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for story, links in enumerate(Containers.of(html, tag, class_)):
                    wanted = [h for h in links if marker in h]
                    hint = next((h.strip("/") for h in links if SECTION.fullmatch(h)), "") if tag else ""
                    for place, href in enumerate(wanted[:1] if tag else wanted):
                        if url := urljoin(base or "", href).split("#")[0]:
                            rows.append((url, hint, base, story, place))
            if rows:
                kinds = [pa.string(), pa.string(), pa.string(), pa.int32(), pa.int32()]
                yield pa.RecordBatch.from_arrays([pa.array(x, type=t) for x, t in zip(zip(*rows), kinds)], ["url", "hint", "page", "story", "place"])

    rows = pages.select(F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")).mapInArrow(run, "url string, hint string, page string, story int, place int")
    first = rows.groupBy("url").agg(F.min(F.struct("page", "story", "place", "hint")).alias("r"))
    return first.select("url", "r.hint", "r.page")
