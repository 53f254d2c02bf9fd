"""Article rows from HTML pages and links from sitemaps and archive pages."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import article_id, guess_genre

VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
PARSED = "section string, published string, author string, headline string, body string, links array<struct<href:string,text:string>>"


class ArticlePage(HTMLParser):
    """Meta properties, times, first heading, author link, paragraphs of the body and links of a page.

    body: (tag, class) pairs inside which paragraphs are the article's; a class of None is any.
    """

    def __init__(self, body: tuple[tuple[str, str | None], ...], author: tuple[str, str]):
        super().__init__(convert_charrefs=True)
        self.body, self.author_rule = body, author
        self.meta: dict[str, str] = {}
        self.time, self.headline, self.author = "", None, None
        self.paragraphs: list[str] = []
        self.links: list[tuple[str, str]] = []
        self.stack: list[tuple[str, bool]] = []
        self.parts: dict[str, list[str]] = {}

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        a = {k: v or "" for k, v in attrs}
        if tag == "meta":
            name = a.get("property") or a.get("name")
            if name and name not in self.meta:
                self.meta[name] = a.get("content", "").strip()
        elif tag == "time" and not self.time:
            self.time = a.get("datetime", "")
        elif tag == "h1" and self.headline is None and "h1" not in self.parts:
            self.parts["h1"] = []
        elif tag == "p":
            self._end("p")
            if any(inside for _, inside in self.stack):
                self.parts["p"] = []
        elif tag == "a":
            self._end("a")
            self.parts["a"] = []
            self.links.append((a.get("href", ""), ""))
            if self.author is None and self.author_rule[0] == "a" and self.author_rule[1] in a.get("href", ""):
                self.parts["author"] = []
        if tag not in VOID and tag not in ("p", "meta"):
            words = a.get("class", "").split()
            self.stack.append((tag, any(tag == t and (c is None or c in words) for t, c in self.body)))

    def handle_endtag(self, tag: str) -> None:
        if tag in ("p", "h1", "a"):
            self._end(tag)
        for k in range(len(self.stack) - 1, -1, -1):
            if self.stack[k][0] == tag:
                if self.stack[k][1]:
                    self._end("p")
                del self.stack[k:]
                break

    def _end(self, what: str) -> None:
        if (parts := self.parts.pop(what, None)) is None:
            return
        text = " ".join(" ".join(parts).split())
        if what == "p":
            self.paragraphs.append(text)
        elif what == "h1":
            self.headline = text
        elif what == "a":
            self.links[-1] = (self.links[-1][0], text)
            if self.parts.pop("author", None) is not None:
                self.author = text

    def handle_data(self, data: str) -> None:
        for parts in self.parts.values():
            parts.append(data.strip())

    def row(self, min_paragraph: int) -> dict:
        self._end("p")
        return {
            "section": self.meta.get("article:section", "").lower(),
            "published": self.meta.get("article:published_time", "") or self.time,
            "author": self.author or "",
            "headline": self.headline or "",
            "body": " ".join(p for p in self.paragraphs if len(p) > min_paragraph),
            "links": [{"href": h, "text": t} for h, t in self.links],
        }


def parsed(pages: DataFrame, body: tuple[tuple[str, str | None], ...] = (("article", None),), author: tuple[str, str] = ("a", "/authors/"), min_paragraph: int = 30) -> DataFrame:
    """pages(url, html) parsed to url and PARSED; a null html parses as an empty page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("href", pa.string()), ("text", pa.string())]))
        for batch in batches:
            rows = []
            for page in batch.column(1).to_pylist():
                reader = ArticlePage(body, author)
                reader.feed(page or "")
                reader.close()
                rows.append(reader.row(min_paragraph))
            columns = [pa.array([r[k] for r in rows], type=kind if k == "links" else pa.string()) for k in ("section", "published", "author", "headline", "body", "links")]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["url", "section", "published", "author", "headline", "body", "links"])

    return pages.select(F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")).mapInArrow(run, f"url string, {PARSED}")


def scraped(pages: DataFrame, outlet: str, sections: list[str] | None = None, min_body: int = 120, **rules) -> DataFrame:
    """Articles of pages, with `status`: `drop` for another section or a short body, else `ok`. sections of None takes all."""
    rows = parsed(pages, **rules)
    ok = F.length("body") >= min_body
    if sections is not None:
        ok = ok & F.col("section").isin(*sections)
    return rows.select(
        F.lit(outlet).alias("outlet"), "section", F.substring("published", 1, 10).alias("date"), F.col("published").alias("timestamp"), "author", "headline", "url", article_id(F.col("url")).alias("article_id"), "body",
        guess_genre(F.col("url"), F.col("author")).alias("genre"), F.when(ok, "ok").otherwise("drop").alias("status"),
    )


def sitemap_links(maps: DataFrame, marker: str, start: str, end: str) -> DataFrame:
    """(url, lastmod) of sitemaps(xml) whose url holds the marker and whose day is in the range; entries with a bad date are left out."""
    entry = F.explode(F.regexp_extract_all("xml", F.lit(r"(?s)<url>(.*?)</url>"), F.lit(1))).alias("entry")
    rows = maps.select(entry).select(F.trim(F.regexp_extract("entry", r"(?s)<loc>\s*(.*?)\s*</loc>", 1)).alias("url"), F.try_to_date(F.substring(F.regexp_extract("entry", r"(?s)<lastmod>\s*(.*?)\s*</lastmod>", 1), 1, 10)).alias("lastmod"))
    return rows.where(F.col("url").contains(marker) & F.col("lastmod").between(F.lit(start).cast("date"), F.lit(end).cast("date")))


def archive_links(pages: DataFrame, marker: str) -> DataFrame:
    """(url, hint) of archive pages(url, html): absolute story links without fragment, each once, and the section that a page's one-part links hint at."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for base, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                reader = ArticlePage((), ("a", "/authors/"))
                reader.feed(page or "")
                reader.close()
                hint = ""
                for href, _ in reader.links:
                    part = href.strip("/")
                    if href.startswith("/") and part.replace("-", "a").isalnum() and part[:1].isalpha() and part == part.lower() and "/" not in part and not href.endswith("/"):
                        hint = part
                    elif marker in href:
                        found.append((urljoin(base or "", href).split("#")[0], hint))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(x, type=pa.string()) for x in zip(*found)], ["url", "hint"])

    rows = pages.select("url", "html").mapInArrow(run, "url string, hint string")
    return rows.groupBy("url").agg(F.min("hint").alias("hint"))


def headline_of(html: Column) -> Column:
    """The text of the first h1 by pattern, for a quick look without parsing."""
    return F.trim(F.regexp_extract(html, r"(?s)<h1[^>]*>(.*?)</h1>", 1))
