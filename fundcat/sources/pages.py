"""Fetched pages into title, text and links."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import DataFrame

_HIDDEN = {"script", "style", "nav", "footer", "header", "noscript", "form", "iframe"}
MAX_TEXT, MAX_LINKS, MIN_TEXT = 100_000, 5_000, 30


class _Page(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.hidden: list[str] = []
        self.inside: list[str] = []
        self.text: list[str] = []
        self.main: list[str] = []
        self.titles: dict[str, list[str]] = {"h1": [], "title": []}
        self.links: list[str] = []
        self.heading = 0

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in _HIDDEN:
            self.hidden.append(tag)
        elif tag in ("main", "h1", "title"):
            self.inside.append(tag)
            self.heading += tag == "h1"
        if tag == "a" and (href := dict(attrs).get("href")):
            self.links.append(href)

    def handle_endtag(self, tag: str) -> None:
        for stack in (self.hidden, self.inside):
            if tag in stack:
                while stack.pop() != tag:
                    pass

    def handle_data(self, data: str) -> None:
        if "title" in self.inside:
            self.titles["title"].append(data)
        elif not self.hidden:
            if "h1" in self.inside and self.heading == 1:
                self.titles["h1"].append(data)
            (self.main if "main" in self.inside else self.text).append(data)


def parse(url: str | None, html: str | None) -> tuple[str, str, list[str]] | None:
    """Title, visible text and links; None for pages with hardly any text."""
    page = _Page()
    page.feed(html or "")
    page.close()
    squeeze = lambda parts: re.sub(r"\s+", " ", " ".join(parts)).strip()
    text = squeeze(page.main) or squeeze(page.text)
    if len(text) < MIN_TEXT:
        return None
    links: dict[str, None] = {}
    for href in page.links:
        try:
            full = urljoin(url or "", href).split("#")[0]
        except ValueError:
            continue
        if full.startswith(("http://", "https://")):
            links.setdefault(full)
    return (squeeze(page.titles["h1"]) or squeeze(page.titles["title"]))[:250], text[:MAX_TEXT], list(links)[:MAX_LINKS]


def page_parse(pages: DataFrame) -> DataFrame:
    """``(page_id, url, html)`` -> ``(page_id, url, title, text, links)``."""
    pages.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "200")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(i, u, *p) for i, u, h in zip(b["page_id"], b["url"], b["html"], strict=True) if (p := parse(u, h))]
            yield pd.DataFrame(rows, columns=["page_id", "url", "title", "text", "links"])

    return pages.select("page_id", "url", "html").mapInPandas(run, "page_id long, url string, title string, text string, links array<string>")
