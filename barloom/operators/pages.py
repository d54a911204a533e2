"""Text of stored web pages: one pass of the standard library's parser over each page, batched by Arrow."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Elements whose content is no text, elements without an end, marks of article blocks and of publication times.
SKIPPED = frozenset("script style nav footer form noscript".split())
EMPTY = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK_MARKS = ("article", "content", "p_coten")
TIME_NAMES = ("publishdate", "pubdate", "date")
TIME_PROPERTY = "article:published_time"


class _Page(HTMLParser):
    """Collects the title, the text of article-like blocks, the whole text, and stated times, in time linear in the page.

    A block inside another one is never longer than it, and only the longest block is wanted, so text goes to the outermost block alone.
    """

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, list[str] | None, bool]] = []
        self.names: Counter = Counter()
        self.heads: dict[str, list[list[str]]] = {"h1": [], "title": []}
        self.titles: list[list[str]] = []
        self.blocks: list[list[str]] = []
        self.block: list[str] | None = None
        self.everything: list[str] = []
        self.times: list[tuple[int, str]] = []
        self.skipping = 0

    def handle_starttag(self, tag, attrs):
        a = {k: v or "" for k, v in attrs}
        if tag == "meta" and (a.get("property") == TIME_PROPERTY or a.get("name", "").lower() in TIME_NAMES):
            order = 0 if a.get("property") == TIME_PROPERTY else 1 + TIME_NAMES.index(a["name"].lower())
            self.times.append((order, a.get("content", "")))
        if tag == "time" and "datetime" in a:
            self.times.append((1 + len(TIME_NAMES), a["datetime"]))
        if tag in EMPTY:
            return
        into = None
        if not self.skipping and tag in self.heads:
            into = []
            self.heads[tag].append(into)
            self.titles.append(into)
        elif not self.skipping and self.block is None and (tag == "article" or any(m in a.get("class", "") for m in BLOCK_MARKS)):
            into = self.block = []
            self.blocks.append(into)
        skips = tag in SKIPPED
        self.skipping += skips
        self.open.append((tag, into, skips))
        self.names[tag] += 1

    def handle_endtag(self, tag):
        # An end without its beginning says nothing; what was left open inside an element ends with it.
        if not self.names[tag]:
            return
        name = None
        while name != tag:
            name, into, skips = self.open.pop()
            self.names[name] -= 1
            self.skipping -= skips
            if into is not None and into is self.block:
                self.block = None
            elif into is not None:
                self.titles.pop()

    def handle_data(self, data):
        text = data.strip()
        if text and not self.skipping:
            self.everything.append(text)
            if self.block is not None:
                self.block.append(text)
            for into in self.titles:
                into.append(text)


def parsed(html: str | None) -> tuple[str, list[str], str, list[str]]:
    page = _Page()
    page.feed(html or "")
    page.close()
    head = next((h for k in ("h1", "title") for h in page.heads[k] if h), [])
    lines = "\n".join
    return " ".join(head), [lines(b) for b in page.blocks], lines(page.everything), [t for _, t in sorted(page.times, key=lambda x: x[0])]


def page_parts(pages: DataFrame) -> DataFrame:
    """pages (html) with the columns _title, _blocks, _all, _times in place of html."""
    @F.pandas_udf("_title string, _blocks array<string>, _all string, _times array<string>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in batches:
            yield pd.DataFrame([parsed(h) for h in s], columns=["_title", "_blocks", "_all", "_times"])

    return pages.withColumn("_p", run("html")).select("*", "_p.*").drop("_p", "html")
