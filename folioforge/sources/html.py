"""HTML to flowing text with a stream parser; a narrow Arrow function over rows.

Block elements begin a new line, list items begin with "- ", table cells are parted by tabs and rows by line ends, ``pre`` stays as it
is, comments go. With clean-up, navigation and other page furniture is left out and the title is read.
Broken markup never fails; null in, null out.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

# Elements that begin a line, and what clean-up leaves out.
BLOCKS = {"p", "div", "h1", "h2", "h3", "h4", "br", "tr"}
DROPPED_ELEMENTS = {"nav", "footer", "meta", "script", "style", "symbol", "aside"}
DROPPED_CLASSES = {"sidebar", "footer", "sticky", "hidden"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}


class Flow(HTMLParser):
    def __init__(self, clean: bool = False, links: str = "strip") -> None:
        super().__init__(convert_charrefs=True)
        self.clean, self.links = clean, links
        self.out: list[str] = []
        self.title: str | None = None
        self._open: list[str] = []
        self._skip: list[int] = []
        self._pre = self._table = self._cells = 0
        self._href: list[str | None] = []
        self._in_title = False
        self._after_item = False

    def _put(self, text: str) -> None:
        if text:
            self.out.append(text)

    def handle_starttag(self, tag: str, attrs: list) -> None:
        a = dict(attrs)
        if tag not in VOID:
            self._open.append(tag)
            classes = set((a.get("class") or "").split())
            if self.clean and not self._skip and (tag in DROPPED_ELEMENTS or classes & DROPPED_CLASSES):
                self._skip.append(len(self._open))
        if self._skip:
            return
        if tag == "title":
            self._in_title = True
        elif tag == "pre":
            self._pre += 1
            self._put("\n")
        elif tag == "table":
            self._table += 1
            self._put("\n")
        elif tag == "tr":
            self._cells = 0
        elif tag in ("td", "th"):
            if self._cells:
                self._put("\t")
            self._cells += 1
        elif tag == "li":
            self._put("\n- ")
            self._after_item = True
            return
        elif tag == "a":
            self._href.append(a.get("href"))
            if self.links == "markdown" and a.get("href") and not self._table:
                self._put("[")
        elif tag in BLOCKS and not (self._after_item and tag in ("p", "div")) and not self._table:
            self._put("\n")
        self._after_item = False

    def handle_endtag(self, tag: str) -> None:
        if tag in self._open:
            while self._open:
                if self._skip and self._skip[-1] == len(self._open):
                    self._skip.pop()
                    self._open.pop()
                    if tag in DROPPED_ELEMENTS or not self._open:
                        return
                    return
                if self._open.pop() == tag:
                    break
        if self._skip:
            return
        if tag == "title":
            self._in_title = False
        elif tag == "pre":
            self._pre = max(0, self._pre - 1)
            self._put("\n")
        elif tag == "table":
            self._table = max(0, self._table - 1)
            self._put("\n")
        elif tag == "tr":
            self._put("\n")
        elif tag == "a" and self._href:
            href = self._href.pop()
            if self.links == "markdown" and href and not self._table:
                self._put(f"]({href})")

    def handle_data(self, data: str) -> None:
        if self._skip:
            return
        if self._in_title:
            self.title = (self.title or "") + data
            if self.clean:
                return
        if self._pre:
            self._put(data)
            return
        text = re.sub(r"[\n\r]+", " ", data)
        if self._table:
            text = text.strip()
        if text.strip():
            self._after_item = False
        if text and self.out and self.out[-1] and not self.out[-1][-1].isspace() and not text[0].isspace() and self._table:
            text = " " + text
        self._put(text)

    def text(self) -> str:
        t = "".join(self.out)
        t = re.sub(r" {2,}", " ", t)
        t = re.sub(r" +\n", "\n", t)
        t = re.sub(r"\n{2,}", "\n", t)
        return t.strip()


def flatten(markup: str, clean: bool = False, links: str = "strip") -> tuple[str | None, str]:
    """(title, text) of a page."""
    p = Flow(clean, links)
    p.feed(markup)
    p.close()
    title = p.title.strip() if p.title else None
    text = p.text()
    return title, text.replace("​", "") if clean else text


def pages(df: DataFrame, key: str, markup: str, clean: bool = True, links: str = "strip") -> DataFrame:
    """(key, page_title, page_text)."""

    @F.pandas_udf("page_title string, page_text string")
    def run(s: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([flatten(x, clean, links) if x is not None else (None, None) for x in s], columns=["page_title", "page_text"])

    return df.select(key, run(F.col(markup)).alias("p")).select(key, "p.*")


def title_of(markup: Column) -> Column:
    """The title alone, without leaving the JVM."""
    t = F.trim(F.regexp_extract(markup, r"(?is)<title[^>]*>(.*?)</title>", 1))
    return F.when(t != "", t)
