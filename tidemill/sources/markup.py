"""Feeds, pages and XML as rows.  Parsers are named functions of one document; Spark runs them over a column."""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
from collections.abc import Callable, Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ENTRY = "title string, link string, published string, summary string"
PARSERS: dict[str, Callable[[str], list[dict]]] = {}


def parser(name: str):
    def add(f):
        PARSERS[name] = f
        return f

    return add


def _local(tag: str) -> str:
    return tag.rpartition("}")[2].lower()


@parser("feed")
def feed_entries(text: str) -> list[dict]:
    """Entries of RSS, RDF or Atom, whatever the namespaces; a document that is no XML has none."""
    try:
        root = ET.fromstring(text.strip())
    except ET.ParseError:
        return []
    out = []
    for node in root.iter():
        if _local(node.tag) not in ("item", "entry"):
            continue
        got: dict[str, str] = {}
        for child in node:
            name, value = _local(child.tag), " ".join("".join(child.itertext()).split())
            if name == "link":
                value = child.get("href") or value
            field = {"title": "title", "link": "link", "pubdate": "published", "date": "published", "updated": "published", "published": "published", "description": "summary", "summary": "summary"}.get(name)
            if field and value and field not in got:
                got[field] = value
        if got.get("title") or got.get("link"):
            out.append(got)
    return out


class _Links(HTMLParser):
    """Links with their texts and the last date heading before them."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out, self.href, self.text, self.date, self.skip = [], None, [], "", 0

    def handle_starttag(self, tag, attrs):
        if tag in ("script", "style"):
            self.skip += 1
        elif tag == "a":
            self.href, self.text = dict(attrs).get("href"), []

    def handle_endtag(self, tag):
        if tag in ("script", "style") and self.skip:
            self.skip -= 1
        elif tag == "a" and self.href is not None:
            title = " ".join("".join(self.text).split())
            if title:
                self.out.append({"title": title, "link": self.href, "published": self.date, "summary": ""})
            self.href = None

    def handle_data(self, data):
        if self.skip:
            return
        if self.href is not None:
            self.text.append(data)
        elif m := re.search(r"([0-9]{4})[-/.年]([0-9]{1,2})[-/.月]([0-9]{1,2})", data):
            self.date = f"{m[1]}-{int(m[2]):02d}-{int(m[3]):02d}"


@parser("links")
def page_links(text: str) -> list[dict]:
    """Each link of a page, dated by the nearest date that stands before it."""
    p = _Links()
    p.feed(text)
    return p.out


class _Rows(HTMLParser):
    """Tables as rows of cells, with the first link of each row."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out, self.row, self.cell, self.link, self.caption, self.in_caption = [], None, None, None, "", False

    def handle_starttag(self, tag, attrs):
        if tag == "tr":
            self.row, self.link = [], None
        elif tag in ("td", "th"):
            self.cell = []
        elif tag == "caption":
            self.in_caption, self.caption = True, ""
        elif tag == "table":
            self.caption = ""
        elif tag == "a" and self.row is not None and self.link is None:
            self.link = dict(attrs).get("href")

    def handle_endtag(self, tag):
        if tag in ("td", "th") and self.row is not None and self.cell is not None:
            self.row.append(" ".join("".join(self.cell).split()))
            self.cell = None
        elif tag == "tr" and self.row:
            self.out.append({"title": self.row[1] if len(self.row) > 1 else self.row[0], "link": self.link or "", "published": self.row[0], "summary": " | ".join([self.caption, *self.row[2:]]).strip(" |")})
            self.row = None
        elif tag == "caption":
            self.in_caption = False

    def handle_data(self, data):
        if self.in_caption:
            self.caption += data.strip()
        elif self.cell is not None:
            self.cell.append(data)


@parser("rows")
def table_rows(text: str) -> list[dict]:
    """Rows of a page's tables: date, title and further cells, and the first link."""
    p = _Rows()
    p.feed(text)
    return p.out


def entries(df: DataFrame, content: str, kind: Column | str, keep: list[str]) -> DataFrame:
    """Rows of (``keep``, place, entry's fields) from documents; ``kind`` names each document's parser."""
    kind = F.lit(kind) if isinstance(kind, str) else kind
    schema = "array<struct<title:string,link:string,published:string,summary:string>>"

    @F.pandas_udf(schema)
    def parse(texts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for text, name in texts:
            yield pd.Series([[{k: e.get(k) for k in ("title", "link", "published", "summary")} for e in PARSERS[n](t or "")] for t, n in zip(text, name)])

    return df.select(*keep, F.posexplode(parse(content, kind)).alias("place", "e")).select(*keep, "place", "e.*")


def tag_text(html: Column, tag: str) -> Column:
    """Text of a page's first such element, by pattern alone: no parser, so it stays in the scan's stage."""
    inner = F.regexp_extract(html, f"(?is)<{tag}[^>]*>(.*?)</{tag}>", 1)
    return F.trim(F.regexp_replace(F.regexp_replace(inner, "<[^>]*>", " "), r"[\x20\x09-\x0D]+", " "))


def link_targets(html: Column) -> Column:
    return F.regexp_extract_all(html, F.lit('(?i)<a [^>]*href="([^"]*)"'), F.lit(1))


def is_maintenance(html: Column, words: list[str]) -> Column:
    """Whether the title, looked for in the first 20,000 characters, names maintenance."""
    from ..functions.rules import contains_any

    return contains_any(tag_text(F.substring(html, 1, 20_000), "title"), words)


def xml_records(df: DataFrame, content: str, tag: str, fields: dict[str, str], keep: list[str]) -> DataFrame:
    """One row for each element ``tag`` of XML documents, with the texts of named descendants; documents that are no XML have none."""
    from pyspark.sql import types as T

    row = T.StructType([T.StructField(f, T.StringType()) for f in fields])

    @F.pandas_udf(T.ArrayType(row))
    def parse(texts: pd.Series) -> pd.Series:
        def rows(text):
            try:
                root = ET.fromstring((text or "").strip())
            except ET.ParseError:
                return []
            named = lambda node, name: next((" ".join("".join(x.itertext()).split()) for x in node.iter() if _local(x.tag) == name.lower()), None)
            return [{f: named(node, name) for f, name in fields.items()} for node in root.iter() if _local(node.tag) == tag.lower()]

        return texts.map(rows)

    return df.select(*keep, F.posexplode(parse(content)).alias("place", "r")).select(*keep, "place", "r.*")


class _Blocks(HTMLParser):
    """Blocks of text with how much of each is link text; navigation and scripts are left out."""

    OUT = ("nav", "script", "style", "header", "footer", "aside", "form", "noscript")
    BREAK = ("p", "div", "li", "td", "th", "section", "article", "h1", "h2", "h3", "h4", "h5", "h6", "tr", "br", "dd", "dt")

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.blocks, self.text, self.linked, self.skip, self.in_link = [], [], 0, 0, 0

    def flush(self):
        value = " ".join("".join(self.text).split())
        if value:
            self.blocks.append((value, self.linked / max(1, len("".join(self.text)))))
        self.text, self.linked = [], 0

    def handle_starttag(self, tag, attrs):
        self.skip += tag in self.OUT
        self.in_link += tag == "a"
        if tag in self.BREAK:
            self.flush()

    def handle_endtag(self, tag):
        self.skip = max(0, self.skip - (tag in self.OUT))
        self.in_link = max(0, self.in_link - (tag == "a"))
        if tag in self.BREAK:
            self.flush()

    def handle_data(self, data):
        if not self.skip:
            self.text.append(data)
            self.linked += len(data) * bool(self.in_link)


def main_text(html: str | None, density: float = 0.65, least: int = 180, most: int = 4500) -> str | None:
    """A page's own text: blocks that are links for less than ``density``, adjacent repeats once, cut to ``most``; null below ``least``."""
    p = _Blocks()
    p.feed(html or "")
    p.flush()
    kept: list[str] = []
    for value, linked in p.blocks:
        if linked < density and (not kept or kept[-1] != value):
            kept.append(value)
    text = "\n".join(kept)[:most]
    return text if len(text) >= least else None


def page_text(html: Column, **limits) -> Column:
    from pyspark.sql import types as T

    @F.pandas_udf(T.StringType())
    def extract(pages: pd.Series) -> pd.Series:
        return pages.map(lambda h: main_text(h, **limits))

    return extract(html)
