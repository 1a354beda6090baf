"""Article fields and links out of raw HTML, by the standard library's parser in Arrow batches."""

from __future__ import annotations

import json
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

ARTICLES = {"NewsArticle", "Article"}


class _Page(HTMLParser):
    """Collects h1, title, p, time, meta, JSON-LD scripts and links. A new p ends the one before it."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.texts: dict[str, list[str]] = {"h1": [], "title": [], "p": [], "time": []}
        self.meta: dict[str, str] = {}
        self.scripts: list[str] = []
        self.links: list[str] = []
        self.open: dict[str, list[str]] = {}
        self.script: list[str] | None = None
        self.plain = 0

    def handle_starttag(self, tag, attrs):
        at = {k: v or "" for k, v in attrs}
        if tag == "script":
            self.script = [] if at.get("type", "").lower() == "application/ld+json" else None
            self.plain += self.script is None
        elif tag == "style":
            self.plain += 1
        elif tag == "meta":
            name = at.get("property") or at.get("name")
            if name:
                self.meta.setdefault(name, at.get("content", ""))
        elif tag == "a" and at.get("href"):
            self.links.append(at["href"])
        if tag in self.texts:
            self._end(tag)
            self.open[tag] = []

    def handle_endtag(self, tag):
        if tag == "script":
            if self.script is not None:
                self.scripts.append("".join(self.script))
                self.script = None
            elif self.plain:
                self.plain -= 1
        elif tag == "style" and self.plain:
            self.plain -= 1
        elif tag in self.open:
            self._end(tag)

    def _end(self, tag):
        if tag in self.open:
            self.texts[tag].append("".join(self.open.pop(tag)).strip())

    def handle_data(self, data):
        if self.script is not None:
            self.script.append(data)
        elif not self.plain:
            for x in self.open.values():
                x.append(data)

    def close(self):
        super().close()
        for tag in list(self.open):
            self._end(tag)


def page(source: str) -> _Page:
    made = _Page()
    made.feed(source)
    made.close()
    return made


def author_name(value) -> str | None:
    """A dictionary's name, the first of a list, or the thing itself."""
    if isinstance(value, list):
        value = value[0] if value else None
    if isinstance(value, dict):
        value = value.get("name")
    return None if value is None else str(value)


def _json_article(scripts: list[str]) -> dict | None:
    for text in scripts:
        try:
            found = json.loads(text, strict=False)  # bodies may hold raw line ends
        except ValueError:
            continue
        todo = found if isinstance(found, list) else [found]
        todo = [y for x in todo if isinstance(x, dict) for y in (x["@graph"] if isinstance(x.get("@graph"), list) else [x]) if isinstance(y, dict)]
        for x in todo:
            kind = x.get("@type")
            if ARTICLES & set(kind if isinstance(kind, list) else [kind]) and x.get("headline") and x.get("articleBody"):
                return x
    return None


def article(source: str | None) -> tuple:
    """(date, title, body, author): from JSON-LD, else from h1 or title, meta or time, and the paragraphs of over 30 characters."""
    if source is None:
        return None, None, None, None
    p = page(source)
    x = _json_article(p.scripts)
    if x:
        date, title, body = (None if v is None else str(v).strip() for v in (x.get("datePublished"), x["headline"], x["articleBody"]))
        return date, title, body, author_name(x.get("author"))
    title = next((t for t in [*p.texts["h1"], *p.texts["title"]] if t), None)
    date = p.meta.get("article:published_time") or next((t for t in p.texts["time"] if t), None)
    body = "\n".join(t for t in p.texts["p"] if len(t) > 30) or None
    return date, title, body, p.meta.get("author")


def _fields(source: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([article(x) for x in source], columns=["date", "title", "body", "author"], dtype=object)


def article_fields(source) -> Column:
    """struct(date, title, body, author) of a page's HTML."""
    return F.pandas_udf(_fields, "date string, title string, body string, author string")(source)


def _links(source: pd.Series) -> pd.Series:
    return source.map(lambda x: [] if x is None else list(dict.fromkeys(page(x).links)))


def page_links(source) -> Column:
    """Links in order, each where it is first seen."""
    return F.pandas_udf(_links, "array<string>")(source)
