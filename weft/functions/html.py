"""Fields of a page: title, body and snippet text, meta terms, links and anchor texts."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Elements without content, elements whose direct text is no body text, and subtrees that snippets leave out.
VOID = frozenset(("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"))
NO_BODY = frozenset(("title", "script", "style", "noscript", "iframe"))
NO_SNIPPET = NO_BODY | {"a", "nav"}
META_NAMES = frozenset(("description", "keywords", "author"))

FIELDS = "doc_id string, url string, title string, body string, snippet_text string, meta array<string>, anchors array<struct<href:string,text:string>>, hrefs array<string>"


_RAW = re.compile(r"(<(script|style)\b[^>]*>).*?(?=</\2\s*>|\Z)", re.S | re.I)
_PIECE = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|<[!?/][^>]*>|([^<]+|<)", re.S)
_ATTR = re.compile(r"""([^\s=/"'>]+)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")


class PageFields:
    """Reads one page. Text belongs to the innermost element that is open; an end tag closes up to its start tag, if there is one."""

    def __init__(self, page: str) -> None:
        self.title, self.body, self.snippet, self.meta, self.anchors, self.hrefs = "", [], [], [], [], []
        tags: list[str] = []
        hrefs: list[str | None] = []
        hidden = 0  # open elements that snippets leave out
        fresh_title = False
        for close, tag, attrs, words in _PIECE.findall(_RAW.sub(r"\1", page)):
            if words:
                text = (html.unescape(words) if "&" in words else words).strip()
                inner = tags[-1] if tags else ""
                if inner == "title" and fresh_title:
                    self.title, fresh_title = text, False
                if not text:
                    continue
                if inner not in NO_BODY:
                    self.body.append(text)
                if not hidden:
                    self.snippet.append(text)
                if inner == "a" and hrefs[-1] is not None:
                    self.anchors.append((hrefs[-1], text))
            elif tag:
                tag = tag.lower()
                if close:
                    if tag in tags:
                        at = len(tags) - 1 - tags[::-1].index(tag)
                        hidden -= sum(t in NO_SNIPPET for t in tags[at:])
                        del tags[at:], hrefs[at:]
                    continue
                values: dict[str, str] = {}
                if tag in ("a", "meta"):
                    for name, x, y, z in _ATTR.findall(attrs):
                        values.setdefault(name.lower(), html.unescape(x or y or z))
                if tag == "meta" and values.get("name") in META_NAMES:
                    self.meta.append(values.get("content", ""))
                href = values.get("href")
                if href is not None:
                    self.hrefs.append(href)
                if tag == "title":
                    fresh_title = True
                if tag not in VOID:
                    tags.append(tag)
                    hrefs.append(href)
                    hidden += tag in NO_SNIPPET


def fields_of(page: str) -> PageFields:
    return PageFields(page)


def _extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        out = []
        for h in b["html"].tolist():
            p = fields_of(h or "")
            out.append((p.title, " ".join(p.body), " ".join(p.snippet), p.meta, [{"href": x, "text": t} for x, t in p.anchors], p.hrefs))
        fields = pd.DataFrame(out, columns=["title", "body", "snippet_text", "meta", "anchors", "hrefs"])
        yield pd.concat([b.drop(columns="html").reset_index(drop=True), fields], axis=1)


def extract_fields(pages: DataFrame, *keep: str) -> DataFrame:
    """The fields of every row of ``pages`` (doc_id, url, html), and the columns ``keep``. A null page has empty fields. Of several titles the last counts, by its first
    text; of meta elements those named description, keywords and author, whose names are compared as written."""
    kept = "".join(f", {c} {pages.schema[c].dataType.simpleString()}" for c in keep)
    return pages.select("doc_id", "url", *keep, "html").mapInPandas(_extract, FIELDS + kept)


def page_size(pages: DataFrame) -> DataFrame:
    """Adds page_size: content_length, else the bytes of html, else 0."""
    return pages.withColumn("page_size", F.coalesce(F.col("content_length").cast("bigint"), F.octet_length("html").cast("bigint"), F.lit(0).cast("bigint")))
