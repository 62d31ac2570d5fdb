"""Web pages as a source: checks, links, hosts, and the clauses under their headings."""

from __future__ import annotations

import re
from collections.abc import Sequence
from html.parser import HTMLParser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_BYTES, HEAD_CHARS, MIN_TEXT, SHORT_HEADING = 20 * 1024 * 1024, 2048, 150, 90
_SKIPPED = ("script", "style", "nav", "form", "iframe", "noscript", "footer")


def looks_like_page(html: Column) -> Column:
    head = F.lower(F.substring(html, 1, HEAD_CHARS))
    return head.contains("<html") | head.contains("<!doctype")


def raw_title(html: Column) -> Column:
    return F.trim(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1))


def links(pages: DataFrame, html: str = "html", keep: Sequence[str] = ("page_id",)) -> DataFrame:
    """keep, href of every link."""
    return pages.select(*keep, F.explode(F.regexp_extract_all(F.col(html), F.lit(r'(?is)<a\s[^>]*href="([^"]*)"'), F.lit(1))).alias("href"))


def allowed(pages: DataFrame, domains: Sequence[str], url: str = "url") -> DataFrame:
    """Pages whose host is one of the domains or below one, with their host."""
    out = pages.withColumn("host", F.regexp_extract(url, r"^[a-z]+://([^/?#:]+)", 1))
    test = F.lit(False)
    for d in domains:
        test = test | (F.col("host") == d) | F.col("host").endswith(f".{d}")
    return out.where(test)


class _Blocks(HTMLParser):
    """Headings and paragraphs of a page's article, main part or body, in order."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.blocks: list[tuple[str, str, bool]] = []
        self.kind, self.text, self.bold, self.plain, self.skip, self.inside = "p", [], 0, False, 0, 0

    def flush(self) -> None:
        text = re.sub(r"\s+", " ", "".join(self.text)).strip()
        if text:
            self.blocks.append((self.kind, text, not self.plain))
        self.kind, self.text, self.plain = "p", [], False

    def handle_starttag(self, tag, attrs):
        if tag in _SKIPPED:
            self.skip += 1
        elif re.fullmatch(r"h[1-5]|p|li|div|article|section|td|tr", tag):
            self.flush()
            self.kind = tag if tag in ("h1", "h2", "h3", "h4", "h5", "li") else "p"
        elif tag == "br":
            self.text.append(" ")
        elif tag in ("b", "strong"):
            self.bold += 1

    def handle_endtag(self, tag):
        if tag in _SKIPPED:
            self.skip = max(0, self.skip - 1)
        elif re.fullmatch(r"h[1-5]|p|li|div|article|section|td|tr", tag):
            self.flush()
        elif tag in ("b", "strong"):
            self.bold = max(0, self.bold - 1)

    def handle_data(self, data):
        if not self.skip:
            self.text.append(data)
            self.plain |= bool(data.strip()) and not self.bold


def _area(html: str, tag: str) -> str | None:
    """The first element of this tag, up to the closing tag that matches; none where it isn't closed."""
    start, depth = None, 0
    for found in re.finditer(rf"(?i)<(/?){tag}\b[^>]*>", html):
        if not found[1]:
            start, depth = found.start() if start is None else start, depth + 1
        elif depth:
            depth -= 1
            if not depth:
                return html[start : found.end()]
    return None


def page_clauses(html: str) -> list[tuple[str, str, str]]:
    """(number, heading, text): the first h1 is the title; later headings and short bold paragraphs open clauses "§n"."""
    body = _area(html, "main") or _area(html, "article")
    parser = _Blocks()
    parser.feed(body if body else re.sub(r"(?is)<head\b.*?</head\s*>", "", html))
    parser.flush()
    out: list[list[str]] = [["front", "", ""]]
    title_seen = False
    for kind, text, bold in parser.blocks:
        if kind == "h1" and not title_seen:
            out[0][1], title_seen = text, True
        elif kind.startswith("h") or (kind == "p" and bold and len(text) < SHORT_HEADING and text[-1] not in ".:"):
            out.append([f"§{len(out)}", text, ""])
        else:
            line = f"• {text}" if kind == "li" else text
            out[-1][2] += ("\n\n" if out[-1][2] else "") + line
    return [tuple(c) for c in out if c[2] or c[1]]


def clauses(pages: DataFrame, id_col: str = "page_id", html: str = "html") -> DataFrame:
    """(id, ord, number, heading, text) of every page with at least 150 characters of text; others have no clause."""

    def run(frames):
        import pandas as pd

        for frame in frames:
            rows = []
            for key, page in zip(frame[id_col], frame[html]):
                found = page_clauses(page or "")
                if sum(len(c[2]) for c in found) >= MIN_TEXT:
                    rows += [(key, i, *c) for i, c in enumerate(found)]
            yield pd.DataFrame(rows, columns=[id_col, "ord", "number", "heading", "text"])

    kind = pages.schema[id_col].dataType.simpleString()
    return pages.select(id_col, html).mapInPandas(run, f"{id_col} {kind}, ord int, number string, heading string, text string")
