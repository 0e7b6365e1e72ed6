"""Research articles: listing links, Markdown, labels."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Labels that a classifier may give; anything else is SKIP.
LABELS = ("SIGNAL", "EXIT", "RISK", "VALIDATION", "SKIP")


ARTICLE = re.compile(r"^/en/articles/(\d+)$")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())


class _Node:
    def __init__(self, tag: str, attrs: dict):
        self.tag, self.attrs, self.children = tag, attrs, []

    def inside(self) -> Iterator[_Node | str]:
        """Nodes and strings within this one, in order; the strings of scripts and the like only where it is one itself."""
        left = self.children[::-1]
        while left:
            x = left.pop()
            yield x
            if isinstance(x, _Node):
                left += [y for y in reversed(x.children) if x.tag not in ("script", "style", "template") or isinstance(y, _Node)]

    def first(self, tag: str, fits=lambda _: True) -> _Node | None:
        return next((x for x in self.inside() if isinstance(x, _Node) and x.tag == tag and fits(x)), None)

    def text(self) -> str:
        return "".join(x.strip() for x in self.inside() if isinstance(x, str))


def _tree(html: str) -> _Node:
    """The elements of a page; an end tag closes what is open within its element, one without a start is left out."""
    from html.parser import HTMLParser

    class Builder(HTMLParser):
        def __init__(self):
            super().__init__(convert_charrefs=True)
            self.open = [_Node("", {})]

        def handle_starttag(self, tag, attrs):
            node = _Node(tag, dict(attrs))
            self.open[-1].children.append(node)
            if tag not in VOID:
                self.open.append(node)

        def handle_endtag(self, tag):
            at = next((i for i in range(len(self.open) - 1, 0, -1) if self.open[i].tag == tag), None)
            if at:
                del self.open[at:]

        def handle_data(self, data):
            self.open[-1].children.append(data)

    b = Builder()
    b.feed(html)
    b.close()
    return b.open[0]


def listing(html: str | None) -> list[tuple[str, str, str, str]]:
    """id, href, title and description of the articles of a listing page: sections whose header links to /en/articles/<id>.

    A title of less than five characters gives way to the alt text of the link's image;
    without one the section is left out.  The description is the section's text outside
    the header, parts of more than 20 characters, up to 500 characters.
    """
    out = []
    for section in (x for x in _tree(html or "").inside() if isinstance(x, _Node) and x.tag == "section"):
        header = section.first("header")
        link = header and header.first("a", lambda x: ARTICLE.search(x.attrs.get("href") or ""))
        if not link:
            continue
        title = link.text()
        if len(title) < 5:
            img = link.first("img")
            title = (img and img.attrs.get("alt")) or ""
            if not title:
                continue
        parts = (x.strip() if isinstance(x, str) else x.text() for x in section.children if x is not header)
        href = link.attrs["href"]
        out.append((ARTICLE.match(href).group(1), href, title, " ".join(p for p in parts if len(p) > 20)[:500]))
    return out


def links(pages: DataFrame) -> DataFrame:
    """page_id, position, article_id, href, title, description of every article that a listing page links to."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["page_id", "position", "article_id", "href", "title", "description"]
        for b in batches:
            yield pd.DataFrame([(p, i, *x) for p, h in zip(b["page_id"], b["html"], strict=True) for i, x in enumerate(listing(h))], columns=names)

    return pages.select("page_id", "html").mapInPandas(run, "page_id long, position int, article_id string, href string, title string, description string")


def first_of(rows: DataFrame, key: str, order: tuple[str, ...]) -> DataFrame:
    """The first row of each key."""
    w = Window.partitionBy(key).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def normal_label(label: Column) -> Column:
    up = F.upper(F.trim(label))
    return F.when(up.isin(*LABELS), up).otherwise("SKIP")


def label_counts(rows: DataFrame) -> DataFrame:
    """Count and share in per cent of each label."""
    out = rows.groupBy("label").agg(F.count("*").alias("n"))
    return out.withColumn("pct", F.round(100.0 * F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(1))), 2))


def to_markdown(html: str | None) -> str:
    """Headings, paragraphs, code, lists, tables and links of a page as Markdown; scripts and styles go."""
    from html.parser import HTMLParser

    class Writer(HTMLParser):
        def __init__(self):
            super().__init__(convert_charrefs=True)
            self.out: list[str] = []
            self.line: list[str] = []
            self.skip = self.pre = 0
            self.lists: list[list] = []
            self.href: list[str | None] = []
            self.row: list[str] | None = None
            self.rows = 0

        def flush(self, before: str = "", after: str = "\n\n"):
            text = "".join(self.line) if self.pre else " ".join("".join(self.line).split())
            self.line = []
            if text:
                self.out.append(before + text + after)

        def handle_starttag(self, tag, attrs):
            a = dict(attrs)
            if tag in ("script", "style"):
                self.skip += 1
            elif tag == "pre":
                self.flush()
                self.pre += 1
            elif tag in ("ul", "ol"):
                self.flush()
                self.lists.append([tag, 0])
            elif tag == "table":
                self.flush()
                self.rows = 0
            elif tag == "tr":
                self.row = []
            elif tag == "a":
                self.href.append(a.get("href"))
                self.line.append("[")
            elif tag in ("p", "div", "li", "h1", "h2", "h3", "h4", "h5", "h6"):
                self.flush()
            elif tag == "br":
                self.line.append("\n")

        def handle_endtag(self, tag):
            if tag in ("script", "style"):
                self.skip = max(0, self.skip - 1)
            elif tag == "pre" and self.pre:
                body = "".join(self.line).strip("\n")
                self.line, self.pre = [], self.pre - 1
                self.out.append(f"```\n{body}\n```\n\n")
            elif tag in ("ul", "ol") and self.lists:
                self.flush()
                self.lists.pop()
            elif tag == "li":
                kind = self.lists[-1] if self.lists else ["ul", 0]
                kind[1] += 1
                self.flush("- " if kind[0] == "ul" else f"{kind[1]}. ", "\n")
            elif tag in ("td", "th") and self.row is not None:
                self.row.append(" ".join("".join(self.line).split()).replace("|", "\\|"))
                self.line = []
            elif tag == "tr" and self.row is not None:
                self.out.append("| " + " | ".join(self.row) + " |\n" + ("|" + " --- |" * len(self.row) + "\n" if not self.rows else ""))
                self.rows += 1
                self.row = None
            elif tag == "a" and self.href:
                self.line.append(f"]({self.href.pop() or ''})")
            elif tag[0] == "h" and tag[1:].isdigit():
                self.flush("#" * int(tag[1:]) + " ")
            elif tag in ("p", "div"):
                self.flush()

        def handle_data(self, data):
            if not self.skip:
                self.line.append(data)

    w = Writer()
    w.feed(html or "")
    w.close()
    w.flush()
    return "".join(w.out).strip()


def markdown(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """page_id and markdown, by an Arrow batch function: a parser is beyond column expressions."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"page_id": b["page_id"], "markdown": [to_markdown(h) for h in b[html_col]]})

    return pages.select("page_id", html_col).mapInPandas(run, "page_id long, markdown string")
