"""HTML: text, articles, elements and tables, by the standard library's parser in Arrow batches."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.operators.search import importable

#: Elements without readable text, elements that end a line, elements that have no end tag.
HIDDEN = {"script", "style", "nav", "footer", "header", "ix:header", "head"}
BLOCKS = {"p", "div", "li", "tr", "br", "h1", "h2", "h3", "h4", "h5", "h6", "article", "section", "table", "ul", "ol"}
VOID = {"br", "img", "meta", "link", "input", "hr", "area", "base", "col", "embed", "source", "track", "wbr"}
ROLES = {"h1": "Title", "h2": "Title", "h3": "Title", "h4": "Title", "p": "NarrativeText", "li": "Text", "div": "Text"}
_BLANKS = re.compile(r"\s+")


class _Reader(HTMLParser):
    """Walks a page once: text by line, elements with their role, tables as rows of cells."""

    def __init__(self, within: str | None = None):
        super().__init__(convert_charrefs=True)
        self.within, self.depth = within, 0 if within else 1
        self.stack: list[tuple[str, bool]] = []
        self.hidden = 0
        self.lines: list[list[str]] = [[]]
        self.elements: list[tuple[str, str]] = []
        self.tables: list[list[list[str]]] = []
        self.open_tables: list[list[list[list[str]]]] = []
        self.role = "Text"

    def _break(self, role: str = "Text") -> None:
        text = _BLANKS.sub(" ", "".join(self.lines[-1])).strip()
        if text and not self.open_tables:
            self.elements.append((self.role, text))
        if self.lines[-1]:
            self.lines.append([])
        self.role = role

    def handle_starttag(self, tag, attrs):
        style = (dict(attrs).get("style") or "").replace(" ", "").lower()
        hides = tag in HIDDEN or "display:none" in style
        if tag in BLOCKS:
            self._break(ROLES.get(tag, "Text"))
        if tag == "table":
            self.open_tables.append([])
        elif self.open_tables and tag == "tr":
            self.open_tables[-1].append([])
        elif self.open_tables and tag in ("td", "th"):
            if not self.open_tables[-1]:
                self.open_tables[-1].append([])
            self.open_tables[-1][-1].append([])
        if tag in VOID:
            return
        self.stack.append((tag, hides))
        self.hidden += hides
        if tag == self.within:
            self.depth += 1

    def handle_endtag(self, tag):
        if tag not in [t for t, _ in self.stack]:
            return
        while True:
            last, hides = self.stack.pop()
            self.hidden -= hides
            if last == self.within:
                self.depth -= 1
            if last == "table" and self.open_tables:
                rows = [[_BLANKS.sub(" ", "".join(c)).strip() for c in r] for r in self.open_tables.pop()]
                rows = [r for r in rows if any(r)]
                self._break()
                if rows and not self.open_tables:
                    self.tables.append(rows)
                    self.elements.append(("Table", markdown(rows)))
            if last == tag:
                break
        if tag in BLOCKS:
            self._break()

    def handle_data(self, data):
        if self.hidden or self.depth < 1:
            return
        self.lines[-1].append(data)
        for t in self.open_tables:
            if t and t[-1]:
                t[-1][-1].append(data)


def _read(html: str | None, within: str | None = None) -> _Reader:
    r = _Reader(within)
    r.feed(html or "")
    r.close()
    r._break()
    return r


def markdown(rows: list[list[str]]) -> str:
    """A table as Markdown; short rows are padded, bars within cells become slashes."""
    n = max(map(len, rows))
    line = lambda cells: "| " + " | ".join(c.replace("|", "/") for c in cells) + " |"
    padded = [r + [""] * (n - len(r)) for r in rows]
    return "\n".join([line(padded[0]), line(["---"] * n), *map(line, padded[1:])])


def text_of(html: str | None, within: str | None = None) -> str:
    """Readable text, a line for each block."""
    lines = (_BLANKS.sub(" ", "".join(x)).strip() for x in _read(html, within).lines)
    return "\n".join(x for x in lines if x)


def article_of(html: str | None, least: int = 200, paragraph: int = 50) -> str | None:
    """Text of the article element, else of paragraphs longer than ``paragraph``; null up to ``least`` characters."""
    found = text_of(html, "article")
    if len(found) <= least:
        found = "\n".join(t for role, t in _read(html).elements if role == "NarrativeText" and len(t) > paragraph)
    return found if len(found) > least else None


def table_markdown(html: str | None) -> str | None:
    """The first table as Markdown, or null."""
    tables = _read(html).tables
    return markdown(tables[0]) if tables else None


def parse_pages(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(id, text, article, table_md, elements array<struct<role, text>>) of each page; null html has no text."""
    importable(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))
        for b in batches:
            htmls = b.column(1).to_pylist()
            elements = [[{"role": r, "text": t} for r, t in _read(h).elements] for h in htmls]
            cols = [b.column(0), *(pa.array([f(h) for h in htmls], pa.string()) for f in (text_of, article_of, table_markdown)), pa.array(elements, kind)]
            yield pa.RecordBatch.from_arrays(cols, names=["id", "text", "article", "table_md", "elements"])

    return pages.select(F.col(id_col).cast("long").alias("id"), F.col(html_col).alias("html")).mapInArrow(run, "id long, text string, article string, table_md string, elements array<struct<role:string,text:string>>")
