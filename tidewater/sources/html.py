"""HTML scans by the standard library's parser: text, headings, links and tables of pages.

Pages need not be well formed. An end tag closes the nearest open element of its name, one
without a start is ignored, and unclosed elements end with their parents. Scripts and styles
have no text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, StringType, StructField, StructType

from tidewater.functions.text import DEVANAGARI

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HEADINGS = ("h1", "h2", "h3", "h4")
SILENT = ("script", "style")
OWN_HINTS = ("title", "aria-label", "data-title", "data-label", "class", "id")
ANCESTOR_HINTS = ("class", "id", "data-section", "data-testid")
_DROPPED = re.compile(DEVANAGARI.replace(r"\x{0900}", "ऀ").replace(r"\x{097F}", "ॿ"))


def clean(text: str) -> str:
    return " ".join(_DROPPED.sub("", text).split())


class Node:
    __slots__ = ("tag", "attributes", "parent", "children")

    def __init__(self, tag: str, attributes: dict[str, str], parent: Node | None):
        self.tag, self.attributes, self.parent = tag, attributes, parent
        self.children: list[Node | str] = []

    def walk(self) -> Iterator[Node | str]:
        """Itself and all below, in document order, without recursion."""
        stack: list[Node | str] = [self]
        while stack:
            item = stack.pop()
            yield item
            if isinstance(item, Node):
                stack.extend(reversed(item.children))

    def find(self, *tags: str) -> Iterator[Node]:
        return (x for x in self.walk() if isinstance(x, Node) and x is not self and x.tag in tags)

    def text(self) -> str:
        parts: list[str] = []
        stack: list[Node | str] = [self]
        while stack:
            item = stack.pop()
            if isinstance(item, str):
                parts.append(item.strip())
            elif item.tag not in SILENT:
                stack.extend(reversed(item.children))
        return clean(" ".join(x for x in parts if x))


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("", {}, None)

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        node = Node(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.children.append(node)
        if tag not in VOID:
            self.at = node

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.at.children.append(Node(tag, {k: v or "" for k, v in attrs}, self.at))

    def handle_endtag(self, tag: str) -> None:
        node: Node | None = self.at
        while node is not None and node.tag != tag:
            node = node.parent
        if node is not None and node.parent is not None:
            self.at = node.parent

    def handle_data(self, data: str) -> None:
        self.at.children.append(data)


def tree(html: str | None) -> Node:
    builder = _Builder()
    builder.feed(html or "")
    builder.close()
    return builder.root


def description(heading: Node, enough: int = 400, most: int = 800) -> str:
    """The text between a heading and the next, in the same parent, once it is long enough."""
    siblings = heading.parent.children
    parts: list[str] = []
    for sibling in siblings[next(i for i, x in enumerate(siblings) if x is heading) + 1 :]:
        if isinstance(sibling, Node) and sibling.tag in HEADINGS:
            break
        text = clean(sibling) if isinstance(sibling, str) else sibling.text()
        if text:
            parts.append(text)
        if len(" ".join(parts)) > enough:
            break
    return " ".join(parts)[:most]


def headings(root: Node) -> list[dict]:
    out = []
    for node in root.find(*HEADINGS):
        anchor = next(node.find("a"), None)
        out.append({"level": node.tag, "title": node.text(), "href": anchor.attributes.get("href", "").strip() if anchor else "", "description": description(node)})
    return out


def links(root: Node, depth: int = 3) -> list[dict]:
    out = []
    for node in root.find("a"):
        if "href" not in node.attributes:
            continue
        ancestors, parent = [], node.parent
        while parent is not None and parent.tag and len(ancestors) < depth:
            ancestors.append(parent)
            parent = parent.parent
        out.append(
            {
                "href": node.attributes["href"].strip(),
                "text": node.text(),
                "attributes": [node.attributes[k] for k in OWN_HINTS if k in node.attributes],
                "ancestors": [a.attributes[k] for a in ancestors for k in ANCESTOR_HINTS if k in a.attributes],
            }
        )
    return out


def table(root: Node, table_id: str) -> dict | None:
    """Headers and rows of a table; null where it, its head or its body is missing. Rows without cells or text are left out."""
    node = next((t for t in root.find("table") if t.attributes.get("id") == table_id), None)
    head, body = (next(node.find(part), None) for part in ("thead", "tbody")) if node else (None, None)
    if head is None or body is None:
        return None
    names = [th.text() for th in head.find("th")]
    rows = []
    for tr in body.find("tr"):
        cells = [td.text() for td in tr.find("td")]
        if any(cells):
            rows.append((cells + [""] * len(names))[: len(names)])
    return {"headers": names, "rows": rows}


_TEXTS = ArrayType(StringType())


def _records(*texts: str, **lists: DataType) -> ArrayType:
    return ArrayType(StructType([StructField(n, StringType()) for n in texts] + [StructField(n, kind) for n, kind in lists.items()]))


@F.pandas_udf(StringType())
def page_text(html: pd.Series) -> pd.Series:
    return html.map(lambda x: tree(x).text())


@F.pandas_udf(_records("level", "title", "href", "description"))
def page_headings(html: pd.Series) -> pd.Series:
    return html.map(lambda x: headings(tree(x)))


@F.pandas_udf(_records("href", "text", attributes=_TEXTS, ancestors=_TEXTS))
def page_links(html: pd.Series) -> pd.Series:
    return html.map(lambda x: links(tree(x)))


#: Pages whose results are held at a time.
CHUNK = 64


def scan(html: str | None) -> dict:
    """Text, headings and links of a page that is parsed once. Its tree goes at once: parents and children hold each other until they are parted."""
    root = tree(html)
    out = {"text": root.text(), "headings": headings(root), "links": links(root)}
    for node in root.walk():
        if isinstance(node, Node):
            node.parent = None
    return out


_SCAN = StructType(
    [
        StructField("text", StringType()),
        StructField("headings", _records("level", "title", "href", "description")),
        StructField("links", _records("href", "text", attributes=_TEXTS, ancestors=_TEXTS)),
    ]
)


@F.pandas_udf(_SCAN)
def page_scan(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    """``scan`` of each page, a few at a time, however many pages a batch has."""
    for html in batches:
        for start in range(0, len(html), CHUNK):
            found = [scan(x) for x in html.iloc[start : start + CHUNK]]
            yield pd.DataFrame({name: pd.Series([f[name] for f in found], dtype=object) for name in _SCAN.names})


def page_table(html: Column, table_id: str) -> Column:
    """struct<headers, rows> of the table with that id, or null."""

    @F.pandas_udf(StructType([StructField("headers", _TEXTS), StructField("rows", ArrayType(_TEXTS))]))
    def scan(pages: pd.Series) -> pd.DataFrame:
        found = [table(tree(x), table_id) or {"headers": None, "rows": None} for x in pages]
        return pd.DataFrame({"headers": pd.Series([f["headers"] for f in found], dtype=object), "rows": pd.Series([f["rows"] for f in found], dtype=object)})

    return scan(html)


def table_rows(pages: DataFrame, table_id: str, html: str = "html", strict: bool = False) -> DataFrame:
    """A row (all columns of ``pages`` but the html, pos, cells map<header, text>) for each table row.

    Of equal headers the last counts. With ``strict`` a page without the table is an error.
    """
    scanned = pages.withColumn("_t", page_table(F.col(html), table_id))
    if strict:
        missing = F.raise_error(F.lit(f"no table '{table_id}' with a head and a body"))
        scanned = scanned.withColumn("_t", F.when(F.col("_t.headers").isNotNull(), F.col("_t")).otherwise(missing.cast("struct<headers:array<string>,rows:array<array<string>>>")))
    names = [c for c in pages.columns if c != html]
    # Apart before they are exploded, or each row would carry the whole table along.
    parts = scanned.select(*names, F.col("_t.headers").alias("_h"), F.col("_t.rows").alias("_rows"))
    rows = parts.select(*names, "_h", F.posexplode("_rows").alias("pos", "_r"))
    last = F.filter(F.arrays_zip(F.col("_h").alias("k"), F.col("_r").alias("v")), lambda e, i: ~F.array_contains(F.slice("_h", i + 2, F.size("_h")), e["k"]))
    return rows.select(*names, "pos", F.map_from_entries(last).alias("cells"))
