"""HTML pages to title, description, main text and links, as one Arrow-batched function."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakesearch.sources.workers import ship

# Elements that never hold content, elements without an end tag, and blocks of text.
REMOVED = {"script", "style", "nav", "footer", "header", "aside", "noscript", "iframe", "svg", "canvas", "form", "input", "button", "select", "textarea"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
BLOCKS = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "blockquote", "pre", "li"}
#: What an opening element ends if it is still open.
ENDS = {"p": {"p"}, "li": {"li", "p"}, **{b: {"p"} for b in ("h1", "h2", "h3", "h4", "h5", "h6", "blockquote", "pre", "ul", "ol", "div", "table", "article", "main", "section")}}

SCHEMA = "url string, title string, description string, body_text string, links array<struct<url:string,anchor:string>>, text_length int"


class Node:
    __slots__ = ("children", "attrs", "name")

    def __init__(self, name: str, attrs: dict[str, str | None]):
        self.name, self.attrs, self.children = name, attrs, []

    def walk(self) -> Iterator[Node]:
        todo = [self]
        while todo:
            node = todo.pop()
            yield node
            todo.extend(c for c in reversed(node.children) if isinstance(c, Node))

    def strings(self) -> list[str]:
        """The texts below, stripped, blank ones left out, in document order."""
        out, todo = [], [self]
        while todo:
            node = todo.pop()
            if isinstance(node, str):
                if text := node.strip():
                    out.append(text)
            else:
                todo.extend(reversed(node.children))
        return out


class _Tree(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = Node("", {})
        self.path = [self.root]

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        ends = ENDS.get(tag, ())
        while len(self.path) > 1 and self.path[-1].name in ends:
            self.path.pop()
        node = Node(tag, dict(attrs))
        self.path[-1].children.append(node)
        if tag not in VOID:
            self.path.append(node)

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.path[-1].children.append(Node(tag, dict(attrs)))

    def handle_endtag(self, tag: str) -> None:
        for i in range(len(self.path) - 1, 0, -1):
            if self.path[i].name == tag:
                del self.path[i:]
                return

    def handle_data(self, data: str) -> None:
        self.path[-1].children.append(data)


def tree(page: str) -> Node:
    """The page's elements; comments are left out, unclosed paragraphs and items end where the next begins."""
    builder = _Tree()
    builder.feed(page)
    builder.close()
    return builder.root


def _main(root: Node) -> str:
    first = next((n for name in ("article", "main") for n in root.walk() if n.name == name), None)
    if first:
        parts = [s for s in first.strings() if len(s) > 1]
        if sum(map(len, parts)) >= 100:
            return "\n".join(parts)
    blocks = []
    for node in root.walk():
        if node.name in BLOCKS:
            text = " ".join(node.strings())
            linked = sum(len(" ".join(a.strings())) for a in node.walk() if a.name == "a")
            if len(text) >= 20 and linked <= 0.6 * len(text):
                blocks.append(text)
    if len(blocks) >= 2:
        return "\n".join(blocks)
    body = next((n for n in root.walk() if n.name == "body"), root)
    return "\n".join(s for s in body.strings() if len(s) > 1)


def parse(url: str, page: str | None, longest_url: int = 2048, longest_body: int = 50_000) -> tuple:
    """(url, title, description, body_text, links, text_length); all empty for a null page."""
    if page is None:
        return url, "", "", "", [], 0
    try:
        root = tree(page)
    except Exception:  # noqa: BLE001 - a page that can't be parsed keeps its raw beginning
        return url, "", "", page[:5000], [], min(len(page), 5000)
    title = next((n for n in root.walk() if n.name == "title"), None)
    described = next((n for n in root.walk() if n.name == "meta" and (n.attrs.get("name") or "").lower() == "description"), None)
    for node in list(root.walk()):
        node.children = [c for c in node.children if not (isinstance(c, Node) and c.name in REMOVED)]
    links: dict[str, str] = {}
    for a in root.walk():
        href = (a.attrs.get("href") or "").strip() if a.name == "a" else ""
        if href and not href.startswith(("#", "javascript:", "mailto:", "tel:")):
            try:
                target = urljoin(url or "", href)
            except ValueError:
                continue
            if len(target) <= longest_url:
                links.setdefault(target, " ".join(a.strings())[:100])
    text = _main(root)
    return url, "".join(title.strings())[:200] if title else "", ((described.attrs.get("content") or "").strip()[:500] if described else ""), text[:longest_body], [{"url": u, "anchor": x} for u, x in links.items()], len(text)


def decode(raw: bytes | None, charset: str | None) -> str | None:
    """Bytes as text: unknown charsets as UTF-8, undecodable bytes as the replacement character."""
    if raw is None:
        return None
    try:
        return raw.decode(charset or "utf-8", "replace")
    except LookupError:
        return raw.decode("utf-8", "replace")


def fast_title(page: F.Column) -> F.Column:
    """The first <title> by pattern alone."""
    return F.trim(F.regexp_extract(page, r"(?is)<title[^>]*>(.*?)</title>", 1))


def parsed(pages: DataFrame, url: str = "url", page: str = "html") -> DataFrame:
    """`pages` with a struct column `page` of SCHEMA."""

    @F.pandas_udf(SCHEMA)
    def run(u: pd.Series, h: pd.Series) -> pd.DataFrame:
        rows = [parse(a, b) for a, b in zip(u, h, strict=True)]
        return pd.DataFrame(rows, columns=re.findall(r"(\w+) (?:string|array|int)", SCHEMA))

    ship(pages.sparkSession)
    return pages.withColumn("page", run(F.col(url), F.col(page)))
