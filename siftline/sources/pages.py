"""Captured pages: HTML to navigation signals and the extraction document, in one Arrow pass.

The page table stands where a browser would: url and html are captured already. One parse
yields both the anchors for discovery and the document for extraction.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterator, Sequence
from html.parser import HTMLParser
from itertools import accumulate, islice
from operator import attrgetter
from urllib.parse import urljoin

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftline.plans.schemas import PARSED

# How much of a page a bounded parse takes.
TEXT_CHARS, ITEMS, LINKS = 200_000, 500, 200
HREF_CHARS, LABEL_CHARS, REL_CHARS, META_CHARS, CELL_CHARS = 2048, 240, 120, 2000, 2000
# How much of a block's text and of a title any parse takes.
BLOCK_CHARS, TITLE_CHARS = 4000, 500
BLOCK_TAGS = ("article", "li")
BLOCK_CLASS = re.compile(r"card|product")
# Elements of HTML.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
SILENT = {"script", "style", "noscript", "template", "head", "title"}
BREAKING = {
    "address", "article", "aside", "blockquote", "br", "dd", "div", "dl", "dt", "fieldset", "figure", "footer", "form", "h1", "h2",
    "h3", "h4", "h5", "h6", "header", "hr", "li", "main", "nav", "ol", "p", "pre", "section", "table", "td", "th", "tr", "ul",
}
#: Open elements that an opening tag ends, if they are in its scope.
ENDS = {
    "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "option": ("option",), "a": ("a",), "tr": ("tr",), "td": ("td", "th"), "th": ("td", "th"),
    "thead": ("thead", "tbody", "tfoot"), "tbody": ("thead", "tbody", "tfoot"), "tfoot": ("thead", "tbody", "tfoot"),
    **{x: ("p",) for x in BREAKING - {"br", "li", "dt", "dd", "tr", "td", "th"}},
}
#: Elements that a tag doesn't reach through: those that hold content of their own, and for items the lists and sections too.
WALLS = {"table", "td", "th", "caption", "template", "object", "button"}
ITEM_WALLS = WALLS | {"ul", "ol", "menu", "dl", "article", "section", "aside", "nav", "header", "footer", "main", "figure", "form", "fieldset", "blockquote", "details"}
ITEMS_OF_LISTS = {"li", "dt", "dd"}
PARTS_OF_TABLES = {"tr", "td", "th", "thead", "tbody", "tfoot", "caption"}

#: Characters that a bounded parse cuts the cells of a page's tables to in all: tables in tables repeat the inner cells.
TABLE_CHARS = 2_000_000

#: Bytes of HTML whose parses a worker holds at once: blocks and tables repeat a page's text many times over.
PARSE_BYTES = 1 << 18

_SPACE = re.compile(r"\s+")
#: An ampersand that begins no reference closed by a semicolon, and characters that can stand for it (one that the page doesn't hold).
_LOOSE = re.compile(r"&(?!(?:[A-Za-z][A-Za-z0-9]*|#[0-9]+|#[xX][0-9A-Fa-f]+);)")
_STANDS = (*range(0xFDD0, 0xFDF0), *range(0xE000, 0xF900))


class _Text:
    """A text without extra space, cut by places in the text as it was read."""

    def __init__(self, parts: list[str]):
        read = "".join(parts)
        self.clean = _SPACE.sub(" ", read)
        runs = [m.span() for m in _SPACE.finditer(read) if m.end() - m.start() > 1]
        self.starts = [a for a, _ in runs]
        self.ends = [b for _, b in runs]
        self.less = list(accumulate((b - a - 1 for a, b in runs), initial=0))

    def _place(self, at: int) -> int:
        i = bisect_right(self.starts, at - 1)  # runs that begin before
        if i and at < self.ends[i - 1]:
            return self.starts[i - 1] - self.less[i - 1] + 1
        return at - self.less[i]

    def cut(self, start: int, end: int, most: int | None = None) -> str:
        """The text between two places, without space at its ends, up to a number of characters if one is given."""
        a, b = self._place(start), self._place(end)
        a += a < b and self.clean[a] == " "
        b -= a < b and self.clean[b - 1] == " "
        return self.clean[a : b if most is None else min(b, a + most)]


class _Node:
    """An element: its place in document order, its last descendant's, and where its text begins and ends."""

    __slots__ = ("tag", "have", "at", "last", "start", "end")

    def __init__(self, tag: str, have: dict[str, str], at: int, start: int):
        self.tag, self.have, self.at, self.last, self.start, self.end = tag, have, at, at, start, start


class _Nodes(list):
    """Nodes in document order."""

    def inside(self, node: _Node) -> Iterator[_Node]:
        """The nodes among these that are descendants of a node, in order."""
        i = bisect_right(self, node.at, key=attrgetter("at"))
        while i < len(self) and self[i].at <= node.last:
            yield self[i]
            i += 1


class _Page(HTMLParser):
    """A page as one text and a flat table of the nodes that matter, each an interval of both.

    Which open element a tag ends is told by the depths of open elements of its kind and of
    the walls between, so a tag costs what it closes, at any nesting.
    """

    def __init__(self, url: str, ampersand: str | None = None):
        """`ampersand` is a character that stands for one in what is fed."""
        super().__init__(convert_charrefs=True)
        self.url, self.stack, self.count, self.ampersand = url, [], 0, ampersand
        self.depths: dict[str, list[int]] = defaultdict(list)
        self.walls: list[int] = []
        self.item_walls: list[int] = []
        self.silent = self.said = 0
        self.text: list[str] = []
        self.title: list[str] = []
        self.json_ld: list[str] = []
        self.open_graph: dict[str, str] = {}
        self.script: list[str] | None = None
        self.kept = {x: _Nodes() for x in ("anchor", "image", "block", "table", "tr", "td", "th")}

    def handle_starttag(self, tag: str, attrs) -> None:
        have = {k: self._read(v or "") for k, v in attrs}
        for ended in ENDS.get(tag, ()):
            self._end(ended, tag)
        if tag in BREAKING:
            self._say("\n")
        node = _Node(tag, have, self.count, self.said)
        self.count += 1
        if tag == "script":
            self.script = [] if have.get("type", "").strip().lower() == "application/ld+json" else None
        elif tag == "meta":
            name = have.get("property", "")
            if name.startswith("og:") and have.get("content"):
                self.open_graph.setdefault(name[3:], have["content"])
        elif tag == "a" and "href" in have:
            self.kept["anchor"].append(node)
        elif tag == "img" and "src" in have:
            self.kept["image"].append(node)
        elif tag in ("table", "tr", "td", "th"):
            self.kept[tag].append(node)
        if tag in BLOCK_TAGS or have.get("role") == "article" or BLOCK_CLASS.search(have.get("class", "")):
            self.kept["block"].append(node)
        if tag in VOID:
            return
        depth = len(self.stack)
        self.stack.append(node)
        self.depths[tag].append(depth)
        self.silent += tag in SILENT
        if tag in WALLS:
            self.walls.append(depth)
        if tag in ITEM_WALLS:
            self.item_walls.append(depth)

    def handle_startendtag(self, tag: str, attrs) -> None:
        self.handle_starttag(tag, attrs)  # the slash means nothing in HTML

    def handle_endtag(self, tag: str) -> None:
        self._end(tag, tag)
        if tag in BREAKING:
            self._say("\n")

    def _end(self, tag: str, by: str) -> None:
        """Close the innermost open element of a kind, and what is open in it, unless a wall stands between."""
        if not self.depths[tag]:
            return
        depth = self.depths[tag][-1]
        if by in PARTS_OF_TABLES:
            walls = self.depths["table"]
        else:
            walls = self.item_walls if by in ITEMS_OF_LISTS else self.walls
        if tag != "table" and walls and walls[-1] > depth:
            return
        while len(self.stack) > depth:
            self._pop()

    def _pop(self) -> None:
        node = self.stack.pop()
        depth = len(self.stack)
        self.depths[node.tag].pop()
        self.silent -= node.tag in SILENT
        for walls in (self.walls, self.item_walls):
            if walls and walls[-1] == depth:
                walls.pop()
        node.last, node.end = self.count - 1, self.said
        if node.tag == "script" and self.script is not None:
            self.json_ld.append("".join(self.script))
            self.script = None

    def _read(self, text: str) -> str:
        return text.replace(self.ampersand, "&") if self.ampersand else text

    def handle_data(self, data: str) -> None:
        data = self._read(data)
        if self.script is not None:
            self.script.append(data)
        elif self.stack and self.stack[-1].tag == "title":
            self.title.append(data)
        elif not self.silent:
            self._say(data)

    def _say(self, data: str) -> None:
        self.text.append(data)
        self.said += len(data)

    def close(self) -> None:
        super().close()
        while self.stack:
            self._pop()

    def absolute(self, href: str) -> str | None:
        try:
            return urljoin(self.url, href)
        except ValueError:
            return None


def _tables(page: _Page, text: _Text, items: int | None, cell_chars: int | None, most: int | None) -> tuple[list[dict], bool]:
    """The page's tables with their header cells and rows, those of tables inside them as well; whether `most` characters were reached."""
    left, out = float("inf") if most is None else most, []

    def cells(kind: str, node: _Node) -> list[str]:
        nonlocal left
        found = []
        for x in islice(page.kept[kind].inside(node), items):
            found.append(text.cut(x.start, x.end, cell_chars if most is None else min(cell_chars, left)))
            left -= len(found[-1]) + 1
            if left <= 0:
                break
        return found

    for table in page.kept["table"][:items]:
        if left <= 0:
            break
        headers = cells("th", table)
        if headers:
            rows = [cells("td", x) for x in islice(page.kept["tr"].inside(table), items) if left > 0]
            out.append({"headers": headers, "rows": [x for x in rows if x]})
    return [x for x in out if x["rows"]], left <= 0


def _first(page: _Page, kind: str, attribute: str, node: _Node) -> str | None:
    found = next(page.kept[kind].inside(node), None)
    return page.absolute(found.have[attribute]) or None if found is not None and found.have[attribute] else None


def _signals(page: _Page, text: _Text, links: int | None, whole: bool) -> list[dict]:
    href_chars, label_chars, rel_chars = (None, None, None) if whole else (HREF_CHARS, LABEL_CHARS, REL_CHARS)
    signals = (
        {
            "href": (page.absolute(a.have["href"]) or "")[:href_chars],
            "text": text.cut(a.start, a.end, label_chars),
            "rel": a.have.get("rel", "")[:rel_chars],
            "aria_label": a.have.get("aria-label", "")[:label_chars],
        }
        for a in page.kept["anchor"][:links]
    )
    return [s for s in signals if s["href"]]


def _document(page: _Page, text: _Text, text_chars: int | None, items: int | None, whole: bool) -> dict:
    meta_chars, cell_chars, table_chars = (None, None, None) if whole else (META_CHARS, CELL_CHARS, TABLE_CHARS)
    page_text = text.clean.strip()
    blocks = [
        {
            "tag": b.tag,
            "text": text.cut(b.start, b.end, BLOCK_CHARS),
            "href": _first(page, "anchor", "href", b),
            "image_url": _first(page, "image", "src", b),
        }
        for b in page.kept["block"][:items]
    ]
    tables, full = _tables(page, text, items, cell_chars, table_chars)
    more = items is not None and any(len(x) > items for x in (page.kept["block"], page.kept["table"], page.json_ld))
    return {
        "page_text": page_text[:text_chars],
        "json_ld": page.json_ld[:items],
        "open_graph": [(k, v[:meta_chars]) for k, v in islice(page.open_graph.items(), items)],
        "tables": tables,
        "blocks": [b for b in blocks if b["text"]],
        "truncated": text_chars is not None and len(page_text) > text_chars or more or full,
    }


def parse_page(
    html: str | None,
    url: str | None,
    text_chars: int | None = TEXT_CHARS,
    items: int | None = ITEMS,
    links: int | None = LINKS,
    closed_references: bool = False,
    whole: bool = False,
    parts: Sequence[str] = PARSED.names,
) -> dict:
    """signals, document and title of one page, or those of them that `parts` names; null html is an empty page.

    Blocks and tables may lie in each other; each has all the text that is between its tags.
    The first `items` of each kind count, `truncated` says if there was more of anything.
    With `whole` all of each kind count, and nothing is cut but a block's text and the title.
    HTML reads some references without their semicolon (`&amp` is `&`); with
    `closed_references` those are text as they stand.
    """
    if whole:
        text_chars = items = links = None
    ampersand = None
    if closed_references and html and _LOOSE.search(html):
        ampersand = next(c for c in map(chr, _STANDS) if c not in html)
        html = _LOOSE.sub(ampersand, html)
    page = _Page(url or "", ampersand)
    page.feed(html or "")
    page.close()
    text = _Text(page.text)
    make = {
        "title": lambda: _SPACE.sub(" ", "".join(page.title)).strip()[:TITLE_CHARS],
        "signals": lambda: _signals(page, text, links, whole),
        "document": lambda: _document(page, text, text_chars, items, whole),
    }
    return {x: make[x]() for x in parts}


def _slices(batch: pa.RecordBatch, column: str, most: int) -> Iterator[pa.RecordBatch]:
    """A batch in pieces of at most so many bytes of a text column, or of one row."""
    start = held = 0
    for i, size in enumerate(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()):
        if i > start and held + size > most:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += size
    yield batch.slice(start)


def parse_pages(pages: DataFrame, html: str = "html", url: str = "url", closed_references: bool = False, parts: Sequence[str] = PARSED.names) -> DataFrame:
    """pages with title, signals and document of whole pages added, or those that `parts` names, and html dropped; see parse_page."""
    rest = [f for f in pages.schema.fields if f.name != html and f.name not in PARSED.names]
    added = T.StructType([f for f in PARSED.fields if f.name in parts])
    schema = T.StructType([*rest, *added.fields])

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        kinds = to_arrow_schema(added)
        for batch in (x for batch in batches for x in _slices(batch, html, PARSE_BYTES)):
            read = zip(batch.column(html).to_pylist(), batch.column(url).to_pylist())
            got = [parse_page(h, u, closed_references=closed_references, whole=True, parts=added.names) for h, u in read]
            made = [pa.array([g[f.name] for g in got], f.type) for f in kinds]
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in rest), *made], schema.names)

    return pages.mapInArrow(parse, schema)


def read_pages(spark: SparkSession, path: str, max_bytes: int | None = None) -> DataFrame:
    """The captured-page table; pages over max_bytes are left out, as a capture would refuse them."""
    pages = spark.read.parquet(path)
    return pages if max_bytes is None else pages.where(F.octet_length("html") <= max_bytes)


# The viewport that pages are captured with.
VIEWPORT = (1440, 900)


def navigation_record(captures: DataFrame) -> DataFrame:
    """One row per capture: page_id, requested_url, final_url, status, content_type, title, viewport, redirect_count.

    Input: page_id, chain (array of URLs: the one asked for, redirects, the one reached),
    status, content_type and html; `title` if the page is parsed already. A capture without
    a chain has no URLs and no redirects; without a response status and type are null.
    """
    title = F.col("title") if "title" in captures.columns else page_title(F.col("html"))
    return captures.select(
        "page_id",
        F.get("chain", F.lit(0)).alias("requested_url"),
        F.get("chain", F.size("chain") - 1).alias("final_url"),
        F.col("status").cast("int").alias("status"),
        "content_type",
        F.nullif(F.left(title, F.lit(TITLE_CHARS)), F.lit("")).alias("title"),
        F.struct(F.lit(VIEWPORT[0]).alias("width"), F.lit(VIEWPORT[1]).alias("height")).alias("viewport"),
        F.coalesce(redirect_hops(F.col("chain")), F.lit(0)).alias("redirect_count"),
    )


def page_title(html: Column) -> Column:
    """The first title element's text, extra space removed, JVM-side: for pages that spell no entities there."""
    inner = F.regexp_extract(html, r"(?is)<title(?:\s[^<>]*)?>([^<]*)", 1)
    return F.trim(F.regexp_replace(inner, r"(?U)\s+", " "))


def native_anchors(html: Column) -> Column:
    """href values of anchors in order, JVM-side: for pages whose hrefs are double-quoted."""
    return F.regexp_extract_all(html, F.lit(r'(?is)<a\s[^<>]*href="([^"]*)"'), F.lit(1))


def native_block_texts(html: Column, tag: str) -> Column:
    """Texts of the outermost elements of one tag without nested ones of the same tag, tags and extra space removed."""
    inner = F.regexp_extract_all(html, F.lit(rf"(?is)<{tag}(?:\s[^>]*)?>(.*?)</{tag}>"), F.lit(1))
    return F.transform(inner, lambda x: F.trim(F.regexp_replace(F.regexp_replace(x, r"(?s)<[^>]*>", " "), r"\s+", " ")))


def redirect_hops(chain: Column) -> Column:
    """Redirects in a chain of URLs (first asked for, last reached)."""
    return F.greatest(F.size(chain) - 1, F.lit(0))


def redirects_allowed(chain: Column, allowed, most: int) -> Column:
    """Whether every hop is allowed and there are at most `most`."""
    return (redirect_hops(chain) <= most) & F.forall(chain, allowed)
