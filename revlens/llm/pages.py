"""Main text of web pages, by differencing each page with its nearest pages by URL.

Pages of one host that lie next to each other in the order of their URL paths come from one template.
Their text lines are aligned by a longest common subsequence, and what both have, the template wrote:
shared lines go. Parts that a page itself marks as something else than its article, such as menus, forms
or comments, are left out before lines are compared.

Only checksums of lines are shuffled for that: a page and its neighbour meet by their place in the global
order of (host, path), so that a host with a third of all pages is spread like any other. Copies of a page
count once, since a page says nothing about the template of its own copy; a pair that shares more than
half of a page's text is taken for two versions of one article, and deletes nothing from it.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from revlens.functions.joins import measured_bytes
from revlens.functions.ranking import sorted_stage
from revlens.sources.stages import StageStore

# pages with shared lines that are broadcast by what their list measures; beyond it they are merged
BROADCAST_BYTES = 32 << 20

# fixed values: elements of HTML by what they are to a reader
RAW = {"script", "style", "textarea", "title", "xmp"}
UNSEEN = {
    "head", "noscript", "template", "svg", "math", "iframe", "object", "canvas", "audio", "video", "map",
    "select", "button", "datalist", "dialog", "nav", "aside", "footer", "menu", "header",
}
BLOCKS = {
    "address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "dir",
    "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6",
    "header", "hgroup", "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "p", "pre", "section",
    "summary", "table", "tbody", "tfoot", "thead", "tr", "ul",
}
EMPTY = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BREAKS = {"br", "td", "th", "option", "img", "input"}
MAINS = {"article", "main"}
# words of class names, ids and roles that mark what is not the article
MARKS = {
    "ad", "ads", "adv", "advert", "adverts", "advertisement", "advertising", "sponsor", "sponsored", "promo",
    "banner", "nav", "navbar", "navigation", "menu", "breadcrumb", "breadcrumbs", "sidebar", "footer", "masthead",
    "cookie", "cookies", "consent", "gdpr", "notice", "notices", "popup", "modal", "newsletter", "subscribe",
    "signup", "login", "share", "sharing", "related", "recommended", "widget", "pagination", "pager", "search",
    "contentinfo", "complementary", "alert",
}
REMARKS = {"comment", "comments", "respond", "replies", "disqus"}
KEPT_WHOLE = {"html", "body", "main"}

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>"
    r"|<[!?/][^>]*+>"
    r"|<[!?/a-zA-Z][^>]*+\Z",
    re.DOTALL,
)
_NAMED = re.compile(r"""(?:^|\s)(class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.IGNORECASE)
_HIDDEN = re.compile(
    r"""(?:^|\s)(?:hidden(?=[\s=/]|$)|aria-hidden\s*=\s*["']?true|style\s*=\s*["'][^"']*display\s*:\s*none)""", re.IGNORECASE
)
_RAW_END = {name: re.compile(rf"</{name}[\s/>]|</{name}\Z", re.IGNORECASE) for name in RAW}
_WORDS = re.compile(r"[a-z]+")


def _marked(tag: str, attributes: str, in_article: bool) -> bool:
    """Whether an element's attributes say that it is no part of the article."""
    if _HIDDEN.search(attributes):
        return True
    if tag in KEPT_WHOLE:
        return False
    words: set[str] = set()
    for found in _NAMED.finditer(attributes):
        for name in found[2].strip("\"'").lower().split():
            parts = _WORDS.findall(name)
            # a class such as has-sidebar speaks of what is beside the element
            if parts and parts[0] not in ("has", "with", "no", "without", "is"):
                words.update(parts)
    if words & REMARKS:
        return True
    return tag != "article" and bool(words & MARKS or (not in_article and "header" in words))


class _Reader:
    """Collects the text lines of one page that could be its article."""

    def __init__(self) -> None:
        self.lines: list[tuple[str, bool, bool]] = []
        self.buffer: list[str] = []
        # (tag, left out, by its name) of the open elements, and how many are open of each tag
        self.open: list[tuple[str, bool, bool]] = []
        self.counts: Counter[str] = Counter()
        self.skipped = self.mains = 0

    def text(self, piece: str) -> None:
        if piece and not self.skipped:
            self.buffer.append(html.unescape(piece) if "&" in piece else piece)

    def line_end(self) -> None:
        if self.buffer:
            line = " ".join("".join(self.buffer).split())
            self.buffer = []
            if line:
                self.lines.append((line, self.mains > 0, self.counts["form"] > 0))

    def _drop(self, at: int) -> None:
        tag, left_out, _ = self.open.pop(at)
        self.counts[tag] -= 1
        self.skipped -= left_out
        self.mains -= tag in MAINS

    def start(self, tag: str, attributes: str) -> None:
        if tag in BLOCKS:
            self.line_end()
        elif tag in BREAKS and not self.skipped:
            self.buffer.append(" ")
        if tag in EMPTY or (attributes.endswith("/") and tag not in BLOCKS):
            return
        if tag in MAINS or tag == "body":
            # an element that cannot hold an article was never closed
            for at in range(len(self.open) - 1, -1, -1):
                if self.open[at][2]:
                    self._drop(at)
        by_name = tag in UNSEEN and not (tag == "header" and self.mains)
        left_out = by_name or bool(attributes and _marked(tag, attributes, self.mains > 0))
        self.open.append((tag, left_out, by_name))
        self.counts[tag] += 1
        self.skipped += left_out
        self.mains += tag in MAINS

    def end(self, tag: str) -> None:
        if tag in BLOCKS:
            self.line_end()
        if self.counts[tag]:
            while True:
                found = self.open[-1][0] == tag
                self._drop(len(self.open) - 1)
                if found:
                    break

    def article(self) -> list[str]:
        """Lines inside forms only where the form holds the page, lines beside articles where there is none."""
        lines = self.lines
        for part in (1, 2):
            inside = [entry for entry in lines if entry[part]]
            holds = 2 * sum(len(entry[0]) for entry in inside) > sum(len(entry[0]) for entry in lines)
            if part == 1 and holds:
                lines = inside
            elif part == 2 and not holds:
                lines = [entry for entry in lines if not entry[part]]
        return [entry[0] for entry in lines]


def text_lines(page: str | None) -> list[str]:
    """The lines of a page that could be its article: character references decoded, white space folded."""
    reader, at = _Reader(), 0
    page = page or ""
    while True:
        found = _TOKEN.search(page, at)
        if not found:
            break
        reader.text(page[at : found.start()])
        at = found.end()
        tag = (found[2] or found[5] or "").lower()
        if not tag:
            continue
        if found[1] or found[4]:
            reader.end(tag)
            continue
        if tag in RAW:
            closing = _RAW_END[tag].search(page, at)
            at = closing.start() if closing else len(page)
            continue
        reader.start(tag, found[3] or found[6] or "")
    reader.text(page[at:])
    reader.line_end()
    return reader.article()


def _reach(left: list[int], right: list[int]) -> np.ndarray:
    """Length of the longest common subsequence of `left` with each beginning of `right`."""
    size = len(right)
    masks: dict[int, int] = {}
    for at, value in enumerate(right):
        masks[value] = masks.get(value, 0) | 1 << at
    full = (1 << size) - 1
    rows = full
    for value in left:
        both = rows & masks.get(value, 0)
        rows = ((rows + both) | (rows - both)) & full
    bits = np.frombuffer((full ^ rows).to_bytes(size // 8 + 1, "little"), np.uint8)
    return np.concatenate([[0], np.cumsum(np.unpackbits(bits, bitorder="little")[:size])])


def common_lines(left: list[int], right: list[int]) -> list[tuple[int, int]]:
    """Pairs of places of a longest common subsequence, in order; bit-parallel, in linear memory."""
    shared = set(left) & set(right)
    places = [[at for at, value in enumerate(side) if value in shared] for side in (left, right)]
    sides = [[side[at] for at in kept] for side, kept in zip((left, right), places, strict=True)]
    pairs: list[tuple[int, int]] = []
    waiting = [(0, len(sides[0]), 0, len(sides[1]))]
    while waiting:
        a, b, c, d = waiting.pop()
        while a < b and c < d and sides[0][a] == sides[1][c]:
            pairs.append((places[0][a], places[1][c]))
            a, c = a + 1, c + 1
        while a < b and c < d and sides[0][b - 1] == sides[1][d - 1]:
            b, d = b - 1, d - 1
            pairs.append((places[0][b], places[1][d]))
        if a == b or c == d:
            continue
        if b - a == 1:
            if sides[0][a] in sides[1][c:d]:
                pairs.append((places[0][a], places[1][sides[1].index(sides[0][a], c, d)]))
            continue
        middle = (a + b) // 2
        head = _reach(sides[0][a:middle], sides[1][c:d])
        tail = _reach(sides[0][middle:b][::-1], sides[1][c:d][::-1])[::-1]
        cut = c + int(np.argmax(head + tail))
        waiting += [(a, middle, c, cut), (middle, b, cut, d)]
    return sorted(pairs)


LINES = "url_host string, url_path string, content binary, sums array<bigint>, sizes array<int>"


def url_host(url: Column) -> Column:
    """The host of a URL in lower case; empty for null and for what has none."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def url_path(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def _content(lines: list[str]) -> bytes:
    digest = blake2b(digest_size=16)
    for line in lines:
        digest.update(line.encode("utf-8", "replace") + b"\n")
    return digest.digest()


def _sum_of(line: str) -> int:
    return int.from_bytes(blake2b(line.encode("utf-8", "replace"), digest_size=8).digest(), "little", signed=True)


def _checksums(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema(
        [
            ("url_host", pa.string()),
            ("url_path", pa.string()),
            ("content", pa.binary()),
            ("sums", pa.list_(pa.int64())),
            ("sizes", pa.list_(pa.int32())),
        ]
    )
    for batch in batches:
        rows = []
        for host, path, page in zip(*batch.columns, strict=True):
            lines = text_lines(page.as_py())
            rows.append(
                {
                    "url_host": host.as_py(),
                    "url_path": path.as_py(),
                    "content": _content(lines),
                    "sums": [_sum_of(line) for line in lines],
                    "sizes": [len(line) for line in lines],
                }
            )
        yield pa.RecordBatch.from_pylist(rows, schema=schema)


def _steps(path: str) -> list[str]:
    return [step for step in path.split("/") if step]


def _together(left: str, right: str) -> int:
    """How many leading steps two paths share."""
    shared = 0
    for one, other in zip(_steps(left), _steps(right), strict=False):
        if one != other:
            break
        shared += 1
    return shared


PAIR = "place bigint, side int, together int, lines array<int>"


def _differences(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For both pages of a pair: the lines that they share, where those are not most of the page."""
    kinds = [("place", pa.int64()), ("side", pa.int32()), ("together", pa.int32()), ("lines", pa.list_(pa.int32()))]
    schema = pa.schema(kinds)
    for batch in batches:
        rows = []
        for pair in batch.to_pylist():
            pairs = common_lines(pair["sums"], pair["next_sums"])
            near = _together(pair["url_path"], pair["next_path"])
            for side, sizes in enumerate((pair["sizes"], pair["next_sizes"])):
                lines = [places[side] for places in pairs]
                if 2 * sum(sizes[at] for at in lines) > sum(sizes):
                    continue
                rows.append({"place": pair["place"] + side, "side": side, "together": near, "lines": lines})
        yield pa.RecordBatch.from_pylist(rows, schema=schema)


def shared_lines(pages: DataFrame, store: StageStore) -> DataFrame:
    """(host, content, lines): places of the lines that a page shares with its nearest pages.

    The nearest is the neighbour in path order whose path shares more leading steps; of two that are
    equally near, only lines that the page shares with both go. `pages` has url and html.
    """
    seen = pages.select(url_host(F.col("url")).alias("url_host"), url_path(F.col("url")).alias("url_path"), "html")
    sums = seen.where("url_host <> ''").mapInArrow(_checksums, LINES).where(F.size("sums") > 0)
    # copies fold in each task before the shuffle, so that a page with very many of them is one row
    distinct = sums.groupBy("url_host", "content").agg(
        F.min("url_path").alias("url_path"), F.first("sums").alias("sums"), F.first("sizes").alias("sizes")
    )
    order = [F.col(name).asc() for name in ("url_host", "url_path", "content")]
    placed = store.save(sorted_stage(store, distinct, order, "sorted").numbered("place"), "placed")
    following = placed.select(
        (F.col("place") - 1).alias("before"),
        F.col("url_host").alias("next_host"),
        F.col("url_path").alias("next_path"),
        F.col("sums").alias("next_sums"),
        F.col("sizes").alias("next_sizes"),
    )
    pairs = placed.join(following, (F.col("place") == F.col("before")) & (F.col("url_host") == F.col("next_host")))
    columns = ["place", "url_path", "sums", "sizes", "next_path", "next_sums", "next_sizes"]
    found = pairs.select(*columns).mapInArrow(_differences, PAIR)
    nearest = found.groupBy("place").agg(
        F.max("together").alias("most"), F.collect_list(F.struct("together", "lines")).alias("sides")
    )
    # no more than two sides a page
    close = F.transform(F.filter("sides", lambda side: side["together"] == F.col("most")), lambda side: side["lines"])
    lines = F.when(F.size(close) == 2, F.array_intersect(close[0], close[1])).otherwise(close[0])
    gone = nearest.select("place", lines.alias("lines")).where(F.size("lines") > 0)
    return gone.join(placed.select("place", "url_host", "content"), "place").select("url_host", "content", "lines")


def main_texts(pages: DataFrame, store: StageStore) -> DataFrame:
    """(page_id, url, text): the article of every page, its blocks joined by an empty line.

    `pages` has page_id, url and html; other columns are not looked at. Null and empty html gives an
    empty text. Pages whose url is null or names no host are read without neighbours. Every row gives
    one row, repeated rows too, and rows with the same host and lines have the same text; null ids are
    kept. Pages are read whole, however long. An empty table gives an empty result.
    """
    gone = store.save(shared_lines(pages, store), "gone")
    lines_of = F.arrow_udf(_read_lines, "content binary, lines array<string>")
    read = pages.select("page_id", "url", url_host(F.col("url")).alias("_host"), lines_of("html").alias("_read"))
    # a line that goes is one of at least eight bytes of its own
    lookup = gone.select(
        F.concat_ws(" ", F.hex("content"), "url_host").alias("_page"), F.col("lines").alias("_gone")
    )
    if measured_bytes(gone.select(F.explode("lines").alias("line"), F.hex("content").alias("page"), "url_host")) <= BROADCAST_BYTES:
        lookup = F.broadcast(lookup)
    read = read.withColumn("_name", F.concat_ws(" ", F.hex("_read.content"), "_host"))
    joined = read.join(lookup, F.col("_name") == F.col("_page"), "left")
    places = F.array_except(F.sequence(F.lit(0), F.size("_read.lines") - 1), F.col("_gone"))
    kept = F.transform(places, lambda at: F.get("_read.lines", at))
    whole = F.array_join(F.col("_read.lines"), "\n\n")
    text = F.when(F.col("_gone").isNull(), whole).otherwise(F.array_join(kept, "\n\n"))
    return joined.select("page_id", "url", text.alias("text"))


def _read_lines(pages: pa.Array) -> pa.Array:
    rows = []
    for page in pages:
        lines = text_lines(page.as_py())
        rows.append({"content": _content(lines), "lines": lines})
    return pa.array(rows, pa.struct([("content", pa.binary()), ("lines", pa.list_(pa.string()))]))
