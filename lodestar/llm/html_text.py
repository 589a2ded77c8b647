"""HTML extraction: nearest-URL page differencing with structure as a veto.

A page is cut into lines, one a block of text. The pages of a host are put in
order of their URL paths; a page is paired with the neighbour whose path has
the longer common beginning, both pages' lines are aligned by the longest common
subsequence, and shared lines, the site's template, are deleted. Every line of
every page takes part.

Differencing alone can't give right results where adverts and menus differ by
page (nothing is shared, all of them stay) or where copies of one article stand
next to each other (everything is shared, all of it goes). So each line also
has a kind from the page's structure: a line inside ``<article>`` or ``<main>``
stays though it is shared, a line inside a menu, header, footer, sidebar,
notice, advert, form or comment list goes though it is not, and if a page has
an article, so do the lines outside. All other lines are decided by
differencing. ``n_shared`` counts the lines that a neighbour deleted.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.runtime import written

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)", re.DOTALL)
_ATTRIBUTE = re.compile(r"([^\s=/\"']+)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_RAW = {"script", "style", "noscript", "template", "textarea", "iframe", "svg", "math", "object", "canvas", "select", "title", "noembed", "noframes", "audio", "video", "xmp"}
_FURNITURE = {"nav", "header", "footer", "aside", "form", "button", "menu", "dialog", "head", "fieldset", "label", "input"}
_MAIN = {"article", "main"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_BREAKS = {
    "address", "article", "aside", "blockquote", "body", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form",
    "h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "hgroup", "hr", "html", "li", "main", "menu", "nav", "ol", "option", "p", "pre", "section", "summary", "table", "tbody",
    "td", "tfoot", "th", "thead", "tr", "ul", "legend", "caption",
}
_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert", "alertdialog", "menu", "menubar", "toolbar", "form"}
_WORDS = re.compile(r"[a-z]+")
_NAMES = {
    "ad", "ads", "advert", "adverts", "advertisement", "advertising", "sponsor", "sponsored", "promo", "promotion", "banner", "nav", "navbar", "navigation", "menu", "breadcrumb", "breadcrumbs",
    "header", "masthead", "footer", "sidebar", "aside", "related", "recommended", "popular", "share", "sharing", "social", "newsletter", "subscribe", "subscription", "signup", "login", "cookie",
    "cookies", "consent", "gdpr", "notice", "popup", "modal", "overlay", "comment", "comments", "disqus", "respond", "replies", "form", "search", "widget", "pagination", "pager", "skip", "toolbar",
}
_WHITE = re.compile(r"\s+")
FURNITURE, OPEN, MAIN = 0, 1, 2


def _furniture(tag: str, attributes: str) -> bool:
    if tag in _FURNITURE:
        return True
    if not attributes or "=" not in attributes and "hidden" not in attributes:
        return False
    for name, a, b, c in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), (a or b or c).lower()
        if name == "role" and value in _ROLES or name == "aria-hidden" and value == "true" or name == "hidden":
            return True
        if name in ("class", "id") and tag not in ("body", "html", "article", "main") and not _NAMES.isdisjoint(_WORDS.findall(value)):
            return True
        if name == "style" and re.search(r"display\s*:\s*none", value):
            return True
    return False


def blocks(source: str | None) -> list[tuple[int, str]]:
    """``(FURNITURE, OPEN or MAIN, text)`` of the blocks in page order.

    Character references are decoded once, white space becomes one space. What
    scripts, styles and other raw elements hold is no text. Elements that never
    close end with the page; a furniture element ends with its own end tag, or
    with that of an element around it.
    """
    out: list[tuple[int, str]] = []
    text: list[str] = []
    stack: list[tuple[str, bool, bool]] = []  # tag, furniture, main
    held: dict[str, int] = {}  # how often a tag is on the stack
    page, at, off, main = source or "", 0, 0, 0

    def close() -> None:
        if text:
            clean = _WHITE.sub(" ", "".join(text)).strip()
            text.clear()
            if clean:
                out.append((FURNITURE if off else MAIN if main else OPEN, clean))

    def pop() -> None:
        nonlocal off, main
        tag, f, m = stack.pop()
        held[tag] -= 1
        if f or m:
            close()
        off -= f
        main -= m

    size = len(page)
    while at < size:
        m = _TOKEN.search(page, at)
        if m is None:
            text.append(html.unescape(page[at:]))
            break
        if m.start() > at:
            text.append(html.unescape(page[at : m.start()]))
        at = m.end()
        tag = m.group(2)
        if tag is None:
            continue
        tag = tag.lower()
        if m.group(1):
            if tag in _BREAKS:
                close()
            if held.get(tag):
                while stack[-1][0] != tag:
                    pop()
                pop()
            continue
        if tag in _RAW:
            end = re.compile(rf"</{re.escape(tag)}\s*>", re.IGNORECASE).search(page, at)
            at = end.end() if end else size
            continue
        if tag == "br":
            text.append(" ")
            continue
        if tag in _BREAKS:
            close()
        if tag in _VOID or m.group(3).endswith("/") and tag not in _BREAKS:
            continue
        if tag == "p" and stack and stack[-1][0] == "p" or tag == "body" and stack and stack[-1][0] == "head":
            pop()
        furniture, content = _furniture(tag, m.group(3)), tag in _MAIN
        if not (furniture or content) and tag not in _BREAKS:
            continue  # inline elements need no place on the stack
        if furniture or content:
            close()
        stack.append((tag, furniture, content))
        held[tag] = held.get(tag, 0) + 1
        off += furniture
        main += content
    close()
    return out


_HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)"


def _line(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass")) - (1 << 63)


def _content(hashes: list[int]) -> int:
    return xxhash.xxh64_intdigest(np.array(hashes, np.int64).tobytes()) - (1 << 63)


#: Bits of an alignment's table that are held at once (32 MB); larger tables are cut in halves.
TABLE_BITS = 1 << 28


def _table(a: list[int], b: list[int]) -> list[int]:
    """Row by row of ``a`` the columns of the LCS table as bits: a zero where the length steps up."""
    where: dict[int, int] = {}
    for k, x in enumerate(b):
        where[x] = where.get(x, 0) | 1 << k
    mask, v, rows = (1 << len(b)) - 1, (1 << len(b)) - 1, []
    for x in a:
        u = v & where.get(x, 0)
        v = ((v + u) | (v - u)) & mask
        rows.append(v)
    return rows


def _steps(a: list[int], b: list[int]) -> np.ndarray:
    """LCS lengths of all of ``a`` with each beginning of ``b``, from the last row of the table alone."""
    where: dict[int, int] = {}
    for k, x in enumerate(b):
        where[x] = where.get(x, 0) | 1 << k
    mask = v = (1 << len(b)) - 1
    for x in a:
        u = v & where.get(x, 0)
        v = ((v + u) | (v - u)) & mask
    bits = np.unpackbits(np.frombuffer(v.to_bytes(len(b) // 8 + 1, "little"), np.uint8), bitorder="little")[: len(b)]
    return np.concatenate([[0], np.cumsum(1 - bits.astype(np.int64))])


def shared_lines(a: list[int], b: list[int]) -> list[bool]:
    """Which lines of ``a`` lie on a longest common subsequence with ``b``.

    Equal beginnings and ends are matched first. The rest is aligned by rows of
    bits: time is len(a) * len(b) / 64 whatever repeats, and memory at most
    ``TABLE_BITS`` (a larger table is cut at the middle of ``a``).
    """
    keep = [False] * len(a)
    todo = [(0, len(a), 0, len(b))]
    while todo:
        i, n, k, m = todo.pop()
        while i < n and k < m and a[i] == b[k]:
            keep[i] = True
            i, k = i + 1, k + 1
        while i < n and k < m and a[n - 1] == b[m - 1]:
            n, m = n - 1, m - 1
            keep[n] = True
        if i == n or k == m:
            continue
        if (n - i) * (m - k) > TABLE_BITS and n - i > 1:
            half = (i + n) // 2
            best = int(np.argmax(_steps(a[i:half], b[k:m]) + _steps(a[half:n][::-1], b[k:m][::-1])[::-1]))
            todo += [(i, half, k, k + best), (half, n, k + best, m)]
            continue
        rows, row, col = _table(a[i:n], b[k:m]), n - i, m - k
        while row and col:
            if rows[row - 1] >> (col - 1) & 1:
                col -= 1  # the length doesn't step up at this column
            elif row > 1 and not rows[row - 2] >> (col - 1) & 1:
                row -= 1  # it did so a row before
            else:
                row, col = row - 1, col - 1
                keep[i + row] = True
    return keep


#: A nearest neighbour that shares more than this part of a page's lines may be a near copy: a line goes only if the neighbour on the other side has it too.
COPY = 0.8


def _common(a: str, b: str | None) -> int:
    """Length of the common beginning of two paths; -1 without a second one."""
    if b is None:
        return -1
    n = min(len(a), len(b))
    return next((k for k in range(n) if a[k] != b[k]), n)


def template(own: list[int], path: str, before: tuple[str, list[int]] | None, after: tuple[str, list[int]] | None) -> list[bool]:
    """Which lines of a page are its site's template.

    Those on a longest common subsequence with the neighbour whose path has the
    longer common beginning (the one before, if both have). Where that neighbour
    shares more than ``COPY`` of the page, it may be a near copy; then only lines
    that the other neighbour shares too are template, or none without one.
    """
    sides = [x for x in (before, after) if x is not None]
    sides.sort(key=lambda x: -_common(path, x[0]))
    if not sides or not own:
        return [False] * len(own)
    gone = shared_lines(own, sides[0][1])
    if sum(gone) > COPY * len(own):
        other = shared_lines(own, sides[1][1]) if len(sides) > 1 else [False] * len(own)
        gone = [x and y for x, y in zip(gone, other)]
    return gone


def chosen(kinds: list[int], gone: list[bool]) -> list[bool]:
    """Which lines stay: differencing decides, structure has the veto."""
    marked = MAIN in kinds
    return [k == MAIN or k == OPEN and not g and not marked for k, g in zip(kinds, gone)]


def _neighbours(pages: DataFrame, sides: DataFrame) -> DataFrame:
    """``(host, content, salt, gone)`` once for (uid, host, path, content, salt) rows: a byte a line, one where it is its site's template.

    A page is compared with those next to it in its host's order of paths.
    ``sides`` has ``(near, side)``, path and line hashes by uid. Pages of a host with equal content count as one page, that of the least
    path. Narrow rows are sorted over all tasks by host and path and numbered,
    so a host of any size is spread; a page of many copies is reduced and looked
    up in its cells of ``salt``.
    """
    cells = pages.groupBy("host", "content", "salt").agg(F.min(F.struct("path", "uid")).alias("first"))
    once = cells.groupBy("host", "content").agg(F.min("first").alias("first"), F.collect_set("salt").alias("salts")).select("host", "content", "first.path", "first.uid", "salts")
    order = written(once.repartitionByRange("host", "path", "uid").sortWithinPartitions("host", "path", "uid").withColumn("n", F.monotonically_increasing_id()), "page-order")
    sizes = {r["part"]: r["count"] for r in order.groupBy(F.shiftright("n", 33).alias("part")).count().collect()}  # one row a partition
    firsts, total = {}, 0
    for part in sorted(sizes):
        firsts[part] = total
        total += sizes[part]
    place = order.sparkSession.createDataFrame(sorted(firsts.items()), "part long, first long")
    at = order.withColumn("part", F.shiftright("n", 33)).join(F.broadcast(place), "part").select("host", "content", "uid", "salts", (F.col("first") + F.col("n").bitwiseAND(F.lit((1 << 33) - 1))).alias("n"))
    told = at.select("n", "host", F.col("uid").alias("near")).join(sides, "near").drop("near")
    before = told.select((F.col("n") + 1).alias("n"), F.col("host").alias("h0"), F.col("side").alias("s0"))
    after = told.select((F.col("n") - 1).alias("n"), F.col("host").alias("h1"), F.col("side").alias("s1"))
    both = told.join(before, "n", "left").join(after, "n", "left")
    both = both.select("n", "side", F.when(F.col("h0") == F.col("host"), F.col("s0")).alias("before"), F.when(F.col("h1") == F.col("host"), F.col("s1")).alias("after"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            gone = []
            for own, *near in zip(*(c.to_pylist() for c in b.columns[1:])):
                gone.append(bytes(template(own["hashes"], own["path"] or "", *[x and (x["path"] or "", x["hashes"]) for x in near])))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(gone, pa.binary())], ["n", "gone"])

    return at.join(both.mapInArrow(compare, "n long, gone binary"), "n").select("host", "content", F.explode("salts").alias("salt"), "gone")


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per row of ``pages``: page_id, url, text, n_chars, n_lines, n_shared.

    Lines that stay are joined in page order by one newline; ``n_lines`` counts
    all lines and ``n_shared`` those that differencing deleted. Null or empty
    html gives an empty text; pages without a URL, or alone on their host, are
    judged by structure alone; repeated rows are extracted each; other columns,
    whatever their names, are ignored.
    """

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hashes = [[_line(t) for _, t in blocks(x.as_py())] for x in b.column(3)]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(hashes, pa.list_(pa.int64())), pa.array([_content(h) for h in hashes], pa.int64())], ["uid", "url", "salt", "hashes", "content"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=3)
        for b in batches:
            found = [blocks(t.as_py()) for t in b.column(3)]
            marked = [any(k == MAIN for k, _ in f) for f in found]
            kinds = [bytes(k for k, _ in f) for f in found]
            # a line that structure drops whatever the neighbours say needs no text
            lines = [squeeze.compress("\n".join([t for k, t in f if k == (MAIN if m else OPEN)]).encode("utf-8", "surrogatepass")) for f, m in zip(found, marked)]
            content = [_content([_line(t) for _, t in f]) for f in found]
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:3], pa.array(lines, pa.binary()), pa.array(kinds, pa.binary()), pa.array(content, pa.int64())],
                ["page_id", "url", "salt", "lines", "kinds", "content"],
            )

    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.pmod(F.xxhash64(id_col, url_col), F.lit(32)).cast("int").alias("salt"), F.col(html_col).alias("html"))
    kind = dict(rows.dtypes)["page_id"]
    # pages are cut twice: texts are never written beside the one shuffle that takes them to their decisions
    narrow = rows.select(F.monotonically_increasing_id().alias("uid"), "url", "salt", "html")
    parsed = written(narrow.mapInArrow(hashed, "uid long, url string, salt int, hashes array<long>, content long"), "page-lines")

    host = F.lower(F.regexp_extract("url", _HOST, 1))
    path = F.regexp_replace(F.regexp_replace("url", _HOST, ""), "[?#].*$", "")
    placed = parsed.select("uid", "content", "salt", host.alias("host"), path.alias("path")).filter("host != ''")
    sides = parsed.select(F.col("uid").alias("near"), F.struct(path.alias("path"), "hashes").alias("side"))
    # a page's decision is that of its host and content, which need no number that two readings would have to agree on
    texts = rows.mapInArrow(cut, f"page_id {kind}, url string, salt int, lines binary, kinds binary, content long").withColumn("host", host)
    compared = texts.join(_neighbours(placed, sides), ["host", "content", "salt"], "left")

    def drop_shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened = zstandard.ZstdDecompressor()
        for b in batches:
            text, n, shared = [], [], []
            for blob, kinds, gone in zip(*(c.to_pylist() for c in b.columns[2:])):
                gone = list(map(bool, gone)) if gone is not None else [False] * len(kinds)
                lines = opened.decompress(blob).decode("utf-8", "surrogatepass")
                stay = chosen(list(kinds), gone)
                wanted = MAIN if MAIN in kinds else OPEN
                if wanted == OPEN:
                    kept = iter(lines.split("\n"))
                    lines = "\n".join([t for t, s in [(next(kept), s) for k, s in zip(kinds, stay) if k == OPEN] if s])
                text.append(lines)
                n.append(len(kinds))
                shared.append(sum(g and not s for g, s in zip(gone, stay)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(text, pa.string()), pa.array(n, pa.int64()), pa.array(shared, pa.int64())], ["page_id", "url", "text", "n_lines", "n_shared"])

    out = compared.select("page_id", "url", "lines", "kinds", "gone").mapInArrow(drop_shared, f"page_id {kind}, url string, text string, n_lines long, n_shared long")
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"), "n_lines", "n_shared")


def op7_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
