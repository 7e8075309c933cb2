"""Main text of HTML pages: nearest-URL page differencing, beside what the markup itself says.

A page becomes blocks of text. Elements that name what they are (navigation, footers, forms, adverts, comments, ...) are left
out, and where a page marks its article (``article``, else ``main``) only that is kept. Where it marks none, lines that the site
repeats are found by differencing: pages are put in order of URL path within each host, each is paired with the nearer of
its two neighbours (longer common path, then the earlier one), the lines of both are aligned by longest common
subsequence, and the shared ones are deleted. If what is left over in both pages is nearly nothing, they are one page under
two URLs and nothing is deleted. If the pair shares most lines and most of their text, they are edited copies of one page, and the
other neighbour is taken instead; if that is a copy too, nothing is deleted.

Pages are dealt over ranges of (host, path), so a host with a third of all pages is many ranges. Each range also gets the last
page before it and the first one after it, so pairs don't depend on how pages were dealt.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessellane.llm.shared import small_batches, whole_text
from tessellane.llm.urls import host_of, path_of

#: Characters of HTML in a range on average, and the most ranges; the sample of keys from which ranges are cut.
RANGE_CHARS, MOST_RANGES, SAMPLE = 4_000_000, 20_000, 100_000
#: Characters of HTML that a task reads on average at most, as long as there are no more than MOST_RANGES tasks.
TASK_CHARS = 16_000_000
#: A pair is taken for copies of one page only if it shares more than this part of a page's lines, and moreover either more than
#: this part of both pages' code points or all but ``COPY_REST`` code points (a date, a counter) of each.
COPY_SHARE = 0.7
COPY_REST = 40

_TOKEN = re.compile(
    r"<!--(?:>|->|.*?(?:--!?>|\Z))|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>\"'<]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<(/?)([a-zA-Z][^\s/>\"'<]*)([^>]*)(?:>|\Z)", re.S
)
#: Elements whose content is no text of the page; skipped up to their end tag.
_RAW = {"script", "style", "title", "textarea", "noscript", "iframe", "template", "svg", "math", "noframes", "noembed", "xmp", "object", "audio", "video", "canvas"}
_OUT = {"nav", "footer", "aside", "form", "menu", "button", "select", "dialog", "datalist", "fieldset", "head"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_BLOCK = {
    "address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3",
    "h4", "h5", "h6", "head", "header", "hgroup", "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul",
}
_ENDS_P = _BLOCK - {"body", "html", "head", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "legend"}
_WORDS_OUT = {
    "ad", "ads", "adv", "advert", "adverts", "advertisement", "advertising", "sponsor", "sponsored", "promo", "promotion", "banner", "cookie", "cookies", "consent", "gdpr", "notice", "notices", "notification", "alert",
    "menu", "menus", "nav", "navbar", "navigation", "breadcrumb", "breadcrumbs", "sidebar", "sidebars", "footer", "comment", "comments", "commentlist", "respond", "disqus", "share", "sharing", "social", "related", "newsletter",
    "subscribe", "subscription", "signup", "login", "popup", "modal", "overlay", "widget", "pagination", "pager", "search", "toolbar", "topbar", "masthead", "copyright", "skip", "form",
}
#: Beside such a word, these leave a name what it is: ``ad-slot`` is an advert, ``ad-hoc`` isn't.
_WORDS_BESIDE = {
    "area", "article", "articles", "bar", "block", "body", "bottom", "box", "button", "buttons", "container", "content", "element", "entry", "first", "fixed", "global", "group", "header", "holder", "icons", "inner", "inline",
    "item", "items", "js", "last", "left", "level", "link", "links", "list", "main", "mobile", "module", "outer", "page", "pane", "panel", "popular", "post", "posts", "primary", "reader", "region", "right", "row", "secondary",
    "section", "site", "slot", "space", "sticky", "stories", "sub", "the", "this", "top", "unit", "user", "web", "wide", "wrap", "wrapper", "zone",
}
#: Articles of these classes announce other pages.
_TEASERS = {"card", "excerpt", "preview", "promo", "recommendation", "related", "teaser", "thumbnail", "tile"}
_ROLES_OUT = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert", "alertdialog", "menu", "menubar", "toolbar", "form"}
#: Attributes one after the other, so that words inside a value are no names.
_NAMED = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
#: Attributes longer than this are looked at anew each time, which bounds the cache's memory.
_CACHED = 500
_PARTS = re.compile(r"[^a-z0-9]+")


def _is_name_of_other(name: str) -> bool:
    """Whether a class or id says that an element isn't main text: all its words do, but for some that change nothing."""
    words = [w for w in _PARTS.split(name) if w and not w.isdigit()]
    return not _WORDS_OUT.isdisjoint(words) and all(w in _WORDS_OUT or w in _WORDS_BESIDE for w in words)


def _attributes(attributes: str) -> Iterator[tuple[str, str]]:
    for name, a, b, c in _NAMED.findall(attributes):
        yield name.lower(), (a or b or c).lower()


def _names_itself(tag: str, attributes: str, in_article: bool) -> bool:
    """Whether an element names itself as something other than the page's main text."""
    if tag in _OUT:
        return True
    if tag == "header" and not in_article:
        return True
    if not attributes or tag in ("html", "body", "main"):
        return False
    for name, value in _attributes(attributes):
        if name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "role" and value in _ROLES_OUT):
            return True
        if name in ("class", "id"):
            names = value.split()
            if any(map(_is_name_of_other, names)):
                return True
            if not in_article and tag != "article" and any("header" in _PARTS.split(n) for n in names):
                return True
    return False


def _announces(attributes: str) -> bool:
    """Whether an article's classes say that it only announces another page."""
    return any(name == "class" and not _TEASERS.isdisjoint(_PARTS.split(value)) for name, value in _attributes(attributes))


_cached = lru_cache(maxsize=4096)(_names_itself)


def _left_out(tag: str, attributes: str, in_article: bool) -> bool:
    return (_cached if len(attributes) <= _CACHED else _names_itself)(tag, attributes, in_article)


def blocks(page: str) -> tuple[list[str], bool]:
    """Blocks of text in page order and whether the page marks its main text (they are from there then)."""
    found: list[tuple[str, int]] = []  # text, 2 in an article, 1 in main
    stack: list[tuple[str, bool, int]] = []
    out, level = False, 0
    held: list[str] = []

    def flush() -> None:
        if held:
            text = " ".join("".join(held).split())
            if text:
                found.append((text, level))
            held.clear()

    def data(piece: str) -> None:
        if piece and not out:
            held.append(entities.unescape(piece) if "&" in piece else piece)

    at, skip, n = 0, None, len(page)
    while at < n:
        if skip:  # raw text ends at its own end tag only
            end = re.compile(rf"</{re.escape(skip)}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I).search(page, at)
            at, skip = (end.end() if end else n), None
            continue
        m = _TOKEN.search(page, at)
        if m is None:
            data(page[at:])
            break
        data(page[at : m.start()])
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        if m[1] or m[4]:
            if tag == "br":
                data(" ")
            elif tag == "p" and not any(s[0] == "p" for s in stack):
                flush()
            elif any(s[0] == tag for s in stack):
                if tag in _BLOCK or out:
                    flush()
                while stack:
                    name, out, was = stack.pop()
                    if name in _BLOCK:
                        flush()
                    level = was
                    if name == tag:
                        break
            continue
        attributes = m[3] or m[6] or ""
        if tag in _RAW:
            if not attributes.endswith("/") or tag in ("script", "style", "title", "textarea"):
                skip = tag
            continue
        if tag in _VOID:
            if tag == "br":
                data(" ")
            elif tag == "hr":
                flush()
            continue
        if tag in _BLOCK:
            flush()
            if tag in _ENDS_P:
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] == "p":
                        out, level = stack[i][1], stack[i][2]
                        del stack[i:]
                        break
                    if stack[i][0] in _BLOCK:
                        break
        if attributes.endswith("/") and tag not in _BLOCK:
            continue
        stack.append((tag, out, level))
        if not out and _left_out(tag, attributes, level > 0):
            flush()
            out = True
        if tag == "article" and not _announces(attributes):
            level = 2
        elif tag == "main":
            level = max(level, 1)
    flush()
    best = max((k for _, k in found), default=0)
    return [t for t, k in found if k == best], best > 0


def shared_lines(a: list[str], b: list[str]) -> list[int]:
    """Indices of ``a`` in a longest common subsequence of ``a`` and ``b``.

    Common ends are taken first; the rest is Crochemore's bit-vector recurrence with a row of bits kept for each line of ``a``.
    """
    s = 0
    while s < len(a) and s < len(b) and a[s] == b[s]:
        s += 1
    e = 0
    while e < len(a) - s and e < len(b) - s and a[-1 - e] == b[-1 - e]:
        e += 1
    head, tail = list(range(s)), list(range(len(a) - e, len(a)))
    inner, other = a[s : len(a) - e], b[s : len(b) - e]
    common = set(inner) & set(other)
    keep = [i for i, x in enumerate(inner) if x in common]
    other = [x for x in other if x in common]
    if not keep:
        return head + tail
    places: dict[str, int] = {}
    for j, x in enumerate(other):
        places[x] = places.get(x, 0) | 1 << j
    full = (1 << len(other)) - 1
    row, rows = full, []
    for i in keep:
        u = row & places[inner[i]]
        row = ((row + u) | (row - u)) & full
        rows.append(row)
    middle, j = [], len(other)
    for k in range(len(keep) - 1, -1, -1):
        length = lambda r, j: j - (r & ((1 << j) - 1)).bit_count()  # noqa: E731  LCS with the first j lines of b
        before = rows[k - 1] if k else full
        if length(rows[k], j) > length(before, j):
            middle.append(s + keep[k])
            want = length(rows[k], j) - 1
            while j and not (other[j - 1] == inner[keep[k]] and length(before, j - 1) == want):
                j -= 1
            j -= 1
    return head + middle[::-1] + tail


class _Page:
    def __init__(self, row: tuple) -> None:
        self.host, self.path, self.page_id, self.url, page, self.halo = row
        self.lines, self.marked = blocks(page)

    def text(self, before: _Page | None, after: _Page | None) -> str:
        lines = self.lines
        near = [p for p in (before, after) if p is not None and p.host == self.host]
        if near and not self.marked and self.host:
            for partner in sorted(near, key=lambda p: -_common(self.path, p.path)):
                if partner.marked and not partner.lines:
                    break
                shared = shared_lines(lines, partner.lines)
                both = sum(len(lines[i]) for i in shared)
                sizes = [sum(map(len, p.lines)) for p in (self, partner)]
                if len(shared) > COPY_SHARE * len(lines):
                    if max(sizes) - both <= COPY_REST:
                        break
                    if both > COPY_SHARE * max(sizes):
                        continue
                gone = set(shared)
                lines = [x for i, x in enumerate(lines) if i not in gone]
                break
        return "\n\n".join(lines)


def _common(a: str, b: str) -> int:
    n = 0
    for x, y in zip(a, b, strict=False):
        if x != y:
            break
        n += 1
    return n


def _streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by (range, host, path, page_id, html): range, host, path, page_id, url, html, halo."""
    before, now, where, kind = None, None, None, None
    out: list[tuple] = []

    def settle(after: _Page | None) -> None:
        if now is not None and not now.halo:
            text = now.text(before, after)
            out.append((now.page_id, now.url, text, len(text)))

    def made() -> pa.RecordBatch:
        cols = list(zip(*out, strict=True)) or [()] * 4
        out.clear()
        return pa.record_batch([pa.array(c, k) for c, k in zip(cols, (kind, pa.string(), pa.string(), pa.int64()), strict=True)], ["page_id", "url", "text", "n_chars"])

    for batch in batches:
        kind = batch.column(3).type
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            fresh = _Page(row[1:])
            if row[0] != where:
                settle(None)
                before, now, where = None, None, row[0]
            settle(fresh if now is not None else None)
            before, now = now, fresh
        yield made()
    settle(None)
    if out:
        yield made()


def main_text(pages: DataFrame, page: str = "html") -> DataFrame:
    """page_id, url, text, n_chars (code points): one row a page.

    Character references are decoded, white space inside a block is one space, blocks are trimmed and joined by two line
    feeds. Null and empty pages have the empty text; a null URL pairs with nothing; repeated rows stay; an empty table gives
    an empty table; pages are read whole, however long; other columns aren't read.
    """
    spark = pages.sparkSession
    small_batches(spark)
    kind = pages.schema["page_id"].dataType.simpleString()
    rows = pages.select(host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), "page_id", "url", whole_text(page).alias("html"))
    key = F.struct("host", "path", F.coalesce(F.col("page_id").cast("string"), F.lit("")).alias("id"))
    keys = rows.select(key.alias("k"))
    size = rows.agg(F.count("*").alias("n"), F.sum(F.length("html")).alias("chars")).first()
    total = size["chars"] or 0
    parts = int(max(int(spark.conf.get("spark.sql.shuffle.partitions", "200")), 1, min(MOST_RANGES, total // TASK_CHARS)))
    # Several ranges a task even out what chance deals to the tasks.
    n = int(min(MOST_RANGES, max(4 * parts, total // RANGE_CHARS)))
    # Ranges are cut from a bounded sample of keys (it only balances the work; results don't depend on it).
    share = min(1.0, SAMPLE / max(size["n"], 1) / 2)
    sample = keys.where((F.pmod(F.xxhash64("k"), F.lit(1 << 30)) / float(1 << 30)) <= share).limit(SAMPLE).collect()
    sample = sorted({"\0".join(r["k"]) for r in sample})
    cuts = sorted({sample[len(sample) * i // n] for i in range(1, n)}) if sample else []

    @F.pandas_udf("int")
    def range_of(joined: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(np.array(cuts, object), joined.to_numpy(object), "right").astype(np.int32)) if cuts else pd.Series(np.zeros(len(joined), np.int32))

    placed = rows.withColumn("id", key["id"]).withColumn("range", range_of(F.concat_ws("\0", "host", "path", "id")))
    ends = [r for r in placed.groupBy("range").agg(F.min(F.struct("host", "path", "id")).alias("low"), F.max(F.struct("host", "path", "id")).alias("high")).orderBy("range").collect()]
    goes = [(a["range"], *a["high"], b["range"]) for a, b in zip(ends, ends[1:], strict=False)] + [(b["range"], *b["low"], a["range"]) for a, b in zip(ends, ends[1:], strict=False)]
    own = placed.select("range", "host", "path", "page_id", "url", "html", "id", F.lit(False).alias("halo"))
    if goes:
        halo = spark.createDataFrame([tuple(g) for g in goes], "own int, h string, p string, i string, goes int")
        on = (F.col("range") == F.col("own")) & (F.col("host") == F.col("h")) & (F.col("path") == F.col("p")) & (F.col("id") == F.col("i"))
        seen = placed.join(F.broadcast(halo), on).select(F.col("goes").alias("range"), "host", "path", "page_id", "url", "html", "id", F.lit(True).alias("halo"))
        own = own.unionByName(seen)
    dealt = own.repartition(parts, "range").sortWithinPartitions("range", "host", "path", "id", "html", "halo").drop("id")
    return dealt.mapInArrow(_streamed, f"page_id {kind}, url string, text string, n_chars long")
