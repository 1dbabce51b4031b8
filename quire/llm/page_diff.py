"""Main text of web pages by nearest-URL page differencing (operator 1).

A page is cut into blocks of text (its lines).  Lines inside menus, page headers,
footers, sidebars, notices, adverts, forms, reader comments and other non-text elements are
marked as chrome by their element, class or id, unless the element so marked wraps the page's
``article`` or ``main``, or most of the text of a page (or article) without any outside it.  What markup does not tell
(lines outside any ``article`` or ``main``, and inside them those of elements whose class merely contains a chrome word, as in
``notice-board``) is told by the nearest page that is not a copy: pages of a host are ordered by URL path, each is paired with
the neighbour on either side with other lines that shares the longer path prefix, the lines of both are aligned by
longest common subsequence, and the aligned (shared) lines that are open are template text and are deleted.  If all
text of a page is shared, the page is part of its neighbour, and stays.

Tags are read as browsers read them, in linear time: quotes count only around attribute values, and
a comment or tag that is never closed ends with the page.

Pages are parsed twice: once for their line hashes, which are written, and once for their lines, which go, compressed, straight to the
hashes of the nearest page.  Rows are told apart by a hash of all they hold, so both passes agree whatever the input's partitions.  Pairing
sorts narrow rows over range partitions; only the first and last row of each partition are looked
up across partitions, so a host with a third of all pages is no task of its own.  The alignment is bit-parallel with
divide and conquer, exact at any length, in memory linear in the number of lines.

Defined results: null or empty html gives an empty text; a null url has no host and is
paired among such pages; repeated rows are copies of each other and are compared with the next other page; a host with one page
is told by markup alone; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from hashlib import blake2b
from os.path import commonprefix

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from quire.llm.common import materialize, table

# Elements without readable text, chrome elements, elements that end a block, elements without an end.
SILENT = {"script", "style", "noscript", "template", "svg", "iframe", "object", "canvas", "head", "title", "textarea", "select",
          "button", "annotation", "annotation-xml", "audio", "video"}
CHROME = {"nav", "footer", "aside", "form", "menu", "dialog", "header"}
MAIN = {"article", "main"}
BLOCK = {"address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "div", "dl", "dt",
         "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr", "html",
         "legend", "li", "main", "menu", "nav", "ol", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th",
         "thead", "tr", "ul"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
RAW = {"script", "style", "textarea", "title"}
# What may stand in a head; any other element, and any text, ends it.
HEAD = {"base", "basefont", "bgsound", "link", "meta", "title", "noscript", "noframes", "script", "style", "template", "head", "object"}
# Words of class, id and role values that mark chrome.
CHROME_WORDS = {
    "nav", "navbar", "navigation", "menu", "breadcrumb", "breadcrumbs", "sidebar", "aside", "footer", "header", "masthead", "banner",
    "topbar", "ad", "ads", "advert", "adverts", "advertisement", "advertising", "sponsor", "sponsored", "promo", "promotion",
    "cookie", "cookies", "consent", "notice", "notices", "alert", "popup", "modal", "newsletter", "subscribe", "signup", "login",
    "share", "sharing", "social", "related", "recommended", "widget", "comment", "comments", "respond", "disqus", "replies",
    "search", "pagination", "pager", "toolbar", "complementary", "contentinfo", "form", "skip", "copyright"}

_TAG = re.compile(r"[a-zA-Z][^\s/>]*")
# One attribute; an open quote without its end takes the rest of the page.
_ATTRIBUTE = re.compile(
    r"[\s/]*([^\s/>][^\s/>=]*)(?:\s*=\s*(?:\"([^\"]*)(?:\"|\Z)|'([^']*)(?:'|\Z)|([^\s>\"'][^\s>]*)))?")
_TAG_END = re.compile(r"[\s/]*>")
ATTRIBUTES = {"class", "id", "role", "hidden", "aria-hidden", "style"}
_WORDS = re.compile(r"[a-z]+")
_SPACE = re.compile(r"\s+")
# A class that says which parts the page has, as in has-header or no-sidebar, is no mark.
ABOUT = {"has", "no", "with", "without"}
READERS = {"comment", "comments", "respond", "disqus", "replies"}
# Words that say where or how a part is shown, and nothing of what it holds.
SHAPE = {"area", "bar", "block", "body", "bottom", "box", "boxes", "btn", "button", "buttons", "card", "cell", "col", "column",
         "container", "content", "desktop", "element", "float", "global", "group", "grid", "holder", "icon", "icons", "inline", "inner", "item",
         "items", "large", "layout", "left", "link", "links", "list", "main", "medium", "mobile", "module", "nav", "outer", "overlay", "page",
         "pane", "panel", "part", "post", "posts", "primary", "region", "right", "root", "row", "secondary", "section", "site", "slot",
         "small", "sticky", "text", "title", "tools", "top", "unit", "view", "wrap", "wrapper", "zone"}
CHROME_LINE, OPEN_LINE, MAIN_LINE = 0, 1, 2
NONE, WEAK, STRONG, DOUBT = 0, 1, 2, 3


def chrome_mark(tag: str, attributes: dict[str, str], in_main: bool) -> int:
    """How surely an element is chrome: WEAK marks are also found on wrappers of whole pages, DOUBT leaves an article's part open."""
    if tag in CHROME and not (tag == "header" and in_main):
        return WEAK if tag in ("form", "header") else STRONG
    if tag in ("html", "body") or tag in MAIN or not attributes:
        return NONE
    mark, doubt = NONE, False
    for name, value in attributes.items():
        value = value.lower()
        if name == "hidden" or name == "aria-hidden" and value == "true":
            return STRONG
        if name == "style":
            if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
                return STRONG
        elif not (in_main and tag in ("h1", "h2", "h3", "header")):
            for one in value.split():
                words = _WORDS.findall(one)
                if words and words[0] not in ABOUT and CHROME_WORDS.intersection(words):
                    if in_main and not all(w in CHROME_WORDS or w in SHAPE for w in words):
                        doubt = True
                    else:
                        mark = max(mark, STRONG if in_main and READERS.intersection(words) else WEAK)
    return DOUBT if mark == NONE and doubt else mark


def line_kinds(parent: list[int], tags: list[str], marks: list[int], lines: list[tuple[str, int]]) -> list[int]:
    """The kind of every line, given its element, and each element's parent (before it; -1: none), tag and mark.

    Marks of wrappers are taken off first, from the outside in.
    """
    size = len(parent)
    doubt = [m == DOUBT for m in marks]
    marks = [NONE if m == DOUBT else m for m in marks]
    chars, told = [0] * size, [0] * size  # characters in an element, and of them in article or main
    bare = [0] * size  # characters in an element outside marked ones in it
    has_main, within, chrome = [False] * size, [-1] * size, [False] * size
    total = free = 0  # characters of the page, and of them outside chrome as marked
    for text, e in lines:
        total += len(text)
        if e >= 0:
            chars[e] += len(text)
            bare[e] += len(text)
        else:
            free += len(text)
    all_told = 0
    for e in range(size - 1, -1, -1):
        if tags[e] in MAIN:
            told[e] = chars[e]
            has_main[e] |= tags[e] == "main" and chars[e] > 0
        shown = 0 if marks[e] else bare[e]
        if (up := parent[e]) >= 0:
            chars[up] += chars[e]
            told[up] += told[e]
            bare[up] += shown
            has_main[up] |= has_main[e]
        else:
            free += shown
            all_told += told[e]
    for e in range(size):
        up = parent[e]
        if up >= 0:  # the article or main that holds the element
            within[e] = up if tags[up] in MAIN else within[up]
            doubt[e] |= doubt[up]
        hidden = up >= 0 and chrome[up]
        keeps = marks[e] == NONE
        if not keeps and not hidden:
            if within[e] >= 0:
                keeps = marks[e] == WEAK and 2 * chars[e] > chars[within[e]]
            elif has_main[e]:
                keeps = True
            elif told[e] and 2 * told[e] >= all_told:
                keeps = told[e] > free
            else:
                keeps = marks[e] == WEAK and told[e] == all_told and 2 * chars[e] > total
            if keeps:
                free += bare[e]
        chrome[e] = hidden or not keeps
    return [OPEN_LINE if e < 0 else CHROME_LINE if chrome[e] else MAIN_LINE if (tags[e] in MAIN or within[e] >= 0) and not doubt[e]
            else OPEN_LINE for _, e in lines]


def read_tag(source: str, at: int) -> tuple[str, dict[str, str], bool, int]:
    """(name, the attributes that matter, ends in a slash, place after it) of the tag whose name begins at ``at``."""
    name = _TAG.match(source, at)
    at, size = name.end(), len(source)
    attributes: dict[str, str] = {}
    while at < size:
        if end := _TAG_END.match(source, at):
            return name[0].lower(), attributes, source[end.end() - 2] == "/", end.end()
        one = _ATTRIBUTE.match(source, at)
        if not one:
            break
        if (key := one[1].lower()) in ATTRIBUTES:
            attributes.setdefault(key, one[2] or one[3] or one[4] or "")
        at = one.end()
    return name[0].lower(), attributes, False, size


def _after(source: str, text: str, at: int) -> int:
    """The place after ``text``, or the end."""
    found = source.find(text, at)
    return found + len(text) if found >= 0 else len(source)


def page_lines(source: str) -> list[tuple[str, int]]:
    """(text, kind) of every block of a page in order."""
    lines: list[tuple[str, int]] = []  # text and element
    stack: list[tuple[str, bool, bool, int]] = []  # tag, silent and main (of the element and what holds it), element
    parent: list[int] = []
    tags: list[str] = []
    marks: list[int] = []
    text: list[str] = []

    def flush() -> None:
        if text:
            joined = _SPACE.sub(" ", html.unescape("".join(text))).strip()
            if joined:
                lines.append((joined, stack[-1][3] if stack else -1))
            text.clear()

    held: Counter = Counter()  # open elements by tag

    def end_from(k: int) -> None:
        for entry in stack[k:]:
            held[entry[0]] -= 1
        del stack[k:]

    def end_last(tag: str) -> None:
        if held[tag] > 0:
            k = len(stack) - 1
            while stack[k][0] != tag:
                k -= 1
            end_from(k)

    at, size = 0, len(source)
    while at < size:
        lt = source.find("<", at)
        if lt < 0:
            lt = size
        if lt > at and stack and stack[-1][0] == "head" and not source[at:lt].isspace():
            end_from(len(stack) - 1)
        if lt > at and not (stack and stack[-1][1]):
            text.append(source[at:lt])
        if lt == size:
            break
        mark = source[lt + 1 : lt + 2]
        close = mark == "/"
        if mark == "!":
            at = (_after(source, "-->", lt + 2) if source.startswith("<!--", lt) else _after(source, "]]>", lt)
                  if source.startswith("<![CDATA[", lt) else _after(source, ">", lt))
            continue
        if mark == "?":
            at = _after(source, ">", lt)
            continue
        if not _TAG.match(source, lt + 1 + close):
            if not (stack and stack[-1][1]):
                text.append("<")
            at = lt + 1
            continue
        tag, attributes, slash, at = read_tag(source, lt + 1 + close)
        if close:
            if tag in BLOCK:
                flush()
            end_last(tag)
            continue
        if tag not in HEAD and held["head"] > 0 and (stack[-1][0] == "head" or tag == "body"):
            end_from(next(k for k, entry in enumerate(stack) if entry[0] == "head"))
        if tag == "br":
            text.append(" ")
            continue
        if tag in BLOCK:
            flush()
            if tag in ("p", "li", "dt", "dd", "tr", "td", "th") or tag in BLOCK and stack and stack[-1][0] == "p":
                if (k := _implied_end(stack, tag)) >= 0:
                    end_from(k)
        if tag in VOID or slash and tag not in BLOCK and tag not in RAW:
            continue
        _, silent, main, up = stack[-1] if stack else ("", False, False, -1)
        parent.append(up)
        tags.append(tag)
        marks.append(chrome_mark(tag, attributes, main))
        stack.append((tag, silent or tag in SILENT, main or tag in MAIN, len(tags) - 1))
        held[tag] += 1
        if tag in RAW:
            end = re.compile(rf"</{tag}\b", re.I).search(source, at)
            at = end.start() if end else size
    flush()
    return [(x, kind) for (x, _), kind in zip(lines, line_kinds(parent, tags, marks, lines))]


def _implied_end(stack: list, tag: str) -> int:
    """Where the open element begins that the start of ``tag`` ends: a paragraph, or an item of the same list or row; else -1.

    Inline elements left open inside it end with it.
    """
    ends = {"li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th", "p"},
            "td": {"td", "th", "p"}, "th": {"td", "th", "p"}}.get(tag, {"p"})
    for k in range(len(stack) - 1, -1, -1):
        if stack[k][0] in ends:
            return k
        if stack[k][0] in BLOCK:
            break
    return -1


def _row(a: list, b: list) -> np.ndarray:
    """LCS lengths of a against every prefix of b (bit-parallel)."""
    where: dict = {}
    for j, x in enumerate(b):
        where[x] = where.get(x, 0) | 1 << j
    full = (1 << len(b)) - 1
    v = full
    for x in a:
        u = v & where.get(x, 0)
        v = (v + u | v - u) & full
    bits = np.unpackbits(np.frombuffer(v.to_bytes(len(b) // 8 + 1, "little"), np.uint8), bitorder="little")[: len(b)]
    return np.concatenate([[0], np.cumsum(bits == 0)])


def common(a: list, b: list) -> list[int]:
    """Positions in ``a`` of a longest common subsequence of ``a`` and ``b``."""
    out: list[int] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        i, k, j, m = todo.pop()
        while i < k and j < m and a[i] == b[j]:
            out.append(i)
            i, j = i + 1, j + 1
        while i < k and j < m and a[k - 1] == b[m - 1]:
            k, m = k - 1, m - 1
            out.append(k)
        if i == k or j == m:
            continue
        if k - i == 1:
            if a[i] in b[j:m]:
                out.append(i)
            continue
        mid = (i + k) // 2
        ahead, back = _row(a[i:mid], b[j:m]), _row(a[mid:k][::-1], b[j:m][::-1])[::-1]
        cut = j + int(np.argmax(ahead + back))
        todo += [(i, mid, j, cut), (mid, k, cut, m)]
    return sorted(out)


def kept_lines(kinds: list[int], own: list, other: list | None) -> list[int]:
    """Positions of the lines that are main text, given the line hashes of the nearest other page."""
    told = [i for i, k in enumerate(kinds) if k != CHROME_LINE]
    if other and any(kinds[i] == OPEN_LINE for i in told):
        shared = set(common(own, other))
        if not shared.issuperset(told):
            return [i for i in told if kinds[i] == MAIN_LINE or i not in shared]
    return told


def line_hashes(lines: list[str]) -> bytes:
    return b"".join(blake2b(x.encode("utf-8", "surrogatepass"), digest_size=8).digest() for x in lines)


def packed(lines: list[tuple[str, int]]) -> bytes:
    """The lines and kinds of a page, compressed; no line holds a line end."""
    body = bytes(k for _, k in lines) + "\n".join(x for x, _ in lines).encode("utf-8", "surrogatepass")
    return len(lines).to_bytes(4, "little") + zstandard.ZstdCompressor(level=3).compress(body)


def unpacked(data: bytes) -> tuple[list[str], list[int]]:
    n = int.from_bytes(data[:4], "little")
    body = zstandard.ZstdDecompressor().decompress(data[4:])
    return body[n:].decode("utf-8", "surrogatepass").split("\n") if n else [], list(body[:n])


def named(pages: DataFrame) -> DataFrame:
    """``key, page_id, url, html``: ids as strings, since pandas turns whole numbers beside a null into floats."""
    ident = F.col("page_id").cast("long").cast("string")
    parts = [F.coalesce(F.concat(F.lit("="), c), F.lit("null")) for c in (ident, F.col("url"), F.col("html"))]
    return pages.select(F.unhex(F.md5(F.concat_ws("\x00", *parts))).alias("key"), ident.alias("page_id"), "url", "html")


def signed(pages: DataFrame) -> DataFrame:
    """``key, page_id, host, path, hashes, sign`` of pages with a ``key``; ``sign`` tells pages of other lines."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            hashes = [line_hashes([x for x, _ in page_lines(h or "")]) for h in pdf["html"]]
            yield pd.DataFrame({"key": pdf["key"], "page_id": pdf["page_id"], "url": pdf["url"], "hashes": hashes,
                                "sign": [int.from_bytes(blake2b(h, digest_size=8).digest(), "little", signed=True) for h in hashes]})

    out = pages.mapInPandas(run, "key binary, page_id string, url string, hashes binary, sign long")
    parts = F.regexp_extract(F.coalesce("url", F.lit("")), r"^(?:[a-zA-Z][\w+.-]*:)?//([^/?#]*)([^?#]*)", 0)
    host = F.lower(F.regexp_extract(parts, r"//([^/?#]*)", 1))
    path = F.when(parts == "", F.coalesce("url", F.lit(""))).otherwise(F.regexp_extract(parts, r"//[^/?#]*(.*)", 1))
    return out.withColumn("host", host).withColumn("path", path).drop("url")


@F.pandas_udf(IntegerType())
def _shared_prefix(own: pd.Series, other: pd.Series) -> pd.Series:
    """Characters that two paths share from the beginning; -1 without another path."""
    return pd.Series([-1 if b is None else len(commonprefix([a, b])) for a, b in zip(own, other)], dtype="int32")


def nearest(cut: DataFrame) -> DataFrame:
    """``key, other``: of every page that has one, the nearest page of its host with other lines."""
    ranged = cut.select("key", "host", "path", "page_id", "sign").repartitionByRange("host", "path", "page_id", "key")
    ranged = materialize(ranged.withColumn("pid", F.spark_partition_id()), "ranged")
    order = ["host", "path", "page_id", "key"]
    item = F.struct("host", "path", "sign", "key")
    ahead = Window.partitionBy("pid").orderBy(*order)
    back = Window.partitionBy("pid").orderBy(*[F.desc(c) for c in order])
    # First and last rows of the partitions: two rows each, whatever the number of pages.
    ends = ranged.groupBy("pid").agg(F.min_by(item, F.struct(*order)).alias("first"), F.max_by(item, F.struct(*order)).alias("last"))
    across = Window.orderBy("pid")
    ends = ends.select("pid", F.lag("last").over(across).alias("before"), F.lead("first").over(across).alias("after"))
    # the page before a run of equal pages, carried through the run; the same backwards
    near = ranged.withColumn("_prev", F.when(F.lag("sign").over(ahead) != F.col("sign"), F.lag(item).over(ahead)))
    near = near.withColumn("_next", F.when(F.lag("sign").over(back) != F.col("sign"), F.lag(item).over(back)))
    so_far = lambda w: w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    near = near.withColumn("prev", F.last("_prev", ignorenulls=True).over(so_far(ahead)))
    near = near.withColumn("next", F.last("_next", ignorenulls=True).over(so_far(back))).join(ends, "pid")
    side = lambda c: F.when((F.col(c)["host"] == F.col("host")) & (F.col(c)["sign"] != F.col("sign")), F.col(c))
    near = near.select("key", "path", "host", "sign", F.coalesce("prev", "before").alias("prev"), F.coalesce("next", "after").alias("next"))
    near = near.withColumn("prev", side("prev")).withColumn("next", side("next"))
    near = near.withColumn("b", _shared_prefix("path", F.col("prev.path"))).withColumn("a", _shared_prefix("path", F.col("next.path")))
    other = F.when(F.col("a") > F.col("b"), F.col("next.key")).otherwise(F.col("prev.key"))
    return near.select("key", other.alias("other")).where("other is not null").dropDuplicates(["key"])  # repeated rows have one


def main_text(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars, n_shared`` of every row of ``pages``; ``n_shared`` counts lines that differencing deleted."""
    rows = named(pages)
    cut = materialize(signed(rows), "signs")
    known = cut.select(F.col("key").alias("other"), "hashes").dropDuplicates(["other"])
    near = nearest(cut).join(known, "other").select("key", "hashes")

    def lines(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"key": pdf["key"], "page_id": pdf["page_id"], "url": pdf["url"],
                                "lines": [packed(page_lines(h or "")) for h in pdf["html"]]})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            texts, shared = [], []
            for data, hashes in zip(pdf["lines"], pdf["hashes"]):
                lines, kinds = unpacked(data)
                open_lines = OPEN_LINE in kinds
                numbers = lambda x: np.frombuffer(x, np.int64).tolist()
                keep = kept_lines(kinds, numbers(line_hashes(lines)) if open_lines else [], numbers(hashes) if open_lines and hashes else None)
                texts.append("\n\n".join(lines[i] for i in keep))
                shared.append(sum(k != CHROME_LINE for k in kinds) - len(keep))
            yield pd.DataFrame({"page_id": pdf["page_id"], "url": pdf["url"], "text": texts,
                                "n_chars": [len(t) for t in texts], "n_shared": shared})

    full = rows.mapInPandas(lines, "key binary, page_id string, url string, lines binary")
    both = full.join(near, "key", "left").select("page_id", "url", "lines", "hashes")
    out = both.mapInPandas(run, "page_id string, url string, text string, n_chars long, n_shared long")
    return out.withColumn("page_id", F.col("page_id").cast("long"))


def op1_page_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of all pages."""
    return main_text(table(spark, sf_dir, "pages"))


QUERIES = {"op1_page_diff": op1_page_diff}
