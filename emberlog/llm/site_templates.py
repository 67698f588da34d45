"""Main text of web pages: subtrees that recur across a host's pages are its template and go.

Every page is read as a tree of block elements. Each element outside the article (and each container inside it) gets a
hash of its whole subtree; Spark counts the hashes per host; what recurs on enough of the host's different pages is deleted.
Elements that name themselves as boilerplate (navigation, forms, comments, adverts, ...) go on every page, so that hosts
with a page or two are cleaned as well. If a page marks its article, only that is main text.
"""

from __future__ import annotations

import html
import pickle
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberlog.llm.common import batches, ready
from emberlog.session import materialise

#: A subtree is template if it stands on this many different pages of the host, and on this share of them or as many as
#: the binary logarithm of their number: what a section has, or every so many pages, recurs on a large host as well.
LEAST_PAGES = 3
LEAST_SHARE = 0.2

_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([A-Za-z][^\s/>]*)([^>\"']*(?:\"[^\"]*\"[^>\"']*|'[^']*'[^>\"']*)*)>"
    r"|<(/?)([A-Za-z][^\s/>]*)([^>]*)(?:>|\Z)",
    re.DOTALL,
)
_ATTRIBUTE = re.compile(r"(?<![\w-])(class|id|role|hidden|aria-hidden)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.IGNORECASE)
_RAW = {name: re.compile(rf"</{name}\s*>?", re.IGNORECASE) for name in ("script", "style", "textarea", "title", "noscript", "iframe", "xmp", "template")}

# The elements that cut text into blocks, and those that are never main text.
_BLOCKS = frozenset(
    "html head body main article section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th caption"
    " blockquote pre figure figcaption address details summary fieldset legend hgroup center"
    " nav header footer aside form menu dialog search button select option svg math object video audio canvas".split()
)
_BREAKS = frozenset(("br", "hr", "wbr"))
_DROPPED = frozenset("head nav header footer aside form menu dialog search button select svg object video audio canvas".split())
_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr"
    " notice popup modal overlay newsletter subscribe subscription signup sidebar aside menu nav navbar navigation topbar"
    " breadcrumb breadcrumbs footer header masthead comment comments reply replies disqus discussion share sharing social"
    " related recommended widget pagination pager skip".split()
)
_NEVER_BY_NAME = frozenset(("html", "body", "main"))
_ARTICLES = frozenset(("article", "main"))
# Inside an article, running text stays even where it recurs: copies and quotations are content.
_RUNNING = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre li dt dd td th tr tbody thead tfoot caption figcaption summary article main body html".split())
# An opening tag of the first kind ends an open element of the second.
_ENDS = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"},
    "body": {"head"}, "tbody": {"thead", "tbody", "tr", "td", "th"}, "tfoot": {"tbody", "tr", "td", "th"},
}
_SCOPES = frozenset("ul ol dl table article section div main body html nav aside header footer form blockquote".split())


@dataclass
class _Element:
    tag: str
    dropped: bool
    article: bool
    parts: list = field(default_factory=list)  # texts and elements, in order
    hash: int = 0


def _names_boilerplate(tag: str, attributes: str) -> bool:
    if not attributes or tag in _NEVER_BY_NAME:
        return False
    for name, *values in _ATTRIBUTE.findall(attributes):
        value, name = next((v for v in values if v), "").lower(), name.lower()
        if name == "hidden" or (name == "aria-hidden" and value == "true"):
            return True
        if name == "role" and value in _ROLES:
            return True
        if name in ("class", "id") and not _NAMES.isdisjoint(re.split(r"[\s_-]+", value)):
            return True
    return False


def _role_main(attributes: str) -> bool:
    return any(name.lower() == "role" and "main" in values for name, *values in _ATTRIBUTE.findall(attributes or ""))


def parse(page: str | None) -> _Element:
    """The tree of block elements. Inline elements leave no trace, block elements and line breaks part the text."""
    root = _Element("", False, False)
    stack, order, page = [root], [root], page or ""
    open_tags: Counter[str] = Counter()
    at, size = 0, len(page)
    pieces: list[str] = []

    def close_text() -> None:
        if pieces:
            joined = " ".join(html.unescape("".join(pieces)).split())
            if joined:
                stack[-1].parts.append(joined)
            pieces.clear()

    def close(i: int) -> None:
        open_tags.subtract(e.tag for e in stack[i:])
        del stack[i:]

    while at < size:
        found = _TAG.search(page, at)
        if found is None:
            pieces.append(page[at:])
            break
        pieces.append(page[at : found.start()])
        at = found.end()
        closing, tag, attributes = found.group(1, 2, 3) if found.group(2) else found.group(4, 5, 6)
        if tag is None:
            continue
        tag = tag.lower()
        if tag in _RAW and not closing:
            end = _RAW[tag].search(page, at)
            at = end.end() if end else size
            continue
        if tag in _BREAKS:
            close_text()
            continue
        if tag not in _BLOCKS:
            continue
        close_text()
        if closing:
            if open_tags[tag]:
                close(next(i for i in range(len(stack) - 1, 0, -1) if stack[i].tag == tag))
            continue
        if stack[-1].tag == "p":
            close(len(stack) - 1)
        if tag in _ENDS:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag in _ENDS[tag]:
                    close(i)
                    break
                if stack[i].tag in _SCOPES:
                    break
        own = _Element(tag, tag in _DROPPED or _names_boilerplate(tag, attributes), tag in _ARTICLES or _role_main(attributes))
        stack[-1].parts.append(own)
        order.append(own)
        if not attributes.endswith("/"):
            stack.append(own)
            open_tags[tag] += 1
    close_text()
    for element in reversed(order):
        inner = "\x00".join(p if isinstance(p, str) else f"\x01{p.hash}" for p in element.parts)
        element.hash = xxhash.xxh3_64_intdigest(f"{element.tag}\x00{inner}") >> 1
    return root


def _has_article(root: _Element) -> bool:
    waiting = [root]
    while waiting:
        for part in waiting.pop().parts:
            if not isinstance(part, str) and not part.dropped:
                if part.article:
                    return True
                waiting.append(part)
    return False


def candidates(root: _Element) -> set[int]:
    """Hashes of the subtrees that may be template: all outside the article, containers only inside."""
    found: set[int] = set()
    marked = _has_article(root)
    waiting = [(root, False)]
    while waiting:
        element, inside = waiting.pop()
        for part in element.parts:
            if isinstance(part, str):
                continue
            within = inside or part.article
            if part.tag not in _RUNNING or not (within or not marked):
                found.add(part.hash)
            if not part.dropped:
                waiting.append((part, within))
    return found


@dataclass
class _Blocks:
    """The main text's blocks, each with the innermost subtree around it that may be template, and of those subtrees the
    hash and the next one outwards (-1: none)."""

    texts: list[tuple[str, int]] = field(default_factory=list)
    hashes: list[int] = field(default_factory=list)
    outer: list[int] = field(default_factory=list)

    def without(self, template: set[int]) -> list[str]:
        gone = [False] * (len(self.hashes) + 1)  # the last stands for -1
        for i, (own, outer) in enumerate(zip(self.hashes, self.outer)):
            gone[i] = gone[outer] or own in template
        return [text for text, around in self.texts if not gone[around]]


def blocks(root: _Element) -> _Blocks:
    marked = _has_article(root)
    found = _Blocks()
    waiting: list[tuple[_Element | str, bool, int]] = [(root, False, -1)]
    while waiting:
        part, inside, around = waiting.pop()
        if isinstance(part, str):
            if inside or not marked:
                found.texts.append((part, around))
            continue
        if part is not root:
            if part.dropped:
                continue
            inside = inside or part.article
            if part.tag not in _RUNNING and (inside or not marked):
                found.hashes.append(part.hash)
                found.outer.append(around)
                around = len(found.hashes) - 1
        waiting.extend((p, inside, around) for p in reversed(part.parts))
    return found


def _host_of(url: str | None) -> str:
    found = re.match(r"\s*(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", url or "")
    return found.group(1).lower() if found else ""


def _counted(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``(host, hash, page)`` once per page, and a null hash per page to count the pages. Equal pages have one name."""
    for batch in rows:
        hosts, hashes, names = [], [], []
        for url, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            root = parse(page)
            own = [None, *candidates(root)]
            hosts += [_host_of(url)] * len(own)
            hashes += own
            names += [root.hash] * len(own)
        yield pa.RecordBatch.from_arrays(
            [pa.array(hosts, pa.string()), pa.array(hashes, pa.int64()), pa.array(names, pa.int64())], names=["host", "hash", "page"]
        )


def host_templates(pages: DataFrame) -> DataFrame:
    """``(host, hash)`` of the subtrees that recur on a host. Copies of a page are one page, so that they do not delete each other."""
    ready(pages.sparkSession)
    different = pages.select("url", "html").mapInArrow(_counted, "host string, hash long, page long").distinct()
    counts = different.groupBy("host", "hash").agg(F.count("*").alias("n")).filter(F.col("hash").isNull() | (F.col("n") >= LEAST_PAGES))
    counts = materialise(counts, "subtree-counts")
    total = counts.filter("hash IS NULL").select("host", F.col("n").alias("pages"))
    often = counts.filter("hash IS NOT NULL").join(total, "host")
    return often.filter(F.col("n") >= F.least(LEAST_SHARE * F.col("pages"), F.log2("pages"))).select("host", "hash")


_BLOCK_ROW = "row long, host string, hash long, page_id long, url string, blocks binary"
_BLOCK_ARROW = pa.schema(
    [("row", pa.int64()), ("host", pa.string()), ("hash", pa.int64()), ("page_id", pa.int64()), ("url", pa.string()), ("blocks", pa.binary())]
)


def _packed_blocks(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each page a row with its blocks, whose hash is no subtree's (negative), and one for each subtree that may be template."""
    pack, row = zstandard.ZstdCompressor(level=3), TaskContext.get().partitionId() << 32
    for batch in rows:
        made: list[tuple] = []
        for name, url, page in zip(*(batch.column(i).to_pylist() for i in range(3))):
            own, host = blocks(parse(page)), _host_of(url)
            made.append((row, host, -1 - row, name, url, pack.compress(pickle.dumps((own.texts, own.hashes, own.outer)))))
            made += [(row, host, x, None, None, None) for x in set(own.hashes)]
            row += 1
        yield from batches(iter(made), _BLOCK_ARROW, 20_000)


_TEXT = "page_id long, url string, text string, n_chars long, n_removed long"


def _cleaned(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    unpack = zstandard.ZstdDecompressor()
    for batch in rows:
        texts, removed = [], []
        for data, template in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
            own = _Blocks(*pickle.loads(unpack.decompress(data)))
            kept = own.without(set(template))
            texts.append(" ".join(kept))
            removed.append(len(own.texts) - len(kept))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64()), pa.array(removed, pa.int64())],
            names=["page_id", "url", "text", "n_chars", "n_removed"],
        )


def extract_main_text(pages: DataFrame) -> DataFrame:
    """``(page_id, url, text, n_chars, n_removed)``, one row per row of ``pages`` (page_id, url, html).

    Null or empty html gives an empty text; a url without host counts as the host ``''``. Repeated rows give repeated
    rows; an empty table gives none; further columns are left out. ``n_removed`` counts the blocks deleted as template.
    """
    ready(pages.sparkSession)
    own = pages.select("page_id", "url", "html").mapInArrow(_packed_blocks, _BLOCK_ROW)
    met = own.join(host_templates(pages).withColumn("template", F.lit(True)), ["host", "hash"], "left").filter("template OR blocks IS NOT NULL")
    # A page's list is of its own subtrees only.
    whole = met.groupBy("row").agg(
        *(F.first(c, ignorenulls=True).alias(c) for c in ("page_id", "url", "blocks")), F.collect_list(F.when(F.col("template"), F.col("hash"))).alias("template")
    )
    return whole.select("page_id", "url", "blocks", "template").mapInArrow(_cleaned, _TEXT)
