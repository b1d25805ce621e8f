"""Main text of web pages by site style trees.

The DOMs of a host's pages are merged into one tree of element paths; a step is an element's label and its place among equal
siblings. The texts of a block element are a leaf. A leaf is unimportant if its pages give it few different layouts
(entropy of its child sequences) and its texts repeat from page to page (entropy of its contents); unimportant leaves are
cut from every page of the host. Pages of equal text count once.

Names settle what that leaves open: texts that differ from page to page are adverts or articles alike, so a branch named as a menu,
advert or form is cut, unless it holds most of what the host's pages do not repeat. Names of content only raise
the number of pages it takes to cut a leaf.
"""

from __future__ import annotations

import html as html_lib
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loanvane.llm.shared import stage

DAMPING = 0.9
LEAST_IMPORTANCE = 0.25
PRIOR_PAGES = 0.75  # pages that count as important before any is seen
CONTENT_PAGES = 3.0  # the same below a name of content
NAME_PAGES = 5.0  # pages that stand for a name of noise
MOST = 0.5
EDGE = 3  # equal siblings told apart at either end
MAX_DEPTH = 64
LENGTH_BITS = 20
BROADCAST_ROWS = 500_000

# Fixed names of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe svg math object canvas audio video select".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split()
)
CLOSES_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split()
)
SIBLINGS = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"},
    "tbody": {"tbody", "thead", "tr", "td", "th"}, "tfoot": {"tbody", "thead", "tr", "td", "th"},
}
UNPLACED = INLINE | frozenset("h1 h2 h3 h4 h5 h6 li dt dd tr option html body head".split())  # items of lists, and headings, are alike at any place
SCOPES = frozenset("table ul ol dl article section div body html main aside nav".split())

# Roles by element name, and by the words of class, id and role.
NOISE_TAGS = frozenset("head nav footer aside form button dialog menu fieldset".split())
CONTENT_TAGS = frozenset("article main".split())
NOISE_WORDS = frozenset(
    "nav navbar navigation menu menubar header masthead footer foot sidebar ad ads adbox advert adverts advertisement advertising banner cookie cookies consent notice notices "
    "notification alert popup modal overlay comment comments respond disqus share sharing social related recommended breadcrumb breadcrumbs promo sponsor sponsored "
    "newsletter subscribe subscription login signup search pagination pager toolbar widget widgets copyright legal contentinfo complementary dialog".split()
)
CONTENT_WORDS = frozenset("article content post entry story main".split())

_TAG = re.compile(r"<(?:(!--)|(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*+)>|[!?/][^>]*>?)", re.S)
_LOOSE = re.compile(r"</?([a-zA-Z][^\s/>]*)([^>]*)>")
_NAMED = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")


def host_of(url: str | None) -> str:
    match = re.match(r"\s*(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", url or "")
    return match[1].lower() if match else ""


class Element:
    __slots__ = ("tag", "label", "words", "parent", "children", "counts", "place", "block", "depth", "path", "leaf", "named", "content", "noise", "low")

    def __init__(self, tag: str, names: str, parent: Element | None):
        self.tag, self.parent = tag, parent
        self.label = f"{tag}.{names}" if names else tag
        self.words = {w.lower() for w in _WORDS.findall(names)} if names and tag not in ("html", "body") else ()
        self.children, self.counts = [], {}
        self.block = tag not in INLINE
        self.place = 0
        if parent is not None and tag not in UNPLACED:
            self.place = parent.counts.get(self.label, 0)
            parent.counts[self.label] = self.place + 1

    def settle(self, low: frozenset, kept: frozenset) -> None:
        """Path and roles, once the parent has its own and all siblings are known."""
        up = self.parent
        self.depth = min(up.depth + 1, MAX_DEPTH) if up else 0
        if up and up.depth == MAX_DEPTH:  # deeper nesting counts as its ancestor's
            self.path = up.path
        else:
            place, last = self.place, (up.counts.get(self.label, 0) if up else 0) - self.place
            place = place if place < EDGE else -last if 0 < last <= EDGE else "+"
            self.path = xxhash.xxh64_intdigest(f"{self.label}[{place}]", up.path if up else 0)
        self.leaf = self if self.block or up is None else up.leaf
        inside = up is not None and up.content
        self.named = self.tag in NOISE_TAGS or (self.tag == "header" and not inside) or not NOISE_WORDS.isdisjoint(self.words)
        self.content = inside or self.tag in CONTENT_TAGS or not CONTENT_WORDS.isdisjoint(self.words)
        self.noise = (up is not None and up.noise) or (self.named and self.path not in kept)
        self.low = self.leaf.path in low


def walk_page(page: str, low: frozenset = frozenset(), kept: frozenset = frozenset()) -> tuple[list[Element], list[tuple[str, Element]]]:
    """Elements of a page in order, and its text pieces with the element each stands in; block ends are pieces of a blank."""
    root = Element("#page", "", None)
    stack, elements, pieces = [root], [root], []
    at, size = 0, len(page)
    lower = None

    def text(a: int, b: int) -> None:
        piece = page[a:b]
        if piece:
            piece = html_lib.unescape(piece) if "&" in piece else piece
            pieces.append((piece, stack[-1]))

    def close(index: int) -> None:
        if any(e.block for e in stack[index:]):
            pieces.append((" ", stack[index - 1]))
        del stack[index:]

    while at < size:
        start = page.find("<", at)
        if start < 0:
            text(at, size)
            break
        match = _TAG.match(page, start) or _LOOSE.match(page, start)
        if match is None:  # a bare sign, or a tag that never ends
            if start + 1 < size and (page[start + 1].isalpha() or page[start + 1] == "/") and ">" not in page[start:]:
                text(at, start)
                break
            text(at, start + 1)
            at = start + 1
            continue
        text(at, start)
        at = match.end()
        if match.re is _TAG:
            if match[1]:
                end = page.find("-->", match.end(1))
                at = size if end < 0 else end + 3
                continue
            ending, tag, attributes = match[2], match[3], match[4]
        else:
            ending, tag, attributes = page[start + 1] == "/", match[1], match[2]
        if tag is None:
            continue
        tag = tag.lower()
        if ending:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    close(i)
                    break
            continue
        if tag in RAW:
            if not attributes.endswith("/"):
                lower = lower or page.lower()
                end = lower.find(f"</{tag}", at)
                end = size if end < 0 else end
                after = page.find(">", end)
                at = size if after < 0 else after + 1
            pieces.append((" ", stack[-1]))
            continue
        if tag in VOID:
            stack[-1].children.append(tag)
            if tag in ("br", "hr"):
                pieces.append((" ", stack[-1]))
            continue
        if tag in ("html", "body") and any(e.tag == tag for e in stack):
            continue
        ends = {"p"} if tag in CLOSES_P else SIBLINGS.get(tag, ())
        for i in range(len(stack) - 1, 0, -1) if ends else ():
            if stack[i].tag in ends:
                close(i)
                break
            if stack[i].tag in SCOPES:
                break
        if tag == "body" and len(stack) > 1 and stack[-1].tag == "head":
            close(len(stack) - 1)
        names = " ".join(a or b or c for _, a, b, c in _NAMED.findall(attributes)) if "=" in attributes else ""
        stack[-1].children.append(tag)
        element = Element(tag, names, stack[-1])
        if element.block:
            pieces.append((" ", stack[-1]))
        stack.append(element)
        elements.append(element)
    for element in elements:
        element.settle(low, kept)
    return elements, pieces


def main_text(page: str | None, low: frozenset = frozenset(), kept: frozenset = frozenset()) -> str:
    """Text of a page less its leaves in ``low``, and less branches that are named noise and not in ``kept``."""
    if not page:
        return ""
    pieces = walk_page(page, low, kept)[1]
    return " ".join("".join(" " if e.low or e.noise else t for t, e in pieces).split())


def _signed(value: int) -> int:
    return value - (1 << 64) if value >= 1 << 63 else value


def _page_leaves(page: str) -> tuple[int, list[int]]:
    """Hash of a page's text, and its leaves packed: ``path, content, layout, n, n named branches around, n, n texts``."""
    leaves: dict[int, list] = {}
    elements, pieces = walk_page(page)
    own: dict[int, list] = {}
    for piece, e in pieces:
        if not piece.isspace():
            own.setdefault(id(e.leaf), [e.leaf, []])[1].append(piece)
    for e, texts in own.values():
        node = leaves.get(e.path)
        if node is None:
            around, up = [], e
            while up is not None:
                if up.named and up.path not in around:
                    around.append(up.path)
                up = up.parent
            layout = " ".join(c for i, c in enumerate(e.children) if not i or e.children[i - 1] != c)
            node = leaves[e.path] = [e.content, xxhash.xxh64_intdigest(layout), around, set()]
        text = " ".join(" ".join(texts).split())
        node[3].add(xxhash.xxh64_intdigest(text) >> LENGTH_BITS << LENGTH_BITS | min(len(text), (1 << LENGTH_BITS) - 1))
    packed = []
    for path, (content, layout, around, texts) in sorted(leaves.items()):
        packed += [path, int(content), layout, len(around), *around, len(texts), *sorted(texts)]
    text = " ".join("".join(t for t, _ in pieces).split())
    return _signed(xxhash.xxh64_intdigest(text)), [_signed(x) for x in packed]


def style_leaves(pages: DataFrame) -> DataFrame:
    """One row per distinct page text of a host and leaf: ``(host, path, content, layout, around, texts)``, a text's low bits its length."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [_page_leaves(page.as_py() or "") for page in batch.column(1)]
            hosts = [host_of(url.as_py()) for url in batch.column(0)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(hosts, pa.string()), pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.list_(pa.int64()))], ["host", "page", "leaves"]
            )

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for host, packed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                at = 0
                while at < len(packed):
                    path, content, layout, n = packed[at : at + 4]
                    around, at = packed[at + 4 : at + 4 + n], at + 4 + n
                    n = packed[at]
                    rows.append((host, path, content, layout, around, packed[at + 1 : at + 1 + n]))
                    at += 1 + n
            columns = zip(*rows, strict=True) if rows else [[]] * 6
            types = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()))
            names = ["host", "path", "content", "layout", "around", "texts"]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types, strict=True)], names)

    packed = pages.select("url", "html").mapInArrow(pack, "host string, page long, leaves array<long>")
    distinct = stage(packed.groupBy("host", "page").agg(F.min("leaves").alias("leaves")), "site-leaves")
    return distinct.select("host", "leaves").mapInArrow(unpack, "host string, path long, content long, layout long, around array<long>, texts array<long>")


def leaf_importance(leaves: DataFrame, damping: float = DAMPING) -> DataFrame:
    """``(host, path, around, pages, importance, novel)`` of every leaf.

    Layout part: entropy of the leaf's child sequences to the base of its pages. Content part: one less the mean, over its
    distinct texts, of the share that their repetition makes of the largest possible. The more layouts a leaf has, the
    less its content part counts. Few pages leave the importance near one. ``novel`` is the length of its texts, each less its repetition.
    """
    layouts = leaves.groupBy("host", "path", "layout").agg(F.count("*").alias("c"), F.max("content").alias("content"), F.min("around").alias("around"))
    style = layouts.groupBy("host", "path").agg(
        F.sum("c").alias("pages"), F.count("*").alias("kinds"), F.sum(F.col("c") * F.log("c")).alias("clogc"), F.max("content").alias("content"), F.min("around").alias("around")
    )
    texts = leaves.select("host", "path", F.explode("texts").alias("text")).groupBy("host", "path", "text").agg(F.count("*").alias("c"))
    length = F.col("text").bitwiseAND(F.lit((1 << LENGTH_BITS) - 1))
    repeats = texts.groupBy("host", "path").agg(
        F.sum(F.log("c")).alias("logs"), F.count("*").alias("texts"), F.sum(length).alias("length"), F.sum(length * F.log("c")).alias("length_logs")
    )
    m = F.col("pages")
    share = F.when(m > 1, (F.log(m) - F.col("clogc") / m) / F.log(m)).otherwise(1.0)
    by_text = F.when(m > 1, 1 - F.col("logs") / F.col("texts") / F.log(m)).otherwise(1.0)
    novel = F.when(m > 1, F.col("length") - F.col("length_logs") / F.log(m)).otherwise(F.col("length"))
    weight = F.pow(F.lit(damping), F.col("kinds"))
    prior = F.when(F.col("content") > 0, CONTENT_PAGES).otherwise(PRIOR_PAGES)
    importance = (m * ((1 - weight) * share + weight * by_text) + prior) / (m + prior)
    return repeats.join(style, ["host", "path"]).select("host", "path", "around", "pages", importance.alias("importance"), novel.cast("double").alias("novel"))


def misnamed_branches(leaves: DataFrame) -> DataFrame:
    """``(host, path)`` of branches named noise that hold most of their host's novel text; the fewer pages, the more of it they need."""
    hosts = leaves.groupBy("host").agg(F.sum("novel").alias("whole"))
    named = leaves.select("host", F.explode("around").alias("path"), "novel", "pages")
    named = named.groupBy("host", "path").agg(F.sum("novel").alias("novel"), F.max("pages").alias("pages")).join(hosts, "host")
    return named.filter(F.col("novel") * F.col("pages") > MOST * F.col("whole") * (F.col("pages") + NAME_PAGES)).select("host", "path")


def extract_main_text(pages: DataFrame, least: float = LEAST_IMPORTANCE) -> DataFrame:
    """``(page_id, url, text, n_chars)`` of every row of ``pages`` (page_id, url, html).

    Null and empty html give an empty text; pages without a host (null url too) form one site.
    """
    leaves = stage(leaf_importance(style_leaves(pages)), "site-importance")
    low = leaves.filter(F.col("importance") < least).select("host", "path", F.lit(False).alias("kept"))
    found = stage(low.unionByName(misnamed_branches(leaves).withColumn("kept", F.lit(True))), "site-low")
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^\s*(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1))
    rows = pages.select("page_id", "url", "html", host.alias("host"))
    sites = found.groupBy("host").agg(F.collect_list(F.when(~F.col("kept"), F.col("path"))).alias("low"), F.collect_list(F.when(F.col("kept"), F.col("path"))).alias("kept"))
    sites = stage(sites, "site-low")
    sites = F.broadcast(sites) if found.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else sites
    rows = rows.join(sites, "host", "left")

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, sets = [], {}
            for page, host, low, kept in zip(*(batch.column(i) for i in (2, 3, 4, 5)), strict=True):
                name = host.as_py()
                if name not in sets:
                    sets[name] = [frozenset(x & 0xFFFFFFFFFFFFFFFF for x in found.as_py() or ()) for found in (low, kept)]
                texts.append(main_text(page.as_py(), *sets[name]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    found = rows.select("page_id", "url", "html", "host", "low", "kept").mapInArrow(extract, "page_id long, url string, text string")
    return found.withColumn("n_chars", F.length("text").cast("long"))
