"""Main-text extraction with a site style tree.

Pages of one host are merged: blocks with the same path of tags and classes form one
style node. A node's importance follows the entropy of what it shows over the site's
pages. With m pages that have the node and a content shown on n of them, that content has
the entropy log_m(n): 0 if it is one page's own, 1 if every page shows it. A leaf's
content importance is one minus the mean entropy of its contents; a branch's is the mean
of its leaves, raised by the entropy of its presentations (the sequences of child nodes
that it has over the pages). All blocks with text stand in the tree, those of articles, menus and
adverts alike. Pages with the same longest block are copies of one another and
count once, so an article that a site shows many times is not taken for its frame.

A branch that `LEAST_PAGES` distinct pages have goes from each page of its host if its importance stays
below `LEAST_IMPORTANCE`, or, within an article or main part, below `LEAST_WITHIN`; headings there stay
with their text. Branches are judged down to `DEPTH` levels; blocks deeper than that by themselves.

Entropy says nothing on a host with few pages and little where each page has another advert, so what an element's
tag, role or class states is a prior that outweighs any importance: menus, headers, footers, sidebars, notices,
adverts, forms, reader comments. Class names count as whole words or known compounds, and the vaguer ones not on what holds an
article or main part. (Scripts, styles, the head and hidden elements are no content at all.) Of what is left,
the main part is the text if the page marks one, or else its articles if they hold at least half of the text left, or else all.

Only counts by (host, node, content) are shuffled, combined map-side, so a host with a
third of all pages is no single task. Null or empty html and pages without main text give
an empty text; rows are independent, so repeated pages give equal rows; columns other than page_id, url
and html are not looked at. Texts of any length and any depth of tags take time in proportion. An empty table gives an empty result. Broken markup is
read as browsers do: implied end tags, an unfinished tag at the end is dropped.
"""

from __future__ import annotations

import html as entities
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecspark.llm.common import Scratch, read, small_side

LEAST_PAGES = 5
LEAST_IMPORTANCE = 0.55
LEAST_WITHIN = 0.15
DEPTH = 64
#: Rows (host, branch) that may be broadcast.
BRANCH_ROWS = 200_000

_TOKEN = re.compile(
    r"<!--.*?(?:--!?>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"'=]|=\s*\"[^\"]*\"|=\s*'[^']*'|[\"'=])*?)(>|\Z)",
    re.S,
)
_RAW = {"script", "style", "textarea", "title", "iframe", "noembed", "noframes", "xmp", "template"}
_END = {tag: re.compile(rf"</{tag}(?=[\s/>]|\Z)", re.I) for tag in _RAW}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_BLOCK = {
    "address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset", "figcaption", "figure",
    "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "hgroup", "hr", "html", "li", "main", "menu", "nav", "ol", "optgroup", "option", "p", "pre",
    "section", "select", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul",
}
_GONE = {"head", "noscript", "button", "select", "svg", "math", "object", "canvas", "audio", "video", "datalist", *_RAW}
_NOISE_TAGS = {"nav", "footer", "aside", "form", "dialog", "menu"}
_HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
_SIBLING = {  # an opening tag closes an open element of the second set, unless one of the third stands between
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"table", "tr"}),
    "th": ({"td", "th"}, {"table", "tr"}), "option": ({"option"}, {"select"}),
}
#: Words of a class or id that state noise, wherever they stand in it.
_NOISE_WORDS = set(
    "ad ads advert adverts advertisement advertisements advertising adsense sponsor sponsored sponsors nav navbar navigation menu menus breadcrumb breadcrumbs sidebar footer masthead "
    "comment comments commentlist disqus reply replies respond share sharing related recommended recommendation recommendations copyright skiplink pagination pager".split()
)
#: The same, but not for an element that holds an article or main part.
_VAGUE_WORDS = set(
    "promo promos promotion promotions banner banners cookie cookies consent gdpr notice notices alert alerts disclaimer newsletter subscribe subscription "
    "signup login popup modal overlay toolbar widget widgets".split()
)
#: Words that state noise alone or beside a word of the second set only.
_SHORT_WORDS = set("header form forms search social aside".split())
_BESIDE = set("site page main top global bar box links link icons icon buttons button media global-header field input contact inner wrapper container left right".split())
#: Words that turn a class into a statement about something else.
_ABOUT = set("has no with without is not hide show long".split())
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+")
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "alert", "dialog", "menu", "menubar", "toolbar", "alertdialog"}
_MASK = (1 << 63) - 1


#: The host of a url; read alike by Python and by Spark.
HOST = r"^\s*(?:[a-zA-Z][a-zA-Z0-9_+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)"


def host(url: str | None) -> str:
    m = re.match(HOST, url or "", re.A)
    return m[1].lower() if m else ""


@lru_cache(maxsize=4096)
def names_noise(label: str) -> int:
    """What a class and id say: 2 noise, 1 noise unless it holds an article or main part, 0 nothing."""
    found = 0
    for token in label.split():
        parts = [p.lower() for p in _PARTS.findall(token)]
        words = {*parts, *(a + b for a, b in zip(parts, parts[1:], strict=False))}  # side-bar, sign-up
        if not parts or words & _ABOUT:
            continue
        if words & _NOISE_WORDS:
            return 2
        if words & _VAGUE_WORDS or (words & _SHORT_WORDS and all(p in _SHORT_WORDS or p in _BESIDE for p in parts)):
            found = 1
    return found


class Block(NamedTuple):
    node: int
    text: str
    chain: tuple  # (node, chain above), () at the top
    kind: int  # 2 stands in an article, 1 in the main part
    noise: int  # number of the innermost element above that states noise, 0 for none
    heading: bool


class _Element(NamedTuple):
    tag: str
    node: int
    chain: tuple
    gone: bool
    kind: int
    noise: int
    heading: bool


class Page:
    """The blocks of one page, and for each of its elements that states noise whether it does go."""

    def __init__(self, source: str | None):
        self.blocks: list[Block] = []
        self.children: dict[int, int] = {}  # node -> hash of the sequence of child nodes
        self.noise: list[tuple[int, int]] = [(0, 0)]  # by number: strength (0: none, or taken back), number above
        self._text: list[str] = []
        self._stack = [_Element("", 0, (), False, 0, 0, False)]
        self._at: dict[str, list[int]] = {}  # tag -> places on the stack
        self._parse(source or "")
        self.dropped = [False]
        for strength, above in self.noise[1:]:
            self.dropped.append(strength > 0 or self.dropped[above])

    def _flush(self) -> None:
        if self._text:
            text = " ".join(entities.unescape("".join(self._text)).split())
            self._text = []
            if text:
                e = self._stack[-1]
                self.blocks.append(Block(e.node, text, e.chain, e.kind, e.noise, e.heading))

    def _last(self, tags) -> int:
        return max((at[-1] for t in tags if (at := self._at.get(t))), default=0)

    def _pop(self, to: int) -> None:
        if any(x.tag in _BLOCK for x in self._stack[to:]):
            self._flush()
        while len(self._stack) > to:
            self._at[self._stack.pop().tag].pop()

    def _states(self, tag: str, attributes: str) -> tuple[str, bool, int, int]:
        """(class and id, gone, kind, strength of noise) that an opening tag states."""
        label, gone, noise = "", tag in _GONE, 2 if tag in _NOISE_TAGS else 0
        kind = 2 if tag == "article" else 1 if tag == "main" else 0
        if attributes and not attributes.isspace():
            for m in _ATTRIBUTE.finditer(attributes):
                name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
                if name in ("class", "id"):
                    label += f" {value}"
                elif name == "role":
                    noise = 2 if value.lower() in _ROLES else noise
                    kind = max(kind, 1 if value.lower() == "main" else 2 if value.lower() == "article" else 0)
                elif name == "hidden" or name == "style" and re.search(r"display\s*:\s*none", value, re.I):
                    gone = True
        if label and tag not in ("html", "body"):
            named = names_noise(label)
            noise = max(noise, 0 if kind and named == 1 else named)
        return label, gone, kind, noise

    def _open(self, tag: str, attributes: str) -> None:
        if tag in _BLOCK:
            self._flush()
            p = self._last(("p",))
            if p > self._last(("td", "th", "table", "button", "object", "caption")):
                self._pop(p)
        if tag in _SIBLING:
            same, stop = _SIBLING[tag]
            at = self._last(same)
            if at > self._last(stop):
                self._pop(at)
        top = self._stack[-1]
        label, gone, kind, noise = self._states(tag, attributes)
        if tag == "header" and not top.kind:
            noise = max(noise, 1)
        node, chain = top.node, top.chain
        if tag in _BLOCK:  # inline markup does not make nodes
            node = (top.node * 1000003 + zlib.crc32(f"{tag}{label}".encode())) & _MASK
            chain = (node, top.chain)
            self.children[top.node] = (self.children.get(top.node, 7) * 31 + node) & _MASK
        number = top.noise
        if noise:
            self.noise.append((noise, number))
            number = len(self.noise) - 1
        elif kind:  # what holds an article is no vague noise
            at = number
            while at and self.noise[at][0] == 1:
                self.noise[at] = (0, self.noise[at][1])
                at = self.noise[at][1]
        if tag not in _VOID:
            self._at.setdefault(tag, []).append(len(self._stack))
            self._stack.append(_Element(tag, node, chain, gone or top.gone, max(kind, top.kind), number, tag in _HEADINGS or top.heading))

    def _close(self, tag: str) -> None:
        at = self._last((tag,))
        if at or tag in _BLOCK:
            if tag in _BLOCK:
                self._flush()
            if at:
                self._pop(at)

    def _parse(self, s: str) -> None:
        at, size = 0, len(s)
        find = _TOKEN.search
        while at < size:
            m = find(s, at)
            stop = m.start() if m else size
            if stop > at and not self._stack[-1].gone:
                self._text.append(s[at:stop])
            if m is None:
                break
            at = m.end()
            tag = m[2]
            if tag is None:
                continue
            if not m[4]:  # the page ends inside this tag
                break
            tag = tag.lower()
            if m[1]:
                self._close(tag)
            elif tag == "br":
                if not self._stack[-1].gone:
                    self._text.append(" ")
            else:
                self._open(tag, m[3])
                if tag in _RAW:
                    end = _END[tag].search(s, at)
                    at = end.start() if end else size
        self._flush()

    def copies(self) -> int:
        """A hash of the longest block: pages that share it count once."""
        return _content(max(self.blocks, key=lambda b: len(b.text)).text) if self.blocks else 0

    def main(self, low: frozenset[int] = frozenset(), names: bool = True) -> str:
        """The main text without the style nodes in low; names: whether what elements state counts."""
        cut: dict[int, bool] = {0: False}

        def is_low(chain: tuple) -> bool:
            new = []
            while chain and chain[0] not in cut:
                new.append(chain[0])
                chain = chain[1]
            out = bool(chain) and cut[chain[0]]
            for node in reversed(new):
                cut[node] = out = out or node in low
            return out

        left = [b for b in self.blocks if not (names and self.dropped[b.noise]) and not (low and is_low(b.chain))]
        if not names:
            return "\n".join(b.text for b in left)
        size = [sum(len(b.text) for b in left if b.kind == k) for k in range(3)]
        if size[1]:
            left = [b for b in left if b.kind] if 2 * (size[1] + size[2]) >= sum(size) else left
        elif size[2] and 2 * size[2] >= sum(size):
            left = [b for b in left if b.kind == 2]
        return "\n".join(b.text for b in left)


def _content(text: str) -> int:
    return 1 + (zlib.crc32(text.encode("utf-8", "surrogatepass")) << 20 ^ len(text))


def extract(source: str | None, low: frozenset[int] = frozenset(), names: bool = True) -> str:
    """The main text of one page; low: style nodes to leave out."""
    return Page(source).main(low, names)


_CHAIN, _HAS = -1, 0


def style_nodes(pages: DataFrame) -> DataFrame:
    """(host, node, sort, content, copies, chain): what a page shows in a node, once a page.

    sort 2 is a content, 1 a sequence of child nodes, 0 the page itself, -1 the node's chain of branches from
    the top, the same on all pages, with content as twice the kind of its blocks, plus one for headings.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            for url, source in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                page, own = Page(source), host(url)
                copies = page.copies()
                seen = {x.node: x for x in page.blocks}
                branches = set()
                for node, x in seen.items():
                    chain, links = [], x.chain
                    while links:
                        chain.append(links[0])
                        links = links[1]
                    chain = chain[::-1][:DEPTH]
                    branches.update(chain)
                    out.append((own, node, _CHAIN, x.kind * 2 + x.heading, 0, chain))
                    out.append((own, node, _HAS, 0, copies, None))
                out += [(own, node, 2, content, copies, None) for node, content in {(x.node, _content(x.text)) for x in page.blocks}]
                out += [(own, node, 1, page.children[node], copies, None) for node in branches if node in page.children]
            if out:
                kinds = (pa.string(), pa.int64(), pa.int8(), pa.int64(), pa.int64(), pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=["host", "node", "sort", "content", "copies", "chain"])

    return pages.select("url", "html").mapInArrow(run, "host string, node long, sort byte, content long, copies long, chain array<long>")


def importances(scratch: Scratch, pages: DataFrame) -> DataFrame:
    """(host, branch, m, importance, within, heading, above) of every branch of every host's style tree."""
    shown = style_nodes(pages).groupBy("host", "node", "sort", "content", "copies").agg(F.max("chain").alias("chain"))
    counts = scratch.put(shown.groupBy("host", "node", "sort", "content").agg(F.count("*").alias("n"), F.max("chain").alias("chain")), "nodes")
    n = F.col("n").cast("double")
    leaf = counts.where("sort <> 1").groupBy("host", "node").agg(
        F.max(F.when(F.col("sort") == 0, F.col("n"))).alias("m"),
        F.sum(F.when(F.col("sort") == 2, F.log(n))).alias("entropy"),
        F.count(F.when(F.col("sort") == 2, 1)).alias("contents"),
        F.max("chain").alias("chain"),
        F.max(F.when(F.col("sort") == -1, F.col("content"))).alias("states"),
    )
    leaf = leaf.withColumn("importance", F.when(F.col("m") > 1, 1 - F.col("entropy") / F.col("contents") / F.log(F.col("m").cast("double"))).otherwise(F.lit(1.0)))
    leaf = leaf.withColumn("chain", F.when(F.array_contains("chain", F.col("node")), F.col("chain")).otherwise(F.concat("chain", F.array("node"))))
    branch = (
        leaf.select("host", "node", "m", "contents", "importance", "states", F.posexplode("chain").alias("depth", "branch"), "chain")
        .groupBy("host", "branch")
        .agg(
            F.max("m").alias("m"),
            (F.sum(F.col("importance") * F.col("contents")) / F.sum("contents")).alias("content"),
            F.min(F.slice("chain", F.lit(1), F.col("depth"))).alias("above"),
            F.max(F.col("states") >= 2).alias("within"),
            F.min(F.col("states") % 2 == 1).alias("heading"),
        )
    )
    shape = counts.where("sort = 1").groupBy("host", F.col("node").alias("branch")).agg(F.sum("n").alias("pages"), F.sum(n * F.log(n)).alias("nlogn"))
    presentation = F.when(F.col("pages") > 1, 1 - F.col("nlogn") / F.col("pages") / F.log(F.col("pages").cast("double"))).otherwise(F.lit(0.0))
    # the presentations' entropy counts by a tenth, as the contents beneath say more
    importance = 0.9 * F.col("content") + 0.1 * F.coalesce(presentation, F.lit(0.0))
    return branch.join(shape, ["host", "branch"], "left").select("host", "branch", "m", importance.alias("importance"), "within", "heading", "above")


def low_branches(scratch: Scratch, pages: DataFrame, least_pages: int = LEAST_PAGES, least: float = LEAST_IMPORTANCE, within: float = LEAST_WITHIN) -> DataFrame:
    """(host, low): the topmost style nodes of a host whose importance is low. The page itself never is."""
    bound = F.when(F.col("within") & F.col("heading"), F.lit(-1.0)).when(F.col("within"), F.lit(within)).otherwise(F.lit(least))
    low = scratch.put(importances(scratch, pages).where((F.col("m") >= least_pages) & (F.col("importance") < bound) & (F.size("above") > 0)).select("host", "branch", "above"), "low")
    covered = low.select("host", "branch", F.explode("above").alias("up")).join(low.select("host", F.col("branch").alias("up")), ["host", "up"], "left_semi").select("host", "branch")
    top = low.select("host", "branch").join(covered, ["host", "branch"], "left_anti")
    return scratch.put(top.groupBy("host").agg(F.array_sort(F.collect_set("branch")).alias("low")), "top")


def main_texts(spark: SparkSession, pages: DataFrame, tree: bool = True, names: bool = True) -> DataFrame:
    """(page_id, url, text, n_chars) of every row of pages; tree and names: what may take blocks away."""
    scratch = Scratch(spark)
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    low = low_branches(scratch, pages) if tree else None
    hosts, rows = low.agg(F.count("*"), F.coalesce(F.sum(F.size("low")), F.lit(0))).first() if tree else (0, 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets: dict[tuple, frozenset[int]] = {}
        for b in batches:
            out = []
            for source, nodes in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                key = tuple(nodes or ())
                if key not in sets:
                    if len(sets) > 1000:
                        sets.clear()
                    sets[key] = frozenset(key)
                out.append(extract(source, sets[key], names))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.string()), pa.array([len(t) for t in out], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    if hosts:
        # the same host that host() reads from a url
        own = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), HOST, 1))
        pages = pages.withColumn("host", own).join(small_side(low, rows + hosts, BRANCH_ROWS), "host", "left").select("page_id", "url", "html", "low")
    else:
        pages = pages.withColumn("low", F.lit(None).cast("array<long>"))
    return pages.mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op3_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_texts(spark, read(spark, sf_dir, "pages"))
