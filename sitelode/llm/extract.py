"""Main text of web pages: flat text blocks, told apart by a decision tree.

A page becomes a flat list of text blocks, cut at block-level tags. What describes a block is its words and
link density and those of the blocks before and after it, and a few marks of where it stands. A decision
tree, grown here by Gini impurity from a small table of labelled blocks (``LABELLED``), says which blocks are
the article's. Pages are independent rows: nothing is shuffled.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunks import by_bytes, utf8

#: Bytes of pages that a task has in parts at a time; a larger page is one part.
_CHUNK = 4 << 20

BLOCK_TAGS = frozenset("""address article aside blockquote body caption center dd details dialog dir div dl dt fieldset
figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option
p pre search section summary table tbody td tfoot th thead title tr ul""".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is no markup, up to their end tag.
RAW_TAGS = frozenset("script style textarea title xmp noscript noembed noframes iframe".split())
#: Elements of which nothing is text of the page.
SILENT_TAGS = frozenset("head template svg math object canvas audio video select button datalist".split())
#: Elements and roles around the article.
OUTER_TAGS = frozenset("nav footer aside form dialog menu search fieldset".split())
OUTER_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar toolbar".split())
#: Words in class and id that name what is no part of an article.
OUTER_NAMES = frozenset("""ad ads advert adverts advertisement adsense banner sponsor sponsored promo promotion promoted nav navbar
navigation menu breadcrumb breadcrumbs sidebar sidenav aside footer masthead topbar toolbar cookie cookies consent gdpr notice
alert notification popup modal overlay dialog comment comments commentlist disqus replies reply respond share sharing social
related recommended recommendations trending popular newsletter subscribe subscription signup login paywall widget pagination
pager tags taglist copyright legal disclaimer skip hidden""".split())
MAIN_NAMES = frozenset("article content post entry story main body text maincontent articlebody postcontent entrycontent".split())
#: A class such as ``has-sidebar`` tells of something else than its element.
_ABOUT_OTHERS = frozenset("has no with without".split())
#: What the tree looks at.
FEATURES = ("words", "link_density", "words_before", "link_density_before", "words_after", "link_density_after", "outer", "named", "inside", "heading", "has_inside")

_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>""")
_PLAIN_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)(?:>|\Z)")
_ATTRIBUTE = re.compile(r"""(?:^|[\s"'/])(class|id|role|hidden|aria-hidden)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]*)))?(?=[\s/"'>]|$)""", re.I)
_NAME_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_WORD = re.compile(r"\S+")
_HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))


@dataclass(slots=True)
class Block:
    text: str
    words: int
    linked: int  # of them inside links
    outer: bool
    named: bool
    inside: bool
    heading: bool


@dataclass(slots=True)
class _Page:
    """The state of a scan: open elements and the text of the block that is being read."""

    blocks: list[Block] = field(default_factory=list)
    parts: list[tuple[str, bool]] = field(default_factory=list)
    open: list[tuple[str, tuple[int, ...]]] = field(default_factory=list)
    counts: dict[str, int] = field(default_factory=dict)
    marks: list[int] = field(default_factory=lambda: [0] * 6)  # open elements: silent, outer, named, inside, link, heading

    def flush(self) -> None:
        if not self.parts:
            return
        words = linked = 0
        for text, link in self.parts:
            if link:
                linked += len(_WORD.findall(text))
        text = " ".join("".join(x for x, _ in self.parts).split())
        self.parts = []
        if text:
            words = text.count(" ") + 1
            m = self.marks
            self.blocks.append(Block(text, words, min(linked, words), m[1] > 0, m[2] > 0, m[3] > 0, m[5] > 0))

    def say(self, text: str) -> None:
        if text and not self.marks[0]:
            self.parts.append((html.unescape(text) if "&" in text else text, self.marks[4] > 0))

    def push(self, name: str, which: tuple[int, ...]) -> None:
        self.open.append((name, which))
        self.counts[name] = self.counts.get(name, 0) + 1
        for k in which:
            self.marks[k] += 1

    def pop_to(self, name: str) -> None:
        """Close the innermost element of that name and what is open inside it."""
        if not self.counts.get(name):
            return
        while True:
            last, which = self.open.pop()
            self.counts[last] -= 1
            for k in which:
                self.marks[k] -= 1
            if last == name:
                return


def _marks(name: str, attributes: str, inside: bool) -> tuple[int, ...]:
    """Which of the marks an element sets for all it holds."""
    out = []
    if name in SILENT_TAGS:
        out.append(0)
    outer = name in OUTER_TAGS or (name == "header" and not inside)
    main, named = name in ("article", "main"), False
    if attributes and ("=" in attributes or "hidden" in attributes):
        for key, *values in _ATTRIBUTE.findall(attributes):
            key, value = key.lower(), "".join(values)
            if key == "hidden" or (key == "aria-hidden" and value.lower() == "true"):
                out.append(0)
            elif key == "role":
                outer |= value.lower() in OUTER_ROLES
                main |= value.lower() in ("main", "article")
            elif name not in ("html", "body", "main", "article"):
                for one in value.split():
                    parts = {x.lower() for x in _NAME_PARTS.findall(one)}
                    if parts & _ABOUT_OTHERS:
                        continue
                    if parts & OUTER_NAMES or ("header" in parts and not inside and not parts & MAIN_NAMES):
                        named = True
                    elif parts & MAIN_NAMES and name in ("div", "section", "td"):
                        main = True
    out += [k for k, is_so in ((1, outer), (2, named), (3, main), (4, name == "a"), (5, name in _HEADINGS)) if is_so]
    return tuple(dict.fromkeys(out))


def blocks_of(page: str) -> list[Block]:
    """The text blocks of a page, in order.

    Comments, declarations and the content of scripts, styles and the like are skipped; an unclosed one
    reaches to the end of the page. A tag whose quotes do not close ends at the next ``>``, as do all after
    it. A ``<`` that opens no tag is text.
    """
    state, at, n, tag = _Page(), 0, len(page), _TAG
    while at < n:
        lt = page.find("<", at)
        if lt < 0:
            state.say(page[at:])
            break
        if lt > at:
            state.say(page[at:lt])
        if page.startswith("<!--", lt):
            end = page.find("-->", lt + 4)
            at = n if end < 0 else end + 3
            continue
        following = page[lt + 1 : lt + 2]
        if following in ("!", "?"):
            end = page.find(">", lt)
            at = n if end < 0 else end + 1
            continue
        m = tag.match(page, lt)
        if m is None and tag is _TAG and (following.isalpha() or following == "/"):
            m = _PLAIN_TAG.match(page, lt)
            if m is not None:
                tag = _PLAIN_TAG  # so that no further tag is scanned to the end of the page in vain
        if m is None:
            end = page.find(">", lt) if following == "/" else -1
            if end >= 0:  # an end tag without a name is a comment
                at = end + 1
            else:
                state.say("<")
                at = lt + 1
            continue
        at, name = m.end(), m[2].lower()
        block = name in BLOCK_TAGS
        if block:
            state.flush()
        elif name == "br":
            state.say(" ")
        if m[1]:
            state.pop_to(name)
            continue
        if name in VOID_TAGS:
            continue
        if name in RAW_TAGS:
            end = re.compile(rf"</{name}(?=[\s/>])[^>]*>?", re.I).search(page, at)
            at = n if end is None else end.end()
            continue
        if block:
            state.pop_to("p")  # a paragraph ends where a block begins, and so does a head
            state.pop_to("head")
        if name == "a" and any(x == "a" for x, _ in state.open[-4:]):
            state.pop_to("a")  # links do not nest; one left open further out is not looked for
        if name == "main":
            for outer in ("nav", "header", "footer", "aside"):  # these cannot hold it, so one left open has ended
                state.pop_to(outer)
        if not m[3].endswith("/") or name in ("p", "div", "a"):
            state.push(name, _marks(name, m[3], state.marks[3] > 0))
    state.flush()
    return state.blocks


def described(pages: list[list[Block]]) -> np.ndarray:
    """A row of FEATURES for each block of each page."""
    rows = []
    for blocks in pages:
        own = [(b.words, b.linked / b.words) for b in blocks]
        has = float(any(b.inside and not b.outer and not b.named for b in blocks))
        edge = (0, 0.0)
        for i, b in enumerate(blocks):
            rows.append((*own[i], *(own[i - 1] if i else edge), *(own[i + 1] if i + 1 < len(own) else edge), b.outer, b.named, b.inside, b.heading, has))
    return np.array(rows, np.float64).reshape(-1, len(FEATURES))


@dataclass(slots=True)
class Tree:
    """A binary decision tree as arrays: leaves have feature -1."""

    feature: np.ndarray
    bound: np.ndarray
    low: np.ndarray
    high: np.ndarray
    keeps: np.ndarray

    def __call__(self, x: np.ndarray) -> np.ndarray:
        at = np.zeros(len(x), np.int64)
        while True:
            f = self.feature[at]
            live = np.flatnonzero(f >= 0)
            if not len(live):
                return self.keeps[at]
            node = at[live]
            at[live] = np.where(x[live, f[live]] <= self.bound[node], self.low[node], self.high[node])


def grown(x: np.ndarray, y: np.ndarray, depth: int = 8, least: int = 2) -> Tree:
    """A tree by Gini impurity; ties go to the first feature and the smallest bound, so it is always the same."""
    nodes: list[list] = []

    def grow(rows: np.ndarray, left: int) -> int:
        me, share = len(nodes), float(y[rows].mean())
        nodes.append([-1, 0.0, 0, 0, share > 0.5])
        if left and 0 < share < 1:
            best = (2 * share * (1 - share) * len(rows) - 1e-9, -1, 0.0)
            for f in range(x.shape[1]):
                order = rows[np.argsort(x[rows, f], kind="stable")]
                v, ones = x[order, f], np.cumsum(y[order])
                n = np.arange(1, len(rows))
                a, b = ones[:-1], ones[-1] - ones[:-1]
                cost = 2 * a * (n - a) / n + 2 * b * (len(rows) - n - b) / (len(rows) - n)
                cost = np.where((v[1:] > v[:-1]) & (n >= least) & (n <= len(rows) - least), cost, np.inf)
                if len(cost) and cost.min() < best[0]:
                    k = int(cost.argmin())
                    best = (float(cost[k]), f, float(v[k] + v[k + 1]) / 2)
            _, f, bound = best
            if f >= 0:
                goes = x[rows, f] <= bound
                nodes[me][:4] = [f, bound, grow(rows[goes], left - 1), grow(rows[~goes], left - 1)]
        return me

    grow(np.arange(len(x)), depth)
    feature, bound, low, high, keeps = zip(*nodes)
    return Tree(np.array(feature), np.array(bound), np.array(low), np.array(high), np.array(keeps))


_S = "Short line."
_L = "A paragraph of some length that tells a part of the story, with a clause or two, and then comes to its end in a full stop."
_NAV = "<ul><li><a href=/1>Home</a></li><li><a href=/2>News</a></li><li><a href=/3>All about us</a></li></ul>"
_LINKS = "<p><a href=/4>Another story that you may like to read</a></p><p><a href=/5>One more story from last week</a></p>"
#: Labelled pages: (markup of a block or a few, are they the article's?). Their blocks are the table that the tree is grown from.
LABELLED: list[list[tuple[str, bool]]] = [
    # an article element amid the usual furniture
    [(f"<nav>{_NAV}</nav>", False), ("<div class=ad>Buy one, get one free, only this week.</div>", False), (f"<article><h1>Title of it</h1><p>{_L}</p><p>{_S}</p><p>One</p><p>{_L} {_L}</p></article>", True), (f"<footer>&copy; A name. {_L}</footer>", False)],
    [(f"<header><h1>Name of the site</h1><p>Its motto</p>{_NAV}</header>", False), (f"<main><h1>Title</h1><p>{_S}</p><p>{_L}</p><ul><li>First point</li><li>Second point that is longer</li></ul><h2>Part</h2><p>{_L}</p></main>", True), (f"<aside><h3>Also</h3>{_LINKS}<p>{_L}</p></aside>", False), ("<footer><p>All rights reserved</p><a href=/p>Privacy</a></footer>", False)],
    [(f"<div class=cookie-notice><p>We use cookies. {_L}</p></div>", False), (f"<article><header><h1>Title</h1></header><p><a href=/x>Linked words that are a whole paragraph</a></p><p>{_L}</p><table><tr><td>1</td><td>Two words</td></tr></table><blockquote>{_S}</blockquote></article>", True), (f"<section id=comments><h2>Comments</h2><div class=comment><p>{_L}</p><p>{_S}</p></div></section>", False)],
    [(f"<article><h1>Title</h1><p>{_L}</p>", True), (f"<div class=ad>{_S}</div><div class=sponsored><p>{_L}</p></div>", False), (f"<p>{_S}</p><p>{_L}</p>", True), (f"<div class='share social'>Share this</div><form><label>Mail</label><p>{_L}</p></form><div class=related>{_LINKS}</div></article>", False)],
    [(f"<div id=sidebar><p>{_L}</p><p>{_S}</p>{_LINKS}</div>", False), (f"<div id=content><h1>Title</h1><p>{_L}</p><p>One <a href=/y>link</a> in it</p><p>{_S}</p><p>{_L}</p></div>", True), (f"<form><p>{_L}</p><p>Name</p></form>", False), (f"<div role=contentinfo>{_S}</div>", False)],
    # no element that says where the article is
    [(f"<div class=menu>{_NAV}</div>", False), (f"<h1>Title of the story</h1><p>{_L}</p><p>{_S}</p><p>{_L} {_L}</p><p>{_L}</p>", True), (f"<div class=footer>{_S}</div>", False)],
    [(f"<div><a href=/1>Home</a> <a href=/2>News</a></div><div>{_NAV}</div>", False), (f"<h2>Title of the story</h2><p>{_L} {_L}</p><p>{_L}</p><p>{_L} <a href=/z>More</a></p>", True), (f"<div>{_NAV}</div><div>{_LINKS}</div>", False)],
    [(f"<nav>{_NAV}</nav>", False), (f"<p>{_L}</p><p>{_S}</p><p>{_L}</p>", True), (f"<nav><p>{_L}</p></nav><footer>{_L} {_L}</footer>", False)],
    [(f"<h1>Title</h1><p>{_S}</p><p>{_L}</p><p>{_S}</p><p>{_S}</p>", True), (f"<footer><p>{_S}</p><p>{_L}</p></footer>", False)],
    [(f"<nav>{_NAV}</nav><div class=advert>{_L}</div>", False), (f"<h1>Title</h1><div>{_L}</div><div>{_S}</div><p>{_L} {_L}</p><p>{_S}</p>", True), (f"<aside>{_L}</aside><div class=comments><p>{_L}</p><p>{_S}</p></div>", False)],
    [(f"<p>{_L}</p>", True)],
    [(f"<h1>Title</h1><p>{_S}</p>", True), (f"<div class=newsletter><p>{_L}</p></div><footer>{_S}</footer>", False)],
    [(f"<header><p>{_L}</p><p>{_S}</p></header><form><p>{_L}</p></form><aside><p>{_L}</p><p>{_S}</p></aside>", False), (f"<p>{_L}</p><p>Word</p><p>{_L}</p><ul><li>{_S}</li><li>{_S}</li></ul><p>{_L}</p>", True), (f"<div class=cookies><p>{_L}</p><p>{_S}</p></div>", False)],
    [(f"<div>{_NAV}</div>", False), (f"<p>{_S}</p><p>{_S}</p><p>{_L}</p><p>{_S}</p>", True), (f"<div>{_LINKS}</div>", False)],
    # what stands beside an article, in no named element
    [(f"<div>{_NAV}</div><p>{_S}</p>", False), (f"<article><p>{_S}</p><p>{_L}</p></article>", True), (f"<p>{_L}</p><div>{_S}</div><h3>More</h3><div>{_LINKS}</div>", False)],
    [(f"<p>{_L}</p><h2>Today</h2>", False), (f"<main><h1>Title</h1><p>{_L}</p><pre>code here</pre><ol><li><a href=/q>Source</a></li></ol></main>", True), (f"<p>{_S}</p><p>{_L}</p>", False)],
]


def labelled_blocks() -> tuple[np.ndarray, np.ndarray]:
    """The table that the tree is grown from: FEATURES and the label of each block of LABELLED."""
    x, y = [], []
    for page in LABELLED:
        blocks = blocks_of("<body>" + "".join(markup for markup, _ in page))
        done, labels = "<body>", []
        for markup, label in page:
            done += markup
            labels += [label] * (len(blocks_of(done)) - len(labels))
        assert len(labels) == len(blocks)
        x.append(described([blocks]))
        y += labels
    return np.concatenate(x), np.array(y)


def main_text(pages: list[str], tree: Tree) -> list[str]:
    """The kept blocks of each page, joined by a blank line."""
    found = [blocks_of(p) for p in pages]
    keeps = iter(tree(described(found)).tolist())
    return ["\n\n".join(b.text for b in blocks if next(keeps)) for blocks in found]


def _extracted(tree: Tree, keep: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pages = utf8(batch.column(keep))
            for lo, hi in by_bytes(pages, _CHUNK):
                texts = main_text([(p or b"").decode("utf-8", "replace") for p in pages[lo:hi]], tree)
                columns = [batch.column(i).slice(lo, hi - lo) for i in range(keep)]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[*(f"c{i}" for i in range(keep)), "text", "n_chars"])

    return run


def extract(pages: DataFrame, keep: list[str] | None = None, page: str = "html", tree: Tree | None = None) -> DataFrame:
    """``pages``' columns named in ``keep`` (page_id and url if none) with text and n_chars (its code points).

    ``text`` has the article's blocks in page order, joined by two newlines: character references decoded,
    white space (Unicode's, ``<br>`` too) inside a block turned into one space, ends trimmed. A null or
    empty page, or one without an article, gives the empty text; every row gives one row, repeated ones too;
    an empty table gives none. Other columns are ignored, whatever their names. A page is held by one
    task, which takes time in proportion to its length; pages are never cut.
    """
    keep = ["page_id", "url"] if keep is None else keep
    tree = grown(*labelled_blocks()) if tree is None else tree
    rows = pages.select(*[F.col(c).alias(f"c{i}") for i, c in enumerate(keep)], F.col(page).alias("html"))
    kinds = ", ".join(f"c{i} {f.dataType.simpleString()}" for i, f in enumerate(rows.schema.fields[:-1]))
    out = rows.mapInArrow(_extracted(tree, len(keep)), f"{kinds}{', ' if keep else ''}text string, n_chars long")
    return out.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(keep)], "text", "n_chars")


def op12_html_extraction(spark, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
