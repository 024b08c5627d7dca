"""Pages as trees, and selectors on them, without leaving a page's row.

A page's tags are matched with a stack, by the rules that browsers follow where tags are left out, into nodes
numbered in document order: a node's descendants are the numbers from its own up to its ``last``, so
that being inside is a comparison of two intervals. Nodes also know their parent, children, next sibling and
places among siblings. A tree stays one array in its page's row, so a selector, whose combinators are slices
of and lookups in that array, shuffles nothing; ``elements`` gives the nodes as rows for joins.
"""

from __future__ import annotations

import html
import re
from collections.abc import Callable, Iterator
from html.entities import html5

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript iframe noembed noframes xmp".split())
DECODED_RAW = frozenset("title textarea".split())
IN_HEAD = frozenset("base basefont bgsound link meta title script style noscript template".split())
#: Elements whose start ends an open paragraph.
ENDS_P = frozenset("""address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form
h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section summary table ul xmp li dd dt""".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
FORMATTING = frozenset("a b big code em font i nobr s small strike strong tt u".split())
#: Elements that an end tag of another name does not reach beyond.
SCOPES = frozenset("html body table td th caption button object applet marquee template".split())
INLINE = frozenset("span abbr cite q sub sup label time mark kbd samp var dfn bdi bdo data small ruby rt rp del ins".split()) | FORMATTING
_TABLE_PARTS = {"tbody": ("table",), "thead": ("table",), "tfoot": ("table",), "caption": ("table",), "tr": ("tbody", "thead", "tfoot"), "td": ("tr",), "th": ("tr",)}

_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>""")
_PLAIN_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)(?:>|\Z)")
_ATTRIBUTE = re.compile(r"""([^\s"'>/=][^\s"'>/=]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_REFERENCE = re.compile(r"&(?:#\d+;?|#[xX][0-9a-fA-F]+;?|([A-Za-z][A-Za-z0-9]*)(;|(?![=A-Za-z0-9])))")

_NODE = pa.struct(
    [
        ("tag", pa.string()),
        ("parent", pa.int32()),
        ("last", pa.int32()),
        ("depth", pa.int32()),
        ("nth", pa.int32()),
        ("nth_last", pa.int32()),
        ("nth_type", pa.int32()),
        ("nth_last_type", pa.int32()),
        ("next", pa.int32()),
        ("children", pa.list_(pa.int32())),
        ("attrs", pa.map_(pa.string(), pa.string())),
        ("text_from", pa.int32()),
        ("text_to", pa.int32()),
        ("inner_from", pa.int32()),
        ("inner_to", pa.int32()),
    ]
)
NODE = "struct<tag:string,parent:int,last:int,depth:int,nth:int,nth_last:int,nth_type:int,nth_last_type:int,next:int,children:array<int>,attrs:map<string,string>,text_from:int,text_to:int,inner_from:int,inner_to:int>"


def _attribute_value(text: str) -> str:
    """Character references decoded as in attributes: a name without its semicolon only before no letter, digit or ``=``."""

    def one(m: re.Match) -> str:
        return html.unescape(m[0]) if m[1] is None or m[2] or m[1] in html5 else m[0]

    return _REFERENCE.sub(one, text) if "&" in text else text


class Tree:
    """The nodes of one page while its tags are read."""

    __slots__ = ("tag", "parent", "last", "depth", "nth", "nth_type", "attrs", "text_from", "text_to", "inner_from", "inner_to", "pieces", "owners", "open", "counts", "born", "again", "body")

    def __init__(self) -> None:
        self.tag: list[str] = []
        self.parent: list[int] = []
        self.last: list[int] = []
        self.depth: list[int] = []
        self.nth: list[int] = []
        self.nth_type: list[int] = []
        self.attrs: list[dict[str, str]] = []
        self.text_from: list[int] = []
        self.text_to: list[int] = []
        self.inner_from: list[int] = []
        self.inner_to: list[int] = []
        self.pieces: list[str] = []
        self.owners: list[int] = []  # the node that each piece is directly in
        self.open: list[int] = []
        self.counts: dict[str, int] = {}
        self.born: list[dict[str, int]] = []  # children of each node so far, by tag; under "" all
        self.again: list[tuple[str, dict]] = []  # formatting elements that a block's end closed
        self.body = -1

    def push(self, tag: str, attrs: dict[str, str], at: int) -> None:
        up = self.open[-1] if self.open else -1
        born = self.born[up] if up >= 0 else {}
        born[""] = born.get("", 0) + 1
        born[tag] = born.get(tag, 0) + 1
        self.open.append(len(self.tag))
        self.counts[tag] = self.counts.get(tag, 0) + 1
        self.tag.append(tag)
        self.parent.append(up)
        self.last.append(-1)
        self.depth.append(len(self.open) - 1)
        self.nth.append(born[""])
        self.nth_type.append(born[tag])
        self.attrs.append(attrs)
        self.text_from.append(len(self.pieces))
        self.text_to.append(0)
        self.inner_from.append(at)
        self.inner_to.append(at)
        self.born.append({})

    def pop(self, at: int) -> str:
        i = self.open.pop()
        tag = self.tag[i]
        self.counts[tag] -= 1
        self.last[i] = len(self.tag) - 1
        self.text_to[i] = len(self.pieces)
        self.inner_to[i] = at
        return tag

    def top(self) -> str:
        return self.tag[self.open[-1]]

    def close(self, tag: str, at: int, formats: bool = True) -> None:
        """Pop up to the innermost open ``tag``; formatting elements that go with it come back where text goes on."""
        while True:
            i = self.open[-1]
            gone = self.pop(at)
            if gone == tag:
                return
            if formats and gone in FORMATTING:
                self.again.insert(0, (gone, self.attrs[i]))

    def opened(self, tag: str, until: frozenset[str] = SCOPES) -> bool:
        """Is ``tag`` open, with no element of ``until`` inside it?"""
        if not self.counts.get(tag):
            return False
        for i in reversed(self.open):
            if self.tag[i] == tag:
                return True
            if self.tag[i] in until:
                return False
        return False

    def enter_body(self, at: int) -> None:
        if self.body < 0:
            while len(self.open) > 1:
                self.pop(at)
            self.push("body", {}, at)
            self.body = self.open[-1]

    def resume(self, at: int) -> None:
        """Open again what formatting a block's end had closed."""
        for tag, attrs in self.again:
            self.push(tag, attrs, at)
        self.again = []

    def text(self, data: str, at: int) -> None:
        if not data:
            return
        if self.body < 0:
            if not data.strip():
                return
            self.enter_body(at)
        if self.again and data.strip():
            self.resume(at)
        self.say(data)

    def say(self, data: str) -> None:
        self.pieces.append(data)
        self.owners.append(self.open[-1])

    def start(self, tag: str, attrs: dict[str, str], closed: bool, begin: int, at: int) -> None:
        if tag == "html" or tag == "body" or tag == "head":
            if tag == "body":
                self.enter_body(at)
            i = 0 if tag == "html" else self.body if tag == "body" else 1
            self.attrs[i].update({k: v for k, v in attrs.items() if k not in self.attrs[i]})
            if tag != "head" and i >= 0 and self.inner_from[i] <= begin:
                self.inner_from[i] = at
            return
        if self.body < 0 and tag not in IN_HEAD:
            self.enter_body(begin)
        if self.body < 0 and len(self.open) < 2:  # after </head>, before <body>: still the head's
            self.open.append(1)
            self.counts["head"] += 1
        if tag in ENDS_P and self.opened("p"):
            self.close("p", begin)
        if tag in HEADINGS and self.top() in HEADINGS:
            self.pop(begin)
        elif tag == "li" and self.opened("li", SCOPES | {"ul", "ol", "menu"}):
            self.close("li", begin)
        elif tag in ("dt", "dd"):
            for other in ("dt", "dd"):
                if self.opened(other, SCOPES | {"dl"}):
                    self.close(other, begin)
        elif tag in ("option", "optgroup"):
            if self.top() == "option":
                self.pop(begin)
            if tag == "optgroup" and self.top() == "optgroup":
                self.pop(begin)
        elif tag == "a" and self.opened("a"):
            self.close("a", begin)
        elif tag == "button" and self.opened("button", frozenset(("html", "body", "template"))):
            self.close("button", begin)
        elif tag in _TABLE_PARTS and self.counts.get("table"):
            inside = {"tr": ("tr",), "td": ("td", "th"), "th": ("td", "th")}.get(tag, ("tbody", "thead", "tfoot", "caption"))
            for other in inside:
                if self.opened(other, frozenset(("html", "table"))):
                    self.close(other, begin, False)
            if tag == "tr" and self.top() == "table":
                self.push("tbody", {}, begin)
            elif tag in ("td", "th") and self.top() in ("table", "tbody", "thead", "tfoot"):
                if self.top() == "table":
                    self.push("tbody", {}, begin)
                self.push("tr", {}, begin)
        if self.again and tag in INLINE | VOID:
            self.resume(begin)
        self.push(tag, attrs, at)
        if tag in VOID or closed:
            self.pop(at)

    def end(self, tag: str, begin: int, at: int) -> None:
        if tag in ("html", "body", "head", "br"):
            if tag == "head" and self.body < 0 and len(self.open) > 1:
                while len(self.open) > 1:
                    self.pop(begin)
            elif tag != "head" and self.body >= 0 and not self.inner_to[self.body] > self.inner_from[self.body]:
                self.inner_to[self.body] = -begin  # where its source ends; what follows is still inside
            return
        if tag == "p" and not self.opened("p"):
            self.enter_body(begin)
            self.push("p", {}, begin)
        if tag in FORMATTING:
            kept = [k for k, (t, _) in enumerate(self.again) if t == tag]
            if kept and not self.opened(tag):
                del self.again[kept[-1]]
                return
        stops = frozenset(("html", "body")) if tag in ("table", "tbody", "thead", "tfoot", "tr", "td", "th", "caption") else SCOPES - {tag}
        if self.opened(tag, stops):
            if tag in FORMATTING and any(self.tag[i] not in INLINE for i in self.open[self._place(tag) + 1 :]):
                return  # a block is open inside: the element stays, as it holds the block
            self.close(tag, begin, tag not in ("td", "th", "tr", "table"))

    def _place(self, tag: str) -> int:
        k = len(self.open) - 1
        while self.tag[self.open[k]] != tag:
            k -= 1
        return k

    def index(self) -> dict[str, list[int]]:
        """The nodes of each type, ``.class`` and ``#id``."""
        out: dict[str, list[int]] = {}
        for i, (tag, attrs) in enumerate(zip(self.tag, self.attrs)):
            out.setdefault(tag, []).append(i)
            if attrs:
                if attrs.get("id"):
                    out.setdefault("#" + attrs["id"], []).append(i)
                for name in dict.fromkeys(re.split("[ \t\n\f\r]+", attrs.get("class", ""))):
                    if name:
                        out.setdefault("." + name, []).append(i)
        return out


def parse(page: str) -> Tree:
    """The tree of a page. html, head and body are always there.

    As browsers do: paragraphs, list items, table parts and options end where the next begins; table rows get
    a body; formatting that a block's end cuts goes on in the next text. Unlike them: content misplaced in
    a table stays there, and a formatting element closed inside a block it does not hold stays whole.
    """
    tree, at, n, tag = Tree(), 0, len(page), _TAG
    tree.push("html", {}, 0)
    tree.push("head", {}, 0)
    while at < n:
        lt = page.find("<", at)
        if lt != at:
            tree.text(html.unescape(page[at : n if lt < 0 else lt]), at)
            if lt < 0:
                break
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
                tag = _PLAIN_TAG  # quotes do not close: from here on tags end at the next >
        if m is None:
            end = page.find(">", lt) if following == "/" else -1
            if end >= 0:
                at = end + 1
            else:
                tree.text("<", lt)
                at = lt + 1
            continue
        at, name = m.end(), m[2].lower()
        if m[1]:
            tree.end(name, lt, at)
            continue
        attrs: dict[str, str] = {}
        if m[3] and not m[3].isspace():
            for key, *values in _ATTRIBUTE.findall(m[3]):
                attrs.setdefault(key.lower(), _attribute_value("".join(values)))
        raw = name in RAW or name in DECODED_RAW
        tree.start(name, attrs, False, lt, at)
        if raw:
            end = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*>?", re.I).search(page, at)
            stop, after = (n, n) if end is None else (end.start(), end.end())
            content = page[at:stop]
            if content:
                tree.say(html.unescape(content) if name in DECODED_RAW else content)
            tree.pop(stop)
            at = after
    tree.enter_body(n)
    while tree.open:
        tree.pop(n)
    if (end := tree.inner_to[tree.body]) < 0:
        tree.inner_to[tree.body] = -end
    return tree


def _columns(trees: list[Tree]) -> list[pa.Array]:
    """nodes, pieces, owners and index of pages, as Arrow lists and maps."""
    sizes = np.array([len(t.tag) for t in trees])
    offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32())
    ints = {k: np.array([x for t in trees for x in getattr(t, k)], np.int32) for k in ("parent", "last", "depth", "nth", "nth_type", "text_from", "text_to", "inner_from", "inner_to")}
    base = np.repeat(np.cumsum(sizes) - sizes, sizes)
    total = int(sizes.sum())
    up = np.where(ints["parent"] >= 0, ints["parent"] + base, -1)
    # siblings in order, parent by parent
    order = np.lexsort((np.arange(total), up))
    same = (up[order][1:] == up[order][:-1]) & (up[order][1:] >= 0)
    following = np.full(total, -1, np.int32)
    following[order[:-1][same]] = (order[1:] - base[order[1:]])[same]
    held = order[up[order] >= 0]
    counts = np.bincount(up[held], minlength=total)
    children = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), pa.array((held - base[held]).astype(np.int32)))
    of_kind = [t.born[p][tag] if p >= 0 else 1 for t in trees for p, tag in zip(t.parent, t.tag)]
    siblings = np.where(up >= 0, counts[np.maximum(up, 0)], 1)
    attrs = [t for tree in trees for t in tree.attrs]
    starts = pa.array(np.concatenate([[0], np.cumsum([len(a) for a in attrs])]), pa.int32())
    maps = pa.MapArray.from_arrays(starts, pa.array([k for a in attrs for k in a], pa.string()), pa.array([v for a in attrs for v in a.values()], pa.string()))
    fields = {
        "tag": pa.array([x for t in trees for x in t.tag], pa.string()),
        **{k: pa.array(v) for k, v in ints.items()},
        "nth_last": pa.array((siblings - ints["nth"] + 1).astype(np.int32)),
        "nth_last_type": pa.array((np.array(of_kind, np.int32) - ints["nth_type"] + 1).astype(np.int32)),
        "next": pa.array(following),
        "children": children,
        "attrs": maps,
    }
    nodes = pa.StructArray.from_arrays([fields[f.name] for f in _NODE], fields=list(_NODE))
    index = [t.index() for t in trees]
    starts = pa.array(np.concatenate([[0], np.cumsum([len(x) for x in index])]), pa.int32())
    index = pa.MapArray.from_arrays(starts, pa.array([k for x in index for k in x], pa.string()), pa.array([v for x in index for v in x.values()], pa.list_(pa.int32())))
    return [pa.ListArray.from_arrays(offsets, nodes), pa.array([t.pieces for t in trees], pa.list_(pa.string())), pa.array([t.owners for t in trees], pa.list_(pa.int32())), index]


#: Characters of pages whose trees are built at a time; a larger page is built alone.
_CHUNK = 1 << 21


def _planted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        pages = batch.column("html").to_pylist()
        lo = 0
        while lo < len(pages):
            hi, size = lo, 0
            while hi < len(pages) and (hi == lo or size + len(pages[hi] or "") <= _CHUNK):
                size += len(pages[hi] or "")
                hi += 1
            part = batch.slice(lo, hi - lo)
            yield pa.RecordBatch.from_arrays([*part.columns, *_columns([parse(p or "") for p in pages[lo:hi]])], names=[*batch.schema.names, "nodes", "pieces", "owners", "index"])
            lo = hi


def trees(pages: DataFrame) -> DataFrame:
    """``pages`` (page_id, url, html) with nodes, pieces (the texts between tags), owners (the node that each is directly in) and index (nodes by type, ``.class`` and ``#id``): one row a page, nothing is shuffled.

    A null page has the tree of an empty one. Repeated rows have a tree each; an empty table has none.
    """
    rows = pages.select("page_id", "url", "html")
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInArrow(_planted, f"{kinds}, nodes array<{NODE}>, pieces array<string>, owners array<int>, index map<string,array<int>>")


def elements(planted: DataFrame) -> DataFrame:
    """A row for each node: page_id, node, its fields and own text."""
    rows = planted.select("page_id", "pieces", F.posexplode("nodes").alias("node", "n"))
    return rows.select("page_id", "node", "n.*", F.array_join(F.slice("pieces", F.col("n.text_from") + 1, F.col("n.text_to") - F.col("n.text_from")), "").alias("text"))


# --- selectors -------------------------------------------------------------------------------------------------

_NAME = r"(?:[A-Za-z_\u0080-\U0010ffff-]|\\.)(?:[\w\u0080-\U0010ffff-]|\\.)*"
_TOKEN = re.compile(
    rf"""(?P<space>\s*[>+~,]\s*|\s+)|(?P<tag>{_NAME}|\*)|\#(?P<id>(?:[\w\u0080-\U0010ffff-]|\\.)+)|\.(?P<cls>{_NAME})
    |\[\s*(?P<attr>[\w:.-]+)\s*(?:(?P<op>[~|^$*]?=)\s*(?:"(?P<dq>[^"]*)"|'(?P<sq>[^']*)'|(?P<bare>[^\s\]]+))\s*(?P<flag>[iIsS])?\s*)?\]
    |:(?P<pseudo>[a-z-]+)(?P<paren>\()?""",
    re.X,
)
_NTH = re.compile(r"\s*(?:(odd)|(even)|([+-]?\d*)n\s*(?:([+-])\s*(\d+))?|([+-]?\d+))\s*$", re.I)

Test = Callable[[Column], Column]
#: A combinator, a test of a node, and what the index may know such nodes by.
Step = tuple[str, Test, str | None]


class SelectorError(ValueError):
    pass


def _nth_test(column: str, argument: str) -> Test:
    m = _NTH.match(argument)
    if not m:
        raise SelectorError(f"not a place among siblings: {argument}")
    if m[1] or m[2]:
        a, b = 2, 1 if m[1] else 0
    elif m[6]:
        a, b = 0, int(m[6])
    else:
        a, b = int(m[3] + "1" if m[3] in ("", "+", "-") else m[3]), int((m[4] or "") + (m[5] or "0"))
    if a == 0:
        return lambda n: n[column] == b
    return lambda n: ((n[column] - F.lit(b)) % F.lit(a) == 0) & ((n[column] - F.lit(b)) / F.lit(a) >= 0)


def _attribute_test(key: str, op: str | None, value: str, fold: bool) -> Test:
    key = key.lower()

    def test(n: Column) -> Column:
        x = n["attrs"][key]
        if op is None:
            return x.isNotNull()
        x, v = (F.lower(x), value.lower()) if fold else (x, value)
        if op == "=":
            out = x == v
        elif op == "~=":
            out = F.array_contains(F.split(x, r"[ \t\n\f\r]+"), v) if v and not re.search(r"\s", v) else F.lit(False)
        elif op == "|=":
            out = (x == v) | x.startswith(v + "-")
        else:
            out = {"^=": x.startswith, "$=": x.endswith, "*=": x.contains}[op](v) if v else F.lit(False)
        return F.coalesce(out, F.lit(False))

    return test


_PLACES = {
    "first-child": lambda n: n["nth"] == 1,
    "last-child": lambda n: n["nth_last"] == 1,
    "only-child": lambda n: (n["nth"] == 1) & (n["nth_last"] == 1),
    "first-of-type": lambda n: n["nth_type"] == 1,
    "last-of-type": lambda n: n["nth_last_type"] == 1,
    "only-of-type": lambda n: (n["nth_type"] == 1) & (n["nth_last_type"] == 1),
    "empty": lambda n: (F.size(n["children"]) == 0) & (n["text_from"] == n["text_to"]),
    "root": lambda n: n["parent"] < 0,
}
_NTHS = {"nth-child": "nth", "nth-last-child": "nth_last", "nth-of-type": "nth_type", "nth-last-of-type": "nth_last_type"}


def _unescaped(name: str) -> str:
    return re.sub(r"\\(.)", r"\1", name)


def compiled(css: str) -> list[tuple[list[Step], tuple[int, int, int]]]:
    """For each selector of a list: its steps from the left, and its specificity."""
    out, steps, tests, weight, keys = [], [], [], [0, 0, 0], []
    combinator, at, css = "", 0, css.strip()

    def step() -> None:
        nonlocal tests, keys
        if not tests:
            raise SelectorError(f"nothing to select in {css!r}")
        own = tests
        steps.append((combinator, lambda n: _all(t(n) for t in own), min(keys, default=None)))  # ids sort first, then classes
        tests, keys = [], []

    while at < len(css):
        m = _TOKEN.match(css, at)
        if not m or (m["tag"] and tests):
            raise SelectorError(f"not a selector: {css!r}")
        at = m.end()
        if m["space"] is not None:
            step()
            combinator = m["space"].strip() or " "
            if combinator == ",":
                out.append((steps, tuple(weight)))
                steps, weight, combinator = [], [0, 0, 0], ""
        elif m["tag"]:
            name = _unescaped(m["tag"]).lower()
            tests.append((lambda n: F.lit(True)) if name == "*" else lambda n, name=name: n["tag"] == name)
            weight[2] += name != "*"
            keys += [name] * (name != "*")
        elif m["id"]:
            tests.append(_attribute_test("id", "=", _unescaped(m["id"]), False))
            keys.append("#" + _unescaped(m["id"]))
            weight[0] += 1
        elif m["cls"]:
            tests.append(_attribute_test("class", "~=", _unescaped(m["cls"]), False))
            keys.append("." + _unescaped(m["cls"]))
            weight[1] += 1
        elif m["attr"]:
            tests.append(_attribute_test(m["attr"], m["op"], next((m[k] for k in ("dq", "sq", "bare") if m[k] is not None), ""), (m["flag"] or "").lower() == "i"))
            weight[1] += 1
        else:
            name, argument = m["pseudo"], ""
            if m["paren"]:
                depth, start = 1, at
                while at < len(css) and depth:
                    depth += {"(": 1, ")": -1}.get(css[at], 0)
                    at += 1
                argument = css[start : at - 1]
                if depth:
                    raise SelectorError(f"a bracket does not close: {css!r}")
            if name in _PLACES and not m["paren"]:
                tests.append(_PLACES[name])
                weight[1] += 1
            elif name in _NTHS and m["paren"]:
                tests.append(_nth_test(_NTHS[name], argument))
                weight[1] += 1
            elif name in ("not", "is", "where") and m["paren"]:
                inner = compiled(argument)
                if any(len(s) > 1 for s, _ in inner):
                    raise SelectorError(f"only compounds inside :{name}(): {css!r}")
                any_of = [s[0][1] for s, _ in inner]
                tests.append(lambda n, any_of=any_of, no=name == "not": ~_any(t(n) for t in any_of) if no else _any(t(n) for t in any_of))
                if name != "where":
                    weight = [x + y for x, y in zip(weight, max(w for _, w in inner))]
            else:
                raise SelectorError(f"not a selector: {css!r}")
    step()
    out.append((steps, tuple(weight)))
    return out


def _all(tests: Iterator[Column]) -> Column:
    out = None
    for t in tests:
        out = t if out is None else out & t
    return out


def _any(tests: Iterator[Column]) -> Column:
    out = None
    for t in tests:
        out = t if out is None else out | t
    return out


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _no_ints() -> Column:
    return F.expr("cast(array() as array<int>)")


def _ints(lo: Column, hi: Column) -> Column:
    """lo, lo + 1, ..., hi - 1; nothing where hi <= lo."""
    return F.when(lo < hi, F.sequence(lo, hi - 1)).otherwise(_no_ints())


def _step(found: Column, combinator: str, nodes: Column, test: Test) -> Column:
    """The next step of a selector: numbers of nodes, in document order, from those of the step before."""
    node = lambda i: F.get(nodes, i)
    passed = lambda some: F.filter(some, lambda i: test(node(i)))
    if combinator == " ":
        # of nested nodes only the outermost count: their insides do not overlap and hold all others'
        start = F.struct(F.lit(-1).alias("reach"), _no_ints().alias("kept"))
        outer = F.aggregate(found, start, lambda s, i: F.when(i > s["reach"], F.struct(node(i)["last"].alias("reach"), F.array_append(s["kept"], i).alias("kept"))).otherwise(s))["kept"]
        return F.flatten(F.transform(outer, lambda i: passed(_ints(i + 1, node(i)["last"] + 1))))
    if combinator == ">":
        return F.sort_array(F.flatten(F.transform(found, lambda i: passed(node(i)["children"]))))
    if combinator == "+":
        return F.sort_array(passed(F.filter(F.transform(found, lambda i: node(i)["next"]), lambda i: i >= 0)))
    # of siblings only the first counts: those after it are all that follow any
    by_parent = F.array_sort(F.transform(found, lambda i: F.struct(node(i)["parent"].alias("parent"), i.alias("i"))))
    first = _let(by_parent, lambda a: F.filter(a, lambda x, k: (k == 0) | (F.get(a, k - 1)["parent"] != x["parent"])))
    after = lambda x: F.filter(node(x["parent"])["children"], lambda c: c > x["i"])
    return F.sort_array(F.flatten(F.transform(F.filter(first, lambda x: x["parent"] >= 0), lambda x: passed(after(x)))))


def _selected(steps: list[Step], nodes: Column, index: Column) -> Column:
    _, test, key = steps[0]
    first = _ints(F.lit(0), F.size(nodes)) if key is None else F.coalesce(index[key], _no_ints())
    found = F.filter(first, lambda i: test(F.get(nodes, i)))
    for combinator, test, _ in steps[1:]:
        found = _step(found, combinator, nodes, test)
    return found


def select(css: str) -> Column:
    """Numbers of the nodes that a selector list selects, in document order, over the columns of ``trees``.

    Types, ``*``, ids, classes, attributes with all operators, ``:not``, ``:is`` and ``:where`` of compounds, places among
    siblings, ``:empty``, ``:root``; descendants, children, next and later siblings. Anything else raises SelectorError.
    """
    each = [_selected(steps, F.col("nodes"), F.col("index")) for steps, _ in compiled(css)]
    return each[0] if len(each) == 1 else F.sort_array(F.array_distinct(F.flatten(F.array(*each))))


def text_of(i: Column, nodes: Column | None = None, pieces: Column | None = None) -> Column:
    """All text inside node ``i``."""
    nodes, pieces = F.col("nodes") if nodes is None else nodes, F.col("pieces") if pieces is None else pieces
    return _let(F.get(nodes, i), lambda n: F.array_join(F.slice(pieces, n["text_from"] + 1, n["text_to"] - n["text_from"]), ""))


def inner_html(i: Column) -> Column:
    """The source between the tags of node ``i``."""
    return _let(F.get(F.col("nodes"), i), lambda n: F.col("html").substr(n["inner_from"] + 1, n["inner_to"] - n["inner_from"]))


def attribute(i: Column, key: str) -> Column:
    return F.get(F.col("nodes"), i)["attrs"][key.lower()]
