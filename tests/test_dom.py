import random
from html.parser import HTMLParser

import pytest
from pyspark.sql import functions as F

from sitelode import dom
from sitelode.extraction import Rule, extracted, form_controls, regions


def planted(spark, pages):
    return dom.trees(spark.createDataFrame([(i, f"u{i}", p) for i, p in enumerate(pages)], "page_id long, url string, html string"))


class Plain(HTMLParser):
    """The tree of well-formed markup by the standard library: [tag, attributes, parent, children, text]."""

    def __init__(self, markup):
        super().__init__(convert_charrefs=True)
        self.nodes = []
        self.open = []
        for tag in ("html", "head"):
            self.handle_starttag(tag, [])
        self.open.pop()
        self.handle_starttag("body", [])
        self.feed(markup)
        self.close()

    def handle_starttag(self, tag, attrs):
        up = self.open[-1] if self.open else None
        self.nodes.append([tag, dict(attrs), up, [], ""])
        me = len(self.nodes) - 1
        if up is not None:
            self.nodes[up][3].append(me)
        self.open.append(me)

    def handle_endtag(self, tag):
        assert self.nodes[self.open[-1]][0] == tag
        self.open.pop()

    def handle_data(self, data):
        for i in self.open:
            self.nodes[i][4] += data


def markup(rng, depth):
    """Nested equal tags, without tags that end each other."""
    out = ""
    for _ in range(rng.randrange(1, 4)):
        tag = rng.choice(["div", "div", "section", "span", "em"])
        attrs = rng.choice(["", ' class="a"', ' class="b a"', ' id="x"', ' class="c" data-k="v-1"', ' class="ab" lang="en-GB"'])
        out += f"<{tag}{attrs}>" + (markup(rng, depth - 1) if depth and rng.random() < 0.8 else rng.choice(["", "t", "u &amp; v"])) + f"</{tag}>" + rng.choice(["", " "])
    return out


def chain(nodes, i, steps):
    """Does node ``i`` end a chain of steps? By the definition, from the right."""
    (combinator, test), before = steps[-1], steps[:-1]
    if not test(nodes, i):
        return False
    if not before:
        return True
    up = nodes[i][2]
    brothers = nodes[up][3] if up is not None else [i]
    place = brothers.index(i)
    others = {">": [up] if up is not None else [], "+": brothers[place - 1 : place] if place else [], "~": brothers[:place]}.get(combinator)
    if others is None:
        others = []
        while up is not None:
            others.append(up)
            up = nodes[up][2]
    return any(chain(nodes, j, before) for j in others)


def tag(name):
    return lambda nodes, i: nodes[i][0] == name


def cls(name):
    return lambda nodes, i: name in (nodes[i][1].get("class") or "").split()


def both(*tests):
    return lambda nodes, i: all(t(nodes, i) for t in tests)


def nth(f, kind=False, back=False):
    def test(nodes, i):
        up = nodes[i][2]
        row = [j for j in (nodes[up][3] if up is not None else [i]) if not kind or nodes[j][0] == nodes[i][0]]
        return f((row[::-1] if back else row).index(i) + 1)

    return test


def attr(key, f):
    return lambda nodes, i: key in nodes[i][1] and f(nodes[i][1][key])


CASES = {
    "div": [("", tag("div"))],
    "div div": [("", tag("div")), (" ", tag("div"))],
    "div>div": [("", tag("div")), (">", tag("div"))],
    "div div span.a": [("", tag("div")), (" ", tag("div")), (" ", both(tag("span"), cls("a")))],
    "section > div .a em": [("", tag("section")), (">", tag("div")), (" ", cls("a")), (" ", tag("em"))],
    "div + span": [("", tag("div")), ("+", tag("span"))],
    "div ~ div": [("", tag("div")), ("~", tag("div"))],
    "div.a ~ * > span": [("", both(tag("div"), cls("a"))), ("~", lambda n, i: True), (">", tag("span"))],
    "span:nth-child(2n+1)": [("", both(tag("span"), nth(lambda k: k % 2 == 1)))],
    "span:nth-child(-n+2)": [("", both(tag("span"), nth(lambda k: k <= 2)))],
    "div:nth-of-type(even)": [("", both(tag("div"), nth(lambda k: k % 2 == 0, True)))],
    "div:nth-last-of-type(1)": [("", both(tag("div"), nth(lambda k: k == 1, True, True)))],
    "em:nth-last-child(2)": [("", both(tag("em"), nth(lambda k: k == 2, False, True)))],
    "[data-k^=v]": [("", attr("data-k", lambda v: v.startswith("v")))],
    "[lang|=en]": [("", attr("lang", lambda v: v == "en" or v.startswith("en-")))],
    "[class='A' i]": [("", attr("class", lambda v: v.lower() == "a"))],
    "[class*=b]": [("", attr("class", lambda v: "b" in v))],
    "#x > .b": [("", attr("id", lambda v: v == "x")), (">", cls("b"))],
    "div:not(.a):not(#x)": [("", both(tag("div"), lambda n, i: not cls("a")(n, i) and n[i][1].get("id") != "x"))],
    ":is(div, span):empty": [("", lambda n, i: n[i][0] in ("div", "span") and not n[i][3] and not n[i][4])],
}


def test_selectors_against_the_definition(spark):
    rng = random.Random(11)
    pages = [markup(rng, 4) for _ in range(40)] + ["", None]
    rows = planted(spark, pages).select("page_id", *[dom.select(css).alias(f"c{k}") for k, css in enumerate(CASES)], dom.select("em, div.a, em").alias("both")).collect()
    assert len(rows) == len(pages)
    hits = 0
    for r in rows:
        nodes = Plain(pages[r.page_id] or "").nodes
        for k, (css, steps) in enumerate(CASES.items()):
            want = [i for i in range(len(nodes)) if chain(nodes, i, steps)]
            assert r[f"c{k}"] == want, (css, pages[r.page_id])
            hits += len(want)
        assert r.both == [i for i in range(len(nodes)) if nodes[i][0] == "em" or (nodes[i][0] == "div" and cls("a")(nodes, i))]
    assert hits > 1000


def test_nodes_against_the_standard_parser(spark):
    rng = random.Random(12)
    pages = [markup(rng, 3) for _ in range(20)]
    by_page = {}
    for r in dom.elements(planted(spark, pages)).collect():
        by_page.setdefault(r.page_id, {})[r.node] = r
    for i, p in enumerate(pages):
        want, got = Plain(p).nodes, by_page[i]
        assert [(got[k].tag, got[k].attrs, got[k].parent if got[k].parent >= 0 else None, got[k].children, got[k].text) for k in range(len(want))] == [tuple(n) for n in want]
        for k, n in enumerate(want):  # intervals: all that is inside, and nothing else
            inside = [j for j in range(len(want)) if _under(want, j, k)]
            assert inside == list(range(k + 1, got[k].last + 1)) and got[k].depth == (0 if n[2] is None else got[n[2]].depth + 1)


def _under(nodes, j, k):
    while (j := nodes[j][2]) is not None:
        if j == k:
            return True
    return False


def shape(page):
    t = dom.parse(page)

    def one(i):
        inner = " ".join(one(j) for j in range(len(t.tag)) if t.parent[j] == i)
        return t.tag[i] + (f"({inner})" if inner else "")

    return one(0), "|".join(t.pieces)


@pytest.mark.parametrize(
    "page,tree,text",
    [
        ("", "html(head body)", ""),
        ("<p>one<p>two", "html(head body(p p))", "one|two"),
        ("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>", "html(head body(ul(li li(ul(li)) li)))", "a|b|c|d"),
        ("<p><b>t<br><p>n</article>m", "html(head body(p(b(br)) p(b)))", "t|n|m"),
        ("<table><tr><td>1<td>2<tr><th>3</table>x", "html(head body(table(tbody(tr(td td) tr(th)))))", "1|2|3|x"),
        ("<dl><dt>a<dd>b<dt>c</dl>", "html(head body(dl(dt dd dt)))", "a|b|c"),
        ("<a href=1>x<a href=2>y</a>z", "html(head body(a a))", "x|y|z"),
        ("<title>a&amp;b<i></title><script>if(a<b)</script>hi", "html(head(title script) body)", "a&b<i>|if(a<b)|hi"),
        ("<h1>a<h2>b</h1></h2>c", "html(head body(h1 h2))", "a|b|c"),
        ("<select><option>1<option>2</select>", "html(head body(select(option option)))", "1|2"),
        ("<div><span>a</div>b", "html(head body(div(span)))", "a|b"),
        ("</p>x<p title='open>y", "html(head body(p p))", "x|y"),
        ("<!-- <p> -->a<!DOCTYPE x>b<?c?>", "html(head body)", "a|b"),
    ],
)
def test_tags_left_out(page, tree, text):
    assert shape(page) == (tree, text)


def test_attributes_as_browsers_read_them():
    t = dom.parse("""<a HREF='/x?a=1&copy=2&amp;b' id=k&lt;l data-q="&quot;&copy" disabled class = "c d" id=no>""")
    assert t.attrs[-1] == {"href": "/x?a=1&copy=2&b", "id": "k<l", "data-q": '"©', "disabled": "", "class": "c d"}


def test_long_and_deep_pages():
    assert len(dom.parse("<div>" * 20000 + "x").tag) == 20003
    assert dom.parse("<p>" + "word " * 200000).pieces[0].startswith("word")
    assert len(dom.parse("<a '" * 50000 + ">y").tag) < 60000


def test_what_is_no_selector():
    for css in ("", "div >", "a >> b", "p::before", "a:hover", ":nth-child(x)", "div, ", "p..q", ":not(a b)", "p[", ":is(a"):
        with pytest.raises(dom.SelectorError):
            dom.compiled(css)


def test_specificity():
    weight = lambda css: dom.compiled(css)[0][1]
    assert weight("*") == (0, 0, 0) and weight("ul li") == (0, 0, 2) and weight("#a .b[c] d:first-child") == (1, 3, 1) and weight("p:not(#x):where(.y)") == (1, 0, 1)


def test_extraction(spark):
    page = '<div class="a"><div class="a b">in <i>x</i></div> out</div><p class=lead>One <b>two</b></p><p class=leader>no</p><a data-x=1 href="/q/7">t</a><a href="/r">u</a><time>é é é</time><p></p>'
    rules = [
        Rule("nested", "div.a"),
        Rule("inner", "div.a.b", "html"),
        Rule("lead", "p.lead", max_length=5),
        Rule("exact", "p.lead", max_length=7),
        Rule("bytes", "time", max_length=6),
        Rule("group", "a[href]", "href", r"/q/(\d)", 1, "none"),
        Rule("attribute", "a", "data-x", default="0"),
        Rule("absent", "video", default="nothing"),
        Rule("bad group", "p.lead", regex="One", capture_group=3, default="d"),
        Rule("bad pattern", "p.lead", regex="(", default="d"),
        Rule("empty", "p:empty"),
        Rule("bad selector", "a >"),
    ]
    got = {r.rule_name: r["values"] for r in extracted(planted(spark, [page]), rules).collect()}
    assert got == {
        "nested": ["in x out", "in x"],
        "inner": ["in <i>x</i>"],
        "lead": ["One t..."],
        "exact": ["One two"],
        "bytes": ["é é é..."],
        "group": ["7", "none"],
        "attribute": ["1", "0"],
        "absent": ["nothing"],
        "bad group": ["d"],
        "bad pattern": ["d"],
        "empty": [""],
    }
    assert extracted(planted(spark, [page]), []).count() == 0


def test_form_controls(spark):
    page = """<label for=out>o</label><form action=/a METHOD=POST><fieldset><legend>L</legend><label for=one>1</label><input id=one required>
    <label>2 <span><select name=two></select></span></label><textarea aria-label=T></textarea><input aria-labelledby=z type=file></fieldset><input id=out></form><form><input aria-required=true></form><form></form><input>"""
    rows = form_controls(planted(spark, [page, None])).orderBy("form", "control").collect()
    assert [(r.form, r.control, r.explicit_label, r.implicit_label, r.has_label, r.required) for r in rows] == [
        (0, 0, True, False, True, True),
        (0, 1, False, True, True, False),
        (0, 2, False, False, True, False),
        (0, 3, False, False, True, False),
        (0, 4, False, False, False, False),
        (1, 0, False, False, False, True),
    ]
    assert {(r.action, r.method, r.has_fieldset, r.has_legend) for r in rows if r.form == 0} == {("/a", "post", True, True)}


def test_regions(spark):
    page = "<nav>a b <nav>c</nav></nav><main>d <article>e f</article></main><footer>g</footer><div><footer>h</footer></div>"
    got = {r.region: (r.nodes, r.words) for r in regions(planted(spark, [page])).collect()}
    assert got == {"head": (0, 0), "nav": (2, 4), "main": (2, 5), "aside": (0, 0), "footer": (1, 1), "advert": (0, 0)}


def test_one_page_a_row(spark):
    df = planted(spark, ["<p>a"] * 3 + [None])
    assert df.count() == 4 and df.where(F.size("nodes") == 3).count() == 1
    assert planted(spark, []).count() == 0
    assert "Exchange" not in df.select(dom.select("div > p.x a[href]"))._jdf.queryExecution().toString()
