import html
import random
import re
import time
from html.parser import HTMLParser

import numpy as np
import pytest

from sitelode.llm.extract import BLOCK_TAGS, FEATURES, blocks_of, extract, grown, labelled_blocks, main_text, op12_html_extraction

SCHEMA = "page_id long, url string, html string, text string, n_chars string, c0 string, c1 string"


@pytest.fixture(scope="module")
def tree():
    return grown(*labelled_blocks())


def prose(rng, n):
    return " ".join(rng.choice(["the", "Öl", "river", "stone,", "häuser", "и", "漢字", "of", "light", "a&b", 'say "x"', "1<2"]) for _ in range(n))


def article(rng, n):
    """Blocks of an article, and their markup, with references, inline tags and uneven white space."""
    texts, out = [], []
    for i in range(n):
        t = prose(rng, rng.choice([1, 2, 9, 40, 120]))
        texts.append(t)
        t = html.escape(t).replace("ö", "&ouml;").replace(" ", rng.choice([" ", "\n\t ", "&nbsp; ", "<br>", " <b></b>"]))
        tag = "h1" if i == 0 else rng.choice(["p", "p", "p", "h2", "blockquote"])
        inner = rng.choice([t, f"<em>{t}</em>", f"<span class=x>{t}</span>"])
        out.append(f"<{tag}>{inner}" + rng.choice([f"</{tag}>", f"</{tag}>\n"]))
    return texts, "".join(out)


def page(rng, kind):
    """A page and its article's text, in templates that the labelled table does not have."""
    texts, body = article(rng, rng.randrange(1, 9))
    links = "".join(f'<li><a href="/{i}">{prose(rng, 2)}</a></li>' for i in range(6))
    other = f"<p>{prose(rng, 30)}</p><p>{prose(rng, 3)}</p>"
    head = f"<!DOCTYPE html><html><head><title>T &amp; t</title><style>p{{}}</style><script>var a='</p><p>no</p>';</script></head><body><!-- <p>no</p> -->"
    if kind == 0:
        return texts, f"{head}<nav><ul>{links}</ul></nav><div class='ad'>{prose(rng, 12)}</div><article>{body}</article><footer>&copy; {prose(rng, 20)}</footer></body></html>"
    if kind == 1:
        return texts, f"{head}<header><h1>Site</h1>{other}</header><div id='cookie-banner'>{other}</div><main><article>{body}</article></main><aside>{other}</aside><footer>{other}</footer>"
    if kind == 2:
        return texts, f"{head}<div class='top menu'><ul>{links}</ul></div><article>{body}<div class='advert'>{other}</div></article><section class='comments'><div class='comment'>{other}</div></section><form><p>{prose(rng, 9)}</p><input name=q></form>"
    if kind == 3:
        return texts, f"{head}<div class='site-header'>{other}</div><div class='post has-sidebar'>{body}</div><div class='sidebar'>{other}<ul>{links}</ul></div><div role=dialog>{other}</div><div class='footer'>{other}</div>"
    return texts, f"{head}<ul>{links}</ul><noscript>{other}</noscript><article><header>{body}</header></article><div class='related-posts'>{other}</div><div hidden>{other}</div><template>{other}</template>"


def test_held_out_templates(tree):
    rng = random.Random(8)
    pages = [page(rng, k % 5) for k in range(200)]
    got = main_text([p for _, p in pages], tree)
    assert got == ["\n\n".join(texts) for texts, _ in pages]


def test_tree_against_every_split():
    """The first split of a tree is the best of all, found by trying each."""
    rng = np.random.default_rng(3)
    x, y = rng.integers(0, 6, (40, 3)).astype(float), rng.random(40) < 0.4
    y |= x[:, 1] > 3

    def gini(part):
        return 2 * part.mean() * (1 - part.mean()) * len(part) if len(part) else 0.0

    splits = [(gini(y[x[:, f] <= b]) + gini(y[x[:, f] > b]), f, b) for f in range(3) for b in np.arange(0.5, 5)]
    splits = [s for s in splits if 2 <= (x[:, s[1]] <= s[2]).sum() <= 38]
    t = grown(x, y)
    cost = gini(y[x[:, t.feature[0]] <= t.bound[0]]) + gini(y[x[:, t.feature[0]] > t.bound[0]])
    assert abs(cost - min(splits)[0]) < 1e-9
    plain = (x[:, 1] > 3) | ((x[:, 0] < 2) & (x[:, 2] > 1))
    assert (grown(x, plain, least=1)(x) == plain).all()  # labels without noise are learned whole


def test_labels_are_learned_and_the_tree_is_always_the_same(tree):
    x, y = labelled_blocks()
    assert x.shape == (len(y), len(FEATURES)) and len(y) <= 200
    assert (tree(x) == y).all()
    again = grown(*labelled_blocks())
    assert all((getattr(tree, k) == getattr(again, k)).all() for k in ("feature", "bound", "low", "high", "keeps"))


class Plain(HTMLParser):
    """Blocks by the standard library's parser, for markup that is well formed."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out, self.parts = [], []

    def cut(self):
        text = " ".join("".join(self.parts).split())
        self.parts = []
        if text:
            self.out.append(text)

    def handle_starttag(self, tag, attrs):
        self.cut() if tag in BLOCK_TAGS else self.parts.append(" " * (tag == "br"))

    def handle_endtag(self, tag):
        self.cut() if tag in BLOCK_TAGS else None

    def handle_data(self, data):
        self.parts.append(data)


def test_blocks_against_the_standard_parser():
    rng = random.Random(2)

    def markup(depth):
        if not depth:
            return html.escape(prose(rng, rng.randrange(5)))
        tag = rng.choice(["div", "p", "b", "a", "ul", "section", "i", "span", "h3", "td"])
        inner = "".join(markup(depth - 1) for _ in range(rng.randrange(4)))
        return f"""<{tag} title="a > b" data-x='"'>{inner}</{tag}>""" + rng.choice(["", "<br>", "<!-- > -->", "<img src=x alt='y>'>", "\n"])

    for _ in range(150):
        text = markup(4)
        plain = Plain()
        plain.feed(text)
        plain.close()
        plain.cut()
        assert [b.text for b in blocks_of(text)] == plain.out


@pytest.mark.parametrize(
    "markup,want",
    [
        ("", []),
        ("   \n ", []),
        ("no tags &amp; more", ["no tags & more"]),
        ("a < b and c<1 &lt; &copy &am", ["a < b and c<1 < © &am"]),
        ("<p>one<p>two", ["one", "two"]),
        ("<b>bold<p>next</b> still", ["bold", "next still"]),
        ("<script>if (a<b) '<p>x</p>'</script>y", ["y"]),
        ("x<script>never closed <p>z", ["x"]),
        ("x<!-- never closed <p>z", ["x"]),
        ("x<p title='open>text<p>more", ["x", "text", "more"]),
        ("x<p title=", ["x"]),
        ("<![CDATA[x]]>y<?php z ?>w</>v", ["ywv"]),
        ("<TITLE>t</TITLE><P>Up</P>", ["Up"]),
        ("a&nbsp;&#160; b&#x41;&#0;", ["a bA�"]),
    ],
)
def test_markup_at_the_edges(markup, want):
    assert [b.text for b in blocks_of(markup)] == want


def test_long_and_deep_pages_take_time_in_proportion(tree):
    started = time.perf_counter()
    for text in ("<div>" * 100_000 + "x", "<a '" * 100_000 + ">y", "<" * 200_000, "<p>" + "word " * 400_000, "</p>" * 100_000, '<a "x>' * 50_001, "<!--" * 100_000, "<a>" * 100_000):
        main_text([text], tree)
    assert time.perf_counter() - started < 20


def test_query(spark, tmp_path, tree):
    rng = random.Random(9)
    pages = [page(rng, 0) for _ in range(30)]
    rows = [(i, f"u{i}", p, "t", "n", "x", "y") for i, (_, p) in enumerate(pages)]
    rows += [(None, None, None, "t", "n", "x", "y"), (50, "u", "", "t", "n", "x", "y"), (51, None, "<nav>only</nav>", "t", "n", "x", "y"), rows[3], (3, "again", rows[4][2], "t", "n", "x", "y")]
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{tmp_path}/pages.parquet")
    df = op12_html_extraction(spark, str(tmp_path))
    assert df.columns == ["page_id", "url", "text", "n_chars"]
    want = [(r[0], r[1], *(lambda t: (t, len(t)))("\n\n".join(pages[k][0]))) for k, r in enumerate(rows[:30])]
    want += [(None, None, "", 0), (50, "u", "", 0), (51, None, "", 0), want[3], (3, "again", *want[4][2:])]
    assert sorted(map(tuple, df.collect()), key=str) == sorted(want, key=str)
    assert all(re.fullmatch(r"\S+(?: \S+)*(?:\n\n\S+(?: \S+)*)*", r[2]) for r in want if r[2])


def test_empty(spark):
    assert extract(spark.createDataFrame([], SCHEMA)).count() == 0
