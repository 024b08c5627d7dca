import random
import time

import pytest
from pyspark.sql import functions as F

from sitelode import plugins, rendering
from sitelode.rendering import aligned, alignment, parity


def longest(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        old = row[:]
        for j, y in enumerate(b):
            row[j + 1] = old[j] + 1 if x == y else max(old[j + 1], row[j])
    return row[-1]


@pytest.mark.parametrize("seed", range(40))
def test_alignment_is_a_common_subsequence(seed):
    rng = random.Random(seed)
    a = [rng.choice("abcdefgh") + str(rng.randrange(3 if seed % 2 else 400)) for _ in range(rng.randrange(40))]
    b = [x for x in a if rng.random() < 0.8]
    for _ in range(rng.randrange(6)):
        b.insert(rng.randrange(len(b) + 1), rng.choice([*a, "new"]))
    pairs = aligned(a, b)
    assert all(a[i] == b[j] for i, j in pairs) and all(i < k and j < m for (i, j), (k, m) in zip(pairs, pairs[1:]))
    words = [*a, *b]
    if len(set(a)) == len(a) and len(set(b)) == len(b):  # words that occur once: the longest there is
        assert len(pairs) == longest(a, b)
    assert len(pairs) <= longest(a, b) and (not words or len(pairs) >= longest(a, b) * 0.4 - 2)


def test_alignment_of_long_texts_takes_time_in_proportion():
    rng = random.Random(1)
    a = [f"w{rng.randrange(10**6)}" for _ in range(100_000)]
    b = [x for x in a if rng.random() < 0.95]
    started = time.perf_counter()
    assert len(aligned(a, b)) > 0.94 * len(b)
    assert len(aligned(["x"] * 50_000, ["x"] * 40_000)) == 40_000
    assert time.perf_counter() - started < 10


def test_runs(spark):
    rows = [(1, "<p>one two three four</p>", "<p>one new words three four</p><script>no</script>"), (2, "<p>same text</p>", "<p>same <b>text</b></p>"), (3, None, "<p>x</p>"), (4, "", "<p>all new</p>"), (5, "<p>gone now</p>", "")]
    df = spark.createDataFrame(rows, "page_id long, served string, rendered string")
    assert sorted(map(tuple, alignment(df).collect())) == [(1, "inserted", 1, 2, "new words"), (1, "lost", 1, 1, "two"), (4, "inserted", 0, 2, "all new"), (5, "lost", 0, 2, "gone now")]


def found(spark, served, rendered):
    df = spark.createDataFrame([(1, "http://h/a", served, rendered)], "page_id long, url string, served string, rendered string")
    return {r.code: r.missing for r in parity(df).collect()}


LONG = " ".join(f"word{i}" for i in range(60))


def test_parity(spark):
    head = "<html><head><title>T&#39;s &amp; x</title><meta content='d e' name=description></head><body>"
    assert found(spark, head + "<div id=app></div>", head + f"<p>{LONG}</p>") == {"JSRENDER-TEXT-MISSING": 60}
    assert found(spark, head + f"<p>{LONG}</p>", head + f"<div><i>{LONG}</i></div>") == {}
    assert found(spark, None, head + LONG) == {} and found(spark, head, None) == {}
    assert found(spark, head, head + " ".join(f"w{i}" for i in range(24))) == {}  # too few
    assert found(spark, head + f"<p>{LONG * 3}</p>" + " ".join(f"x{i}" for i in range(200)), head + f"<p>{LONG * 3}</p>" + " ".join(f"x{i}" for i in range(225))) == {}  # a small share
    assert found(spark, head + '<a href="/b?x=1">b</a>', head + '<a href="http://h/b?x=1#y">b</a><a href="/c">c</a>') == {"JSRENDER-LINKS-MISSING": 1}
    block = '<script type="application/ld+json">{"a": 1}</script>'
    assert found(spark, head, head + block + block) == {"JSRENDER-SCHEMA-MISSING": 2}
    assert found(spark, head + block, head) == {} and found(spark, head, head + "<!-- " + block + " -->") == {}
    same = '<html><head><TITLE>T\'s  &amp;amp; x</TITLE><meta name="description" content="d  e"></head>'.replace("&amp;amp;", "&amp;")
    assert found(spark, head, same) == {}
    assert found(spark, head, head.replace("T&#39;s", "Other").replace("d e", "f")) == {"JSRENDER-META-REWRITTEN": 2}
    assert found(spark, "<html><body>", head) == {}  # one side has none
    assert found(spark, head + "<style>a{}</style><script>" + LONG, head + '<p title="a > b">x</p>') == {}


def counting():
    """A class of its own for each call, so that it travels to the workers by value."""

    class Counting(plugins.SiteRule):
        """Findings that tell what the rule saw, and failures on demand."""

        def start(self, context):
            super().start(context)
            self.seen = []
            if context["host"] == "bad-start":
                raise RuntimeError("start")

        def page(self, row):
            if row["host"] == "bad-page" and row["page_id"] == 2:
                raise RuntimeError("page")
            self.seen.append(row["page_id"])

        def finish(self):
            yield "C1", "warning", " ".join(map(str, self.seen)), len(self.seen)
            if self.context["host"] == "bad-finish":
                raise RuntimeError("finish")
            yield "C2", "odd", self.context["name"], 1

    return Counting


def test_rules_of_users(spark):
    hosts = ["a", "b", "bad-start", "bad-page", "bad-finish", None]
    df = spark.createDataFrame([(h, i) for i in (3, 1, 2) for h in hosts], "host string, page_id long").repartition(5)
    got = plugins.site_findings(df, counting(), {"name": "ü"}).collect()
    assert sorted(map(tuple, got), key=str) == sorted([x for h in ("a", "b", None) for x in ((h, "C1", "warning", "1 2 3", 3), (h, "C2", "info", "ü", 1))], key=str)
    assert plugins.site_findings(df.where("false"), counting()).count() == 0
    with pytest.raises(Exception, match="host and a page_id"):
        plugins.site_findings(df.drop("page_id"), counting()).count()
    many = spark.range(500).select(F.lit("h").alias("host"), F.col("id").alias("page_id"), F.lit("X").alias("code"))
    assert [tuple(r) for r in plugins.site_findings(many, plugins.Prevalent, {"share": 0.5, "least": 3}).collect()] == [("h", "SITE-X", "error", "X on most pages", 500)]


def test_words_of_pages(spark):
    page = "<STYLE>p{}</style>Häuser, a I'm <!-- no -->x1<b>y2</b> é <script>never closed"
    assert spark.range(1).select(rendering.words(F.lit(page)).alias("w")).first().w == ["häuser", "im", "x1", "y2", "é"]


@pytest.mark.parametrize("seed", range(20))
def test_a_text_with_parts_taken_out_loses_no_word(seed):
    rng = random.Random(seed)
    b = [rng.choice("abcd") for _ in range(rng.randrange(1, 120))]  # every word often: no anchors
    a = [x for x in b if rng.random() < 0.5]
    assert len(aligned(a, b)) == len(a) and len(aligned(b, a)) == len(a)
    c = [rng.choice("abcde") for _ in range(60)]
    for pairs in (rendering.longest(c, b), rendering.longest(c, b, room=40)):
        assert len(pairs) == longest(c, b) and all(c[i] == b[j] for i, j in pairs)
        assert all(i < k and j < m for (i, j), (k, m) in zip(pairs, pairs[1:]))
