"""Each query against its SQL in DuckDB, at the smallest size; folds and small functions by hand."""

import math
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from sitelode import findings, graph, html, registry, site, text
from sitelode.functions import urls
from sitelode.operators import frontier, sinks
from sitelode.rules.catalogue import RULES, WEIGHTS
from sitelode.streaming.limits import Breaker, FirstEventWindow, Gcra, SlidingBudget

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    return v


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_matches_sql(spark, duck, name):
    df = registry.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    found = duck.sql(registry.ORACLE_SQL[name])
    assert sorted(found.columns) == columns
    place = [found.columns.index(c) for c in columns]
    want = sorted(repr([plain(r[i]) for i in place]) for r in found.fetchall())
    got = sorted(repr([plain(r[c]) for c in columns]) for r in df.collect())
    assert got == want


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE_SQL)))
def test_query_without_sql_has_rows(spark, name):
    assert registry.QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_rules_are_well_formed():
    assert len({r.code for r in RULES}) == len(RULES)
    assert all(0 < w <= 1 for _, _, w in WEIGHTS)


PAGE = """<!doctype html><html lang="en"><head><title> A &amp; B </title><meta name="description" content="x">
<meta property="og:title" content="O"><link rel="canonical" href="https://h.example/c"></head><body><main><h1>One</h1><h3>Three</h3>
<!-- <h1>no</h1> --><script>var a = "<h1>no</h1>";</script><a href="/p" rel="NoFollow">in</a> <a href='https://other.example/'><img src=a></a>
<img src="b" alt=""><p>Two words. More!</p></main></body></html>"""


def test_page_record(spark):
    rows = spark.createDataFrame([(1, "https://h.example/d/e?x=1#f", PAGE), (2, "https://h.example", None)], "page_id long, url string, html string")
    one, two = html.page_facts(rows).orderBy("page_id").collect()
    assert (one.title, one.description, one.canonical, one.lang) == ("A &amp; B", "x", "https://h.example/c", "en")
    assert (one.h1_count, one.heading_count, one.skips_level, one.has_main) == (1, 2, True, True)
    assert (one.link_count, one.external_links, one.nofollow_links, one.image_count, one.images_missing_alt, one.images_empty_alt) == (2, 1, 1, 2, 1, 1)
    assert one.sentence_count == 2 and two.word_count == 0 and two.title is None


@pytest.mark.parametrize(
    "base, href, want",
    [
        ("https://h.example/a/b?q#f", "c", "https://h.example/a/c"),
        ("https://h.example/a/b", "/c", "https://h.example/c"),
        ("https://h.example", "c", "https://h.example/c"),
        ("https://h.example/a", "//o.example/x", "https://o.example/x"),
        ("https://h.example/a", "#z", "https://h.example/a#z"),
        ("https://h.example/a?b", "?c", "https://h.example/a?c"),
        ("https://h.example/a", "mailto:x@y", "mailto:x@y"),
    ],
)
def test_join_urls(spark, base, href, want):
    assert spark.range(1).select(urls.join(F.lit(base), F.lit(href))).first()[0] == want


def test_identity_of_urls(spark):
    same = [("HTTP://H.example:80/a/", "http://h.example/a"), ("https://h.example", "https://h.example:443/")]
    other = [("http://h.example/a", "https://h.example/a"), ("http://h.example/A", "http://h.example/a"), ("http://h.example/a?x", "http://h.example/a")]
    for pairs, want in ((same, True), (other, False)):
        rows = spark.createDataFrame(pairs, "a string, b string")
        assert all(r[0] is want for r in rows.select(urls.identity(F.col("a")) == urls.identity(F.col("b"))).collect())


def test_signatures(spark):
    for a, b in (("Article schema missing headline", "Article missing headline"), ("CSP allows inline (deep)", "csp allows inline (deep-deep) V2"), ("Dead link", "dead link")):
        r = spark.range(1).select(findings.signature(F.lit(a)), findings.signature(F.lit(b))).first()
        assert r[0] == r[1]


def test_collapse_keeps_the_strictest_and_repeats(spark):
    rows = [(1, "u", 0, "B1", "warning"), (1, "u", 1, "A1", "info"), (1, "u", 2, "A1", "info"), (1, "u", 3, "C1", "error"), (2, "u2", 0, "A1", "info")]
    df = spark.createDataFrame([(*r, "seo", "Same defect", False) for r in rows], "page_id long, url string, seq int, code string, severity string, category string, title string, is_metric boolean")
    got = sorted((r.page_id, r.code, r.also) for r in findings.collapse(df).collect())
    assert got == [(1, "A1", "B1,C1"), (1, "C1", "A1,B1"), (2, "A1", "")]


def test_weights_take_the_most_specific(spark):
    codes = spark.createDataFrame([("METADESC001",), ("META001",), ("CSP1",), ("ZZZ",)], "code string")
    got = {r.code: r.weight for r in findings.weights(codes).collect()}
    assert got == {"METADESC001": 0.08, "META001": 0.05, "CSP1": 0.15, "ZZZ": 0.02}


def test_limits():
    s = SlidingBudget(2, 10)
    assert [s(t) for t in (0, 1, 2, 9.9, 10, 10.5, 11)] == [True, True, False, False, True, False, True]
    w = FirstEventWindow(2, 10)
    assert [w(t) for t in (5, 6, 7, 14.9, 15, 16)] == [True, True, False, False, True, True]
    g = Gcra(1.0, 2)
    assert [g(t) for t in (0, 0, 0, 1, 1)] == [True, True, False, True, False]
    b = Breaker(2, 10, 1)
    assert [b(t, ok) for t, ok in ((0, False), (1, False), (2, True), (11, True))] == ["closed", "open", "open", "closed"]


def test_contracts(spark):
    assert sinks.ddl("findings", "bigquery").splitlines()[1] == "page_id STRING NOT NULL,"
    with pytest.raises(ValueError, match="needs url"):
        sinks.conform(spark.createDataFrame([("c", 1)], "crawl_id string, page_id long"), "pages")


def test_streams(spark, tmp_path):
    from sitelode.streaming.limits import sliding_stream, usage_stream

    src = spark.read.parquet(f"{SF}/events.parquet").limit(300).select("event_id", (F.col("user_id") % 3).alias("key"), F.col("ts").cast("timestamp").alias("ts"), "event_type").coalesce(1)
    src.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(src.schema).parquet(f"{tmp_path}/in")
    for name, df, mode in (("sliding", sliding_stream(stream, 5, 3600), "append"), ("usage", usage_stream(stream), "append")):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", f"{tmp_path}/{name}").trigger(availableNow=True).start()
        q.awaitTermination(120)
        rows = spark.table(name).collect()
        assert rows
        if name == "sliding":
            want, each = {}, {}
            for r in sorted(src.collect(), key=lambda r: (r.ts, r.event_id)):
                want[r.event_id] = each.setdefault(r.key, SlidingBudget(5, 3600))(r.ts.timestamp())
            assert {r.event_id: r.allowed for r in rows} == want


def test_folds_see_each_key_in_order(spark):
    from sitelode.streaming.limits import folded

    rows = [(i, i % 3, float(i * 7 % 50), i % 4 != 0) for i in range(200)]
    df = spark.createDataFrame(rows, "event_id long, key long, at double, ok boolean").repartition(5)
    want, each = {}, {}
    for i, k, at, ok in sorted(rows, key=lambda r: (r[1], r[2], r[0])):
        want[i] = each.setdefault(k, Breaker(2, 10, 1))(at, ok)
    assert {r.event_id: r.state for r in folded(df, lambda: Breaker(2, 10, 1), "state", "string", True).collect()} == want


def test_depths_reach_the_end_of_a_long_chain(spark):
    e = spark.createDataFrame([(f"u{i}", f"u{i + 1}") for i in range(12)] + [("u12", "u0"), ("u3", "u1"), ("x", "y")], "src string, dst string")
    found = graph.depths(e, spark.createDataFrame([("u0",)], "url string"))
    assert sorted(map(tuple, found.collect())) == sorted((f"u{i}", i) for i in range(13))


def test_bfs_depth_goes_deeper_than_eight_clicks(spark, tmp_path):
    url = lambda i: f"http://a.example/p{i}"
    pages = [(i, url(i), f'<html><body><a href="{url(i + 1)}">next</a></body></html>') for i in range(10)]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    assert {r.url: r.depth for r in graph.bfs_depth(spark, str(tmp_path)).collect()} == {url(i): i for i in range(11)}


def test_pop_order_has_every_url(spark):
    rows = [(f"u{(i * 7919) % 1000:03}", (i * 7919) % 1000 % 3, i) for i in range(1000)] + [("u005", 0, 5000)]
    out = frontier.pop_order(spark.createDataFrame(rows, "url string, priority int, seq long")).collect()
    want = sorted((p, u) for u, p, _ in rows[:1000])
    assert [(r.priority, r.url) for r in sorted(out, key=lambda r: r.position)] == want
    assert sorted(r.position for r in out) == list(range(1, 1001))


def test_cooccurrence_has_all_pairs(spark):
    docs = spark.createDataFrame([(1, "apple apple pear plum grape"), (2, None)], "doc_id long, text string")
    want = {("apple", "apple", 1), ("apple", "pear", 2), ("apple", "plum", 2), ("apple", "grape", 1), ("pear", "plum", 1), ("grape", "pear", 1), ("grape", "plum", 1)}
    assert set(map(tuple, text.cooccurring(docs).collect())) == want


def test_lease_outcomes_count_every_event(spark):
    total = spark.read.parquet(f"{SF}/events.parquet").count()
    assert frontier.lease_outcomes(spark, SF).agg(F.sum("attempts")).first()[0] == total


def test_near_classes_lose_no_pair_and_expand_no_copies(spark):
    import itertools
    import random

    rng = random.Random(3)
    kinds = [[rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(1, 13))] for _ in range(25)]
    kinds += [k[1:] for k in kinds] + [[*k, "x"] for k in kinds] + [k + k[:1] for k in kinds]
    rows = [(i, rng.sample(k, len(k))) for i, k in enumerate(rng.choice(kinds) for _ in range(300))]
    out = site.near_classes(spark.createDataFrame(rows, "id long, words array<string>")).collect()
    of = {r.b: r.a for r in out if r.kind == "member"}
    links = {(r.a, r.b): r.similarity for r in out if r.kind == "link"}
    assert len(of) == sum(r.kind == "member" for r in out) and len(links) == sum(r.kind == "link" for r in out)
    got, want, used = {}, {}, set()
    for (i, x), (j, y) in itertools.combinations([r for r in rows if r[1]], 2):
        score = sum(w in y for w in x) / (len(x) * len(y)) ** 0.5
        if score > 0.9:
            want[i, j] = round(score, 6)
        if of[i] == of[j]:
            got[i, j] = 1.0
        elif (of[i], of[j]) in links:
            got[i, j] = links[of[i], of[j]]
            used.add((of[i], of[j]))
    assert got == pytest.approx(want) and used == set(links)
    copies = spark.createDataFrame([(i, ["same", "title"]) for i in range(500)], "id long, words array<string>")
    assert site.near_classes(copies).count() == 500


def _overlaps(rows, t):
    """All pairs by the rule itself: (a, b, similarity) with how often."""
    found = Counter()
    for i, x in rows:
        for j, y in rows:
            if i is not None and j is not None and i < j and x and y and sum(w in y for w in x) / (len(x) * len(y)) ** 0.5 > t:
                found[i, j, round(sum(w in y for w in x) / (len(x) * len(y)) ** 0.5, 6)] += 1
    return found


def test_near_candidates_are_few_beside_links(spark):
    import random

    rng = random.Random(5)
    words = [f"w{i}" for i in range(30)]
    kinds = [[w] * 12 + rng.sample(words, k) for w in words[:10] for k in range(3)] + [rng.sample(words, rng.randrange(8, 13)) for _ in range(500)]
    kinds += [[f"l{i}" for i in range(k, k + n)] for k in (0, 3) for n in (60, 66, 70, 120)] + [["l9"] * 90]
    rows = [(i, list(k)) for i, k in enumerate(dict.fromkeys(tuple(sorted(k)) for k in kinds))]
    texts = spark.createDataFrame([(-i, i, i, k) for i, k in rows], "k long, first long, last long, words array<string>")
    links = {(-r.ka, -r.kb, r.similarity) for r in site.near_links(texts).collect()}
    assert {k for k in links if k[0] < k[1]} == set(_overlaps(rows, 0.9))
    assert site.near_candidates(site.near_keys(texts)).count() < 2.5 * len(links)


def test_near_duplicates_give_every_pair(spark, monkeypatch):
    import random

    monkeypatch.setattr(site, "BLOCK", 8)  # classes of several blocks
    rng = random.Random(11)
    kinds = [rng.choices("abcdefgh", (9, 6, 4, 3, 2, 2, 1, 1), k=rng.randrange(1, 14)) for _ in range(60)] + [["a"] * 12, [f"l{i}" for i in range(70)]]
    kinds += [k[1:] for k in kinds] + [k + ["b"] for k in kinds]
    rows = [(i if i % 9 else i // 2, rng.sample(k, len(k))) for i, k in enumerate([*kinds, *rng.choices(kinds[:4], k=120)])]
    rows += [(None, ["a"]), (None, ["b", "a"]), (3, None), (4, []), (500, ["c", "a"]), (500, ["a", "c"])]
    out = site.near_duplicates(spark.createDataFrame(rows, "id long, words array<string>")).collect()
    assert Counter((r.a, r.b, r.similarity) for r in out) == _overlaps(rows, 0.9)


def test_near_duplicate_titles_are_pairs_of_pages(spark):
    out = registry.QUERIES["near_duplicate_titles"](spark, SF)
    copies = registry.QUERIES["duplicate_titles"](spark, SF).agg(F.sum(F.expr("n * (n - 1) div 2"))).first()[0]
    assert out.columns == ["a", "b", "similarity"] and out.where("a < b AND similarity = 1").count() >= copies > 0


def test_cooccurrence_counted_in_pieces_is_the_same(spark):
    docs = spark.createDataFrame([(i, f"apple pear{i % 3} plum apple Ünï-{i % 2}") for i in range(40)] + [(50, None), (51, "one")], "doc_id long, text string").repartition(3)
    whole, pieces = (sorted(map(tuple, text.cooccurring(docs, held=h).collect())) for h in (text.HELD, 1))
    assert whole == pieces and ("apple", "apple", 40) in whole and ("apple", "plum", 80) in whole
    plan = text.cooccurring(docs)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "Generate" not in plan  # pairs are counted before they are rows


def test_terms_are_shuffled_as_documents(spark, tmp_path):
    docs = [(1, "pear pear plum"), (1, "plum fig2 fig2"), (1, "pear"), (2, None), (3, "pear"), (None, "plum"), (None, "plum")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    terms = text._terms(spark, str(tmp_path))
    want = {(1, "pear", 3, 2), (1, "plum", 3, 2), (1, "fig2", 3, 2), (1, "pear", 1, 1), (3, "pear", 1, 1), (None, "plum", 1, 2)}
    assert sorted(map(str, map(tuple, terms.collect()))) == sorted(map(str, want))
    assert "HashAggregate" not in terms._jdf.queryExecution().executedPlan().toString()
