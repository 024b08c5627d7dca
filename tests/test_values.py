"""Operators on small inputs with known answers."""

import gzip
import zlib

import pytest
from pyspark.sql import functions as F

from sitelode import elements, findings, history, logs, search, site, text
from sitelode.functions import scalars
from sitelode.operators import frontier, sinks
from sitelode.rules import elements as element_rules
from sitelode.rules import headers
from sitelode.rules.families import families
from sitelode.sources import bodies, crawl_files
from sitelode.streaming.limits import Breaker, FirstEventWindow, Gcra, Gcras, SlidingBudget, folded_stream, within_daily

SF = "/root/testdata/sf0.001"


def one(spark, column):
    return spark.range(1).select(column).first()[0]


def test_people_organizations_and_places(spark):
    t = "A talk by Dr. Anna van Berg, not by others. CEO Max Muster-Mann! He met prof. But Prof. (Eva) Klein smiled. The First National Company moved to Green River. Old city"
    assert one(spark, text.people(F.lit(t))) == ["Anna van Berg", "But Prof Eva Klein", "Dr Anna van Berg", "Eva Klein", "Max Muster-Mann He"]
    assert one(spark, text.people(F.lit("mr smith"))) == [] and one(spark, text.people(F.lit(""))) == []
    assert one(spark, text.ended_by(F.lit(t), text.ORGANIZATIONS)) == ["First National Company"]
    assert one(spark, text.ended_by(F.lit(t), text.PLACES)) == ["Old city", "to Green River"]


def test_keywords_keep_letters_of_every_language(spark):
    assert one(spark, text.keyword_tokens(F.lit("Größe, naïve CAFÉ! 2024 the ab é1"))) == ["größe", "naïve", "café", "2024", "é1"]


@pytest.mark.parametrize("body, gone", [("Sorry, we couldn't find it", True), ("ERROR 404", True), ("This item has been removed.", True), ("All is found here", False)])
def test_soft_404(spark, body, gone):
    assert one(spark, text.soft_404(F.lit(body))) is gone


def test_sentiment_counts_all_words(spark, tmp_path):
    rows = [(1, "great! good day"), (2, "bad " * 3 + "x " * 97), (3, " "), (4, None), (5, "good " * 6 + "x " * 94)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.score, r.label) for r in text.sentiment(spark, str(tmp_path)).collect()}
    assert got == {1: (0.67, "positive"), 2: (-0.03, "neutral"), 3: (0.0, "neutral"), 4: (0.0, "neutral"), 5: (0.06, "positive")}


def test_families_join_titles_that_differ(spark):
    rows = [("A11Y006", "Missing main landmark", "warning"), ("LAND001", "Missing main landmark region", "error"), ("LANDMAIN001", "Page missing main landmark", "error"), ("X1", "Something else", "info")]
    df = spark.createDataFrame([(1, "u", k, c, s, "a", t, False) for k, (c, t, s) in enumerate(rows)], "page_id long, url string, seq int, code string, severity string, category string, title string, is_metric boolean")
    assert sorted((r.code, r.also) for r in findings.collapse(df).collect()) == [("LAND001", "A11Y006,LANDMAIN001"), ("X1", "")]
    assert len(families()) < 200


def test_header_rules_hit_and_stay_silent(spark):
    good = [
        ("Content-Security-Policy", "default-src 'self'; script-src 'self'; style-src 'self'; object-src 'none'; base-uri 'self'; form-action 'self'; frame-ancestors 'none'"),
        ("Strict-Transport-Security", "max-age=63072000; includeSubDomains; preload"), ("X-Frame-Options", "deny"), ("X-Content-Type-Options", "nosniff"), ("Referrer-Policy", "strict-origin"),
        ("Permissions-Policy", "camera=()"), ("Cross-Origin-Embedder-Policy", "require-corp"), ("Cross-Origin-Opener-Policy", "same-origin"), ("Cross-Origin-Resource-Policy", "same-origin"),
        ("Cache-Control", "max-age=1"), ("ETag", "x"), ("X-XSS-Protection", "1"), ("Set-Cookie", "a=b; Secure; HttpOnly; SameSite=Lax"),
    ]
    bad = [("content-security-policy", "script-src 'unsafe-inline' 'unsafe-eval'; connect-src *:*; font-src *.a.example"), ("strict-transport-security", "max-age=10; preload"), ("x-frame-options", "ALLOWALL"), ("Set-Cookie", "a"), ("set-cookie", "b; secure"), ("Access-Control-Allow-Origin", "*"), ("Access-Control-Allow-Credentials", "true"), ("Server", "nginx/1")]
    df = spark.createDataFrame([(1, "https://h/", good), (2, "https://h/", bad), (3, "http://h/", None)], "page_id long, url string, headers array<struct<k:string,v:string>>")
    got = {}
    for r in headers.header_findings(df).collect():
        got.setdefault(r.page_id, []).append(r.code)
    assert 1 not in got
    for code in "CSP001 CSPSSRC-V5002 CSPSS001 CSPDIR001 CSP002 CSPCON001 HSTS001 HSTS003 HSTSPRELOAD001 XFO002 SEC004 CORS001 SERVER001 SEC005".split():
        assert code in got[2], code
    assert "CSPFNT001" not in got[2] and got[2].count("COOKIE001") == 1 and got[2].count("COOKIE002") == 2
    assert {"SEC001", "SEC002", "XFOMISS-V6072"} <= set(got[3]) and not any(c.startswith("COOKIE") for c in got[3])
    codes = [c.code for c in headers.checks()]
    assert len(codes) == len(set(codes)) > 120


PAGE = """<html lang="en"><head><title>A title of a length that does</title><link rel="canonical" href="https://h.example/other#x"><link rel="alternate" hreflang="en" href="https://h.example/p">
<link rel="alternate" hreflang="EN" href="https://h.example/q"><script src="//cdn.example/a.js"></script></head><body><img src="a.png"><img src="b.png" alt="icon"><table><tr><td>1</td></tr></table>
<form><input name="a"><label for="i">L</label><input id="i"><label>M <input name="m"></label><input type="hidden"><input aria-label="z" required></form></body></html>"""
CLEAN = """<html lang="en"><head><title>A title of a length that does</title><meta name="description" content="{}"><link rel="canonical" href="https://h.example/p"></head><body>
<img src="a.webp" alt="A river" width="1" height="2" loading="lazy"><table><caption>c</caption><tr><th>h</th></tr></table><form action="/x" aria-label="f"><label for="i">L</label><input id="i"></form></body></html>""".format("x" * 120)


def test_element_rules_hit_and_stay_silent(spark):
    df = spark.createDataFrame([(1, "https://h.example/p", PAGE), (2, "https://h.example/p", CLEAN), (3, "https://h.example/p", None)], "page_id long, url string, html string")
    facts = elements.element_facts(df)
    f = facts.where("page_id = 1").first()
    assert (f.images, f.images_no_alt, f.images_generic_alt, f.tables, f.tables_headed, f.forms, f.inputs_unlabeled, f.langs, f.langs_distinct, f.langs_self, f.scripts_blocking) == (2, 1, 1, 1, 0, 1, 1, 2, 1, 1, 1)
    got = {}
    for r in element_rules.element_findings(facts).collect():
        got.setdefault(r.page_id, set()).add(r.code)
    assert {"IMG001", "TBL-V2001", "FORM001", "FLABEL001", "SRI001", "HREF003", "HREF001", "CAN-V2001", "CANDEEP-V2005", "META-V3001", "SCRIPT-V2001"} <= got[1]
    assert not got[2] & {c for c, *_ in element_rules.rules() if c.startswith(("IMG", "TBL", "TAB", "FORM", "FLABEL", "SRI", "CAN", "META", "SCRIPT"))} - {"FORMLBLDEEP001"}
    assert "TITLEMISS001" in got[3]
    assert len({c for c, *_ in element_rules.rules()}) == len(element_rules.rules()) > 100


def test_redirects_and_robots(spark):
    hops = [(1, 0, "http://a/1", "https://a/1", 302), (2, 0, "https://a/1", "https://a/2", 301), (2, 1, "https://a/2", "https://a/1", 301), (3, 0, "https://a/1", "http://a/1", 301)]
    df = spark.createDataFrame(hops, "chain long, seq int, from string, to string, status int")
    got = {}
    for r in crawl_files.redirect_findings(df).collect():
        got.setdefault(r.chain, set()).add(r.code)
    assert got == {1: {"REDIR003", "REDIR004", "MIXPROT001"}, 2: {"REDIR002", "REDIRLOOP001"}, 3: {"REDIR003", "REDIR004", "MIXPROT-V2002"}}
    files = spark.createDataFrame([("a", "User-agent: GPTBot\nDisallow: /\n"), ("b", "User-agent: *\nDisallow: /\nDisallow:\n"), ("c", "User-agent: gptbot\n\nDisallow: /\n"), ("d", None)], "host string, content string")
    assert [tuple(r) for r in crawl_files.blanket_blocks(files, ["GPTBot", "ClaudeBot"]).collect()] == [("a", "GPTBot")]


def test_bodies():
    raw = b"hello " * 100
    bare = zlib.compressobj(wbits=-15)
    assert bodies.undone(gzip.compress(raw), "GZIP") == bodies.undone(zlib.compress(raw), "deflate") == bodies.undone(bare.compress(raw) + bare.flush(), "deflate") == raw
    assert bodies.undone(raw, None) == raw and bodies.undone(raw, "br") is None and bodies.undone(gzip.compress(raw)[:-9], "gzip") is None and bodies.undone(None, "gzip") is None


def test_hmac_and_marks(spark):
    import hashlib
    import json
    import hmac

    assert one(spark, scalars.hmac_sha256("k" * 80, F.lit("päyload"))) == hmac.new(b"k" * 80, "päyload".encode(), hashlib.sha256).hexdigest()
    assert one(spark, scalars.marked_types(F.lit('<div itemtype="http://s/A http://s/B"><p itemtype="C">'), "itemtype")) == ["http://s/A", "http://s/B", "C"]
    nested = '{"b": [1, {"z": null, "y": "ü\\""}], "a": {"d": true, "c": 2.5}, "": "x"}'
    assert one(spark, scalars.canonical_json(F.lit(nested))) == json.dumps(json.loads(nested), sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    assert one(spark, scalars.canonical_json(F.lit("{broken"))) is None


def test_gates_and_changes(spark):
    g = lambda **k: one(spark, history.gate(F.lit(5), F.lit(9), F.lit(70.0), **k))
    assert (g(), g(most_errors=5), g(most_errors=5, most_warnings=8), g(most_errors=5, least_score=80), g(most_errors=5, new_errors=1)) == (10, 0, 11, 12, 10)
    change = lambda a, b: one(spark, history.content_change(F.lit(a).cast("long"), F.lit(b).cast("long")))
    assert [change(*p) for p in ((100, 151), (100, 121), (100, 120), (0, 5), (None, 3), (None, None))] == ["critical", "warning", "info", "warning", "warning", "info"]
    assert one(spark, logs.status_change(F.lit(200), F.lit(404))) == "critical" and one(spark, logs.status_change(F.lit(301), F.lit(500))) == "warning"
    assert [logs.kept_entries(n, 100) for n in (5, 100, 101, 110, 111)] == [5, 100, 91, 100, 91]


def test_hosts_and_outlines(spark):
    rows = spark.createDataFrame([("k", 1, "https://other/x?u=www.site.example"), ("k", 2, "http://WWW.site.example./p"), ("k", 3, "https://site.example/q")], "keyword string, position int, url string")
    targets = spark.createDataFrame([("k", "site.example/zz"), ("k", "u=www"), ("k", "nothing"), ("m", "site.example")], "keyword string, target string")
    assert {(r.keyword, r.target): r.position for r in search.check_keywords(rows, targets).collect()} == {("k", "site.example/zz"): 2, ("k", "u=www"): 1, ("k", "nothing"): None, ("m", "site.example"): None}
    o = search.outline(spark.createDataFrame([("how to dry mint", "tutorial")], "query string, content_type string")).first()
    assert o.title == "How To Dry Mint: Complete Guide" and o.words == 1800 and [s.heading for s in o.sections] == ["Getting Started", "Step-by-Step Guide", "Safety Considerations"]


def test_technologies_by_first_sign(spark):
    page = '<meta name="generator" content="WordPress 6"><script src="/wp-content/a.js"></script>'
    df = spark.createDataFrame([(1, page, [("Server", "NGINX"), ("Set-Cookie", "wp-x=1"), ("set-cookie", "csrftoken=2")]), (2, "react jquery", None)], "page_id long, html string, headers array<struct<k:string,v:string>>")
    assert sorted((r.page_id, r.name, r.confidence) for r in frontier.technologies(df).collect()) == [(1, "Django", "medium"), (1, "Nginx", "high"), (1, "WordPress", "high")]


def test_cells_for_domains_and_all():
    limit = Gcras(1.0, 1, 1.0, 3, {"slow": 10.0})
    assert [limit(0, "a"), limit(0, "a"), limit(0, "b"), limit(0, "slow"), limit(0, "c")] == [True, False, True, True, False]
    assert limit(5, "slow") is False and limit(10, "slow") is True and limit.cell("a").slack == 0


def test_daily_budget_numbers_the_edge_only(spark):
    from datetime import datetime, timedelta

    t0 = datetime(2024, 1, 1)
    rows = [(i, t0 + timedelta(seconds=i * 7919 % 172800)) for i in range(600)]
    df = spark.createDataFrame(rows, "event_id long, ts timestamp_ntz")
    want, n = {}, {}
    for i, t in sorted(rows, key=lambda r: (r[1], r[0])):
        n[t.date()] = n.get(t.date(), 0) + 1
        want[i] = n[t.date()] <= 100
    assert {r.event_id: r.allowed for r in within_daily(df, 100).collect()} == want


@pytest.mark.parametrize("make, out, kind, outcome", [(lambda: SlidingBudget(5, 3600), "allowed", "boolean", False), (lambda: FirstEventWindow(3, 3600), "allowed", "boolean", False), (lambda: Gcra(0.001, 3), "allowed", "boolean", False), (lambda: Breaker(2, 3600, 2), "state", "string", True)])
def test_folds_on_a_stream(spark, tmp_path, make, out, kind, outcome):
    src = spark.read.parquet(f"{SF}/events.parquet").limit(200).select("event_id", (F.col("user_id") % 3).alias("key"), F.col("ts").cast("timestamp").alias("ts"), (F.col("event_id") % 3 != 0).alias("ok")).coalesce(1)
    ordered = sorted(src.collect(), key=lambda r: (r.ts, r.event_id))
    for k in (0, 100):  # two files, two micro-batches: state is packed and unpacked between them
        spark.createDataFrame(ordered[k : k + 100], src.schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(src.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    name = f"fold_{out}_{id(make) % 100000}"
    q = folded_stream(stream, make, out, kind, outcome).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    q.awaitTermination(120)
    want, each = {}, {}
    for r in ordered:
        fold = each.setdefault(r.key, make())
        want[r.event_id] = fold(r.ts.timestamp(), r.ok) if outcome else fold(r.ts.timestamp())
    assert {r.event_id: r[out] for r in spark.table(name).collect()} == want


def test_export_layouts():
    assert sinks.layout("c", "s3")[0] == ("exports/c/crawl_runs.parquet", "parquet-table", "crawl_runs") and len(sinks.layout("c", "bigquery")) == 4
    assert len(sinks.CONTRACTS["pages"]) == 28 and "fetched_at TIMESTAMP NOT NULL" in sinks.ddl("pages", "bigquery")


def test_www_and_apex(spark, tmp_path):
    link = lambda h: f'<html><body><a href="{h}">x</a></body></html>'
    rows = [(1, "https://a.example/", link("https://www.a.example/p")), (2, "https://www.b.example/", link("https://www.b.example/q")), (3, "https://c.example/", link("https://d.example/"))]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    assert [tuple(r) for r in site.www_apex_mix(spark, str(tmp_path)).select("page_id", "base").collect()] == [(1, "a.example")]


def test_robots_groups(spark):
    files = [
        ("a.example", "User-agent: *\nDisallow: /private\nAllow: /private/open\n# note\nCrawl-delay: 2\n\nUser-agent: NewsBot\nUser-agent: OtherBot\nDisallow: /\n"),
        ("b.example", "User-agent: *\nDisallow:\n"),
        ("c.example", "Sitemap: https://c.example/s.xml\nno colon line\nUser-agent: tool\nAllow: /x\nDisallow: /x\n"),
    ]
    asked = [("a.example", "Any/1.0", "/private/a", True), ("a.example", "Any/1.0", "/private/open/b", False), ("a.example", "NewsBot/2", "/", True), ("a.example", "OtherBot", "/z", True), ("b.example", "Any", "/q", False), ("c.example", "tool/1", "/x/1", False), ("d.example", "Any", "/", False)]
    rules = crawl_files.robots_rules(spark.createDataFrame(files, "host string, content string"))
    got = crawl_files.disallowed(rules, spark.createDataFrame([a[:3] for a in asked], "host string, agent string, path string"))
    assert sorted(map(tuple, got.collect())) == sorted(asked)
    assert {r.host: r.delay for r in rules.where("array_contains(agents, '*')").collect()} == {"a.example": 2.0, "b.example": None}


def test_sitemaps_and_results(spark):
    maps = [("s1", "<urlset><url><loc> https://a.example/1?x=1&amp;y=2 </loc><lastmod>2024-01-02</lastmod><priority>0.5</priority></url><url><loc>https://a.example/2</loc><changefreq>daily</changefreq></url><url></url></urlset>"), ("s2", "<sitemapindex><sitemap><loc>https://a.example/s1.xml</loc></sitemap></sitemapindex>"), ("s3", None)]
    got = sorted(map(tuple, crawl_files.sitemap_urls(spark.createDataFrame(maps, "location string, xml string")).collect()))
    assert got == [("s1", "url", "https://a.example/1?x=1&y=2", "2024-01-02", None, 0.5), ("s1", "url", "https://a.example/2", None, "daily", None), ("s2", "sitemap", "https://a.example/s1.xml", None, None, None)]
    page = '<a class="result__a" href="//x.example/l/?uddg=https%3A%2F%2Fa.example%2F1&r=2">One <b>b</b></a><p></p><a rel="n" class="result__a" href="https://b.example/2">Two</a>'
    assert [tuple(r) for r in crawl_files.search_results(spark.createDataFrame([("q", page)], "query string, html string")).collect()] == [("q", 1, "https://a.example/1", "One b"), ("q", 2, "https://b.example/2", "Two")]


def test_each_list_of_tags_is_found_once(spark):
    from sitelode import elements

    facts = elements.element_facts(spark.createDataFrame([(1, "http://h/", "<img src='a.webp'><form><input></form>")], "page_id long, url string, html string"))
    most = spark.conf.get("spark.sql.debug.maxToStringFields")
    spark.conf.set("spark.sql.debug.maxToStringFields", "10000")
    plan = facts._jdf.queryExecution().optimizedPlan().toString()
    spark.conf.set("spark.sql.debug.maxToStringFields", most)
    assert ["regexp_extract_all(c#" in plan, *[plan.count(f"(?is){tag}\\b[^>]*>, 0)") for tag in ("<img", "<script")]] == [True, 1, 1]
