"""The URL frontier as batch operations: scope, first sight, order, partitions, retries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import graph, html
from ..functions import urls
from ..plans.scratch import cut
from ..registry import query, table

# Failures that no retry can mend.
FATAL = "gone permanent_dns ssrf_denied malformed deserialization".split()


def domain_matches(host: Column, pattern: str) -> Column:
    """``*.example.com`` takes the domain and all below it; else the host itself."""
    if pattern.startswith("*."):
        return (host == pattern[2:]) | host.endswith("." + pattern[2:])
    return host == pattern


def in_scope(url: Column, allow: list[str], block: list[str] = (), prefixes: list[str] = (), block_prefixes: list[str] = ()) -> Column:
    """Blocked domains and paths first, then allowed ones; empty lists allow all."""
    host, path = urls.host(url), urls.path(url)
    either = lambda xs: reduce(Column.__or__, xs, F.lit(False))
    out = ~either([domain_matches(host, p) for p in block]) & ~either([path.startswith(p) for p in block_prefixes])
    if allow:
        out = out & either([domain_matches(host, p) for p in allow])
    if prefixes:
        out = out & either([path.startswith(p) for p in prefixes])
    return out


def first_sight(found: DataFrame) -> DataFrame:
    """``found`` (url, priority, seq): each URL once, as first seen; lower priority values come first, then URLs."""
    first = found.groupBy("url").agg(F.min_by(F.struct("priority", "seq"), "seq").alias("f"))
    return first.select("url", "f.priority", "f.seq")


def pop_order(found: DataFrame) -> DataFrame:
    """``first_sight`` of ``found`` with position: the place of each URL in the order of priority and URL, from 1.

    Rows are sorted by range and numbered within a partition; only the partitions' counts meet in one place.
    """
    # written, so that the sort and the counts see the same rows
    rows = cut(first_sight(found).repartitionByRange("priority", "url").withColumn("part", F.spark_partition_id()))
    sizes = rows.groupBy("part").agg(F.count("*").alias("size"))
    before = sizes.select("part", (F.sum("size").over(Window.orderBy("part")) - F.col("size")).alias("before"))
    place = F.row_number().over(Window.partitionBy("part").orderBy("priority", "url"))
    return rows.withColumn("place", place).join(F.broadcast(before), "part").select("url", "priority", "seq", (F.col("before") + F.col("place")).alias("position"))


def failure_class(kind: Column) -> Column:
    return F.when(kind.isin(*FATAL), "fatal").otherwise("transient")


def after_failures(attempts: DataFrame, most: int = 3) -> DataFrame:
    """``attempts`` (url, at, kind: null for success): the state each URL ends in: done, retry or dead."""
    order = Window.partitionBy("url").orderBy("at")
    last = attempts.withColumn("n", F.row_number().over(order)).groupBy("url").agg(F.max_by("kind", "at").alias("kind"), F.max("n").alias("attempts"))
    state = F.when(F.col("kind").isNull(), "done").when((failure_class(F.col("kind")) == "fatal") | (F.col("attempts") >= most), "dead").otherwise("retry")
    return last.select("url", "attempts", state.alias("state"))


_L = f"WITH {html.SQL}"


def _found(spark, sf_dir: str) -> DataFrame:
    return graph.of(spark, sf_dir).select(F.col("target_url").alias("url"), (F.length(urls.path(F.col("target_url"))) % 3).alias("priority"), F.col("page_id").alias("seq"))


@query("scope_filter", f"{_L} SELECT DISTINCT target_url FROM links WHERE ({html._host('target_url')} = 'example.com' OR ends_with({html._host('target_url')}, '.example.com')) AND NOT starts_with({html._pathsql('target_url')}, '/en/9')")
def scope_filter(spark, sf_dir):
    rows = graph.of(spark, sf_dir).select("target_url").distinct()
    return rows.where(in_scope(F.col("target_url"), ["*.example.com"], block_prefixes=["/en/9"]))


@query("frontier_order", f"{_L}, f AS (SELECT target_url AS url, length({html._pathsql('target_url')}) % 3 AS priority, min(page_id) AS seq FROM links GROUP BY ALL) SELECT url, priority, seq, row_number() OVER (ORDER BY priority, url) AS position FROM f")
def frontier_order(spark, sf_dir):
    """Every URL with its place in the pop order, from 1."""
    return pop_order(_found(spark, sf_dir))


@query("discovered_links", f"{_L} SELECT DISTINCT target_url FROM links WHERE NOT is_external AND target_url NOT IN (SELECT url FROM pages)")
def discovered_links(spark, sf_dir):
    """Internal links to URLs that were not visited."""
    visited = table(spark, sf_dir, "pages").select(F.col("url").alias("target_url"))
    return graph.of(spark, sf_dir).where("NOT is_external").select("target_url").distinct().join(visited, "target_url", "left_anti")


_KINDS = "CASE event_id % 5 WHEN 0 THEN NULL WHEN 1 THEN 'timeout' WHEN 2 THEN 'gone' ELSE 'server_error' END"


def _outcomes(events: DataFrame) -> DataFrame:
    rows = events.select((F.col("user_id") % 300).alias("url"), F.col("event_id").alias("at"), F.expr(_KINDS).alias("kind"))
    return after_failures(rows, 30).select("url", F.col("attempts").cast("long").alias("attempts"), "state")


@query("lease_outcomes", f"WITH a AS (SELECT user_id % 300 AS url, event_id AS tick, {_KINDS} AS kind FROM events), l AS (SELECT url, count(*) AS attempts, list(kind ORDER BY tick)[-1] AS kind FROM a GROUP BY url) SELECT url, attempts, CASE WHEN kind IS NULL THEN 'done' WHEN kind IN ('gone') OR attempts >= 30 THEN 'dead' ELSE 'retry' END AS state FROM l")
def lease_outcomes(spark, sf_dir):
    return _outcomes(table(spark, sf_dir, "events"))


def expired(leases: DataFrame, ttl: int) -> DataFrame:
    """``leases`` (url, since, acked: when it was acknowledged, or null) that ran out before ``ttl`` seconds had brought an answer, as of the last time seen."""
    now = leases.agg(F.max(F.greatest("since", F.coalesce("acked", "since"))).alias("now"))
    ends = F.col("since") + F.make_dt_interval(secs=F.lit(ttl))
    return leases.crossJoin(F.broadcast(now)).where(F.coalesce("acked", "now") > ends).select("url", "since", ends.alias("expired"))


@query("expired_leases", "WITH l AS (SELECT event_id AS url, ts AS since, CASE WHEN event_id % 3 = 0 THEN NULL ELSE ts + INTERVAL (event_id % 90) SECOND END AS acked FROM events), n AS (SELECT max(greatest(since, coalesce(acked, since))) AS now FROM l) SELECT url, since, since + INTERVAL 60 SECOND AS expired FROM l, n WHERE coalesce(acked, now) > since + INTERVAL 60 SECOND")
def expired_leases(spark, sf_dir):
    """Leases to be given out again: each event leases a URL, a third are never acknowledged."""
    e = F.col("event_id")
    acked = F.when(e % 3 == 0, F.lit(None)).otherwise(F.col("ts") + F.make_dt_interval(secs=(e % 90)))
    return expired(table(spark, sf_dir, "events").select(e.alias("url"), F.col("ts").alias("since"), acked.alias("acked")), 60)


@query("not_modified", "SELECT p.page_id, md5(p.html) = q.etag AS unchanged FROM pages p JOIN (SELECT url, min(CASE WHEN page_id % 4 = 0 THEN 'other' ELSE md5(html) END) AS etag FROM pages GROUP BY url) q USING (url)")
def not_modified(spark, sf_dir):
    """Pages whose validator is that of the crawl before (made of the pages' contents, one in four another), so that they need no new fetch."""
    pages = table(spark, sf_dir, "pages")
    known = pages.groupBy("url").agg(F.min(F.when(F.col("page_id") % 4 == 0, "other").otherwise(F.md5(F.col("html").cast("binary")))).alias("etag"))
    return pages.join(known, "url").select("page_id", (F.md5(F.col("html").cast("binary")) == F.col("etag")).alias("unchanged"))


@query("render_budget", "SELECT page_id, row_number() OVER (PARTITION BY lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\\-]*://([^/?#:]+)', 1)) ORDER BY page_id) <= 5 AS granted FROM pages")
def render_budget(spark, sf_dir, quota=5):
    """The first pages of each host may be rendered, up to a quota."""
    order = Window.partitionBy(urls.host(F.col("url"))).orderBy("page_id")
    return table(spark, sf_dir, "pages").select("page_id", (F.row_number().over(order) <= quota).alias("granted"))


# Marks of pages that only scripts fill, root elements first, then frameworks.
SPA = ['id="app"', 'id="root"', 'id="__next"', 'id="__nuxt"', 'id="svelte"', "__NEXT_DATA__", "__NUXT__", "window.__SVELTEKIT", "React.createElement", "Vue.createApp", "angular"]


def render_decision(url: Column, page: Column, skip: list[str] = (), force: list[str] = ()) -> Column:
    """``render`` or ``skip`` with the reason: URL patterns first, then the first mark that the page has."""
    out = F
    for p in skip:
        out = out.when(url.contains(p), F.lit(f"skip: {p}"))
    for p in [*force]:
        out = out.when(url.contains(p), F.lit(f"render: {p}"))
    for m in SPA:
        out = out.when(page.contains(m), F.lit(f"render: {m}"))
    return out.otherwise("skip: no mark")


@query("render_decision", "SELECT page_id, CASE WHEN contains(url, '/de/') THEN 'skip: /de/' WHEN contains(url, '/es/') THEN 'render: /es/' " + " ".join(f"WHEN contains(html, '{m}') THEN 'render: {m}'" for m in SPA) + " ELSE 'skip: no mark' END AS decision FROM pages")
def render_decision_query(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", render_decision(F.col("url"), F.col("html"), ["/de/"], ["/es/"]).alias("decision"))


# Technologies by what shows them, in order: a response header's value, the generator tag, a part of the page, a cookie's name.
TECH = """
header | Nginx | web server | server | nginx
header | Apache | web server | server | apache
header | LiteSpeed | web server | server | litespeed
header | Microsoft IIS | web server | server | microsoft-iis
header | Cloudflare | CDN | server | cloudflare
header | PHP | language | x-powered-by | php
header | ASP.NET | framework | x-powered-by | asp.net
header | Express | framework | x-powered-by | express
header | Next.js | framework | x-powered-by | next.js
generator | WordPress | CMS | | wordpress
generator | Drupal | CMS | | drupal
generator | Joomla | CMS | | joomla
generator | Hugo | static site generator | | hugo
generator | Jekyll | static site generator | | jekyll
generator | Squarespace | CMS | | squarespace
generator | Webflow | CMS | | webflow
page | WordPress | CMS | | wp-content
page | WooCommerce | e-commerce | | /wp-content/plugins/woocommerce
page | Next.js | framework | | /_next/static
page | Nuxt | framework | | /_nuxt/
page | Shopify | e-commerce | | cdn.shopify.com
page | Google Tag Manager | analytics | | googletagmanager.com
page | Google Analytics | analytics | | google-analytics.com
cookie | WordPress | CMS | | wp-
cookie | WooCommerce | e-commerce | | wp_woocommerce_session_
cookie | Shopify | e-commerce | | _shopify_
cookie | Cloudflare | CDN | | __cf_bm
cookie | Django | framework | | csrftoken
cookie | Laravel | framework | | laravel_session
"""


def technologies(pages: DataFrame) -> DataFrame:
    """``pages`` (page_id, html, headers: array of k, v): page_id, name, kind, confidence of each technology, by its first sign."""
    signs = [[x.strip() for x in line.split("|")] for line in TECH.strip().splitlines()]
    low = F.lower(F.coalesce("html", F.lit("")))
    generator = F.regexp_extract(low, r"<meta\b[^>]*\bname\s*=\s*[\"']generator[\"'][^>]*\bcontent\s*=\s*[\"']([^\"']*)", 1)
    heads = F.transform(F.coalesce("headers", F.array()), lambda h: F.struct(F.lower(h["k"]).alias("k"), F.lower(h["v"]).alias("v")))
    rows = pages.select("page_id", low.alias("low"), generator.alias("generator"), heads.alias("heads"))
    shows = {
        "header": lambda at, mark: F.exists("heads", lambda h: (h["k"] == at) & h["v"].contains(mark)),
        "generator": lambda at, mark: F.col("generator").contains(mark),
        "page": lambda at, mark: F.col("low").contains(mark),
        "cookie": lambda at, mark: F.exists("heads", lambda h: (h["k"] == "set-cookie") & F.ltrim(h["v"]).startswith(mark)),
    }
    names = list(dict.fromkeys(s[1] for s in signs))
    made = []
    for name in names:
        first = F
        for how, _, kind, at, mark in (s for s in signs if s[1] == name):
            first = first.when(shows[how](at, mark), F.struct(F.lit(name).alias("name"), F.lit(kind).alias("kind"), F.lit("medium" if how == "cookie" else "high").alias("confidence")))
        made.append(first)
    return rows.select("page_id", F.inline(F.array_compact(F.array(*made))))


_SERVERS = ["nginx/1.24", "Apache", "cloudflare", "gws"]


@query(
    "tech_detection",
    """WITH h AS (SELECT page_id, ['nginx/1.24', 'Apache', 'cloudflare', 'gws'][page_id % 4 + 1] AS server, CASE WHEN page_id % 6 = 0 THEN 'PHP/8.1' END AS powered, ['csrftoken=1; Path=/', 'sid=2', 'wp-settings=3'][page_id % 3 + 1] AS cookie, lower(coalesce(html, '')) AS low FROM pages)
    SELECT page_id, unnest(list_filter([
      CASE WHEN contains(server, 'nginx') THEN {'name': 'Nginx', 'kind': 'web server', 'confidence': 'high'} END, CASE WHEN contains(lower(server), 'apache') THEN {'name': 'Apache', 'kind': 'web server', 'confidence': 'high'} END,
      CASE WHEN server = 'cloudflare' THEN {'name': 'Cloudflare', 'kind': 'CDN', 'confidence': 'high'} END, CASE WHEN powered IS NOT NULL THEN {'name': 'PHP', 'kind': 'language', 'confidence': 'high'} END,
      CASE WHEN contains(low, 'wp-content') THEN {'name': 'WordPress', 'kind': 'CMS', 'confidence': 'high'} WHEN starts_with(cookie, 'wp-') THEN {'name': 'WordPress', 'kind': 'CMS', 'confidence': 'medium'} END,
      CASE WHEN contains(low, '/_next/static') THEN {'name': 'Next.js', 'kind': 'framework', 'confidence': 'high'} END, CASE WHEN contains(low, 'google-analytics.com') THEN {'name': 'Google Analytics', 'kind': 'analytics', 'confidence': 'high'} END,
      CASE WHEN starts_with(cookie, 'csrftoken') THEN {'name': 'Django', 'kind': 'framework', 'confidence': 'medium'} END], lambda x: x IS NOT NULL), max_depth := 2) FROM h""",
)
def tech_detection(spark, sf_dir):
    """Technologies of pages; their response headers are made of the pages' numbers, as the table has none."""
    p, pair = F.col("page_id"), lambda k, v: F.struct(F.lit(k).alias("k"), v.alias("v"))
    headers = F.array(
        pair("Server", F.element_at(F.array(*[F.lit(x) for x in _SERVERS]), (p % 4 + 1).cast("int"))),
        pair("X-Powered-By", F.when(p % 6 == 0, "PHP/8.1")),
        pair("Set-Cookie", F.element_at(F.array(F.lit("csrftoken=1; Path=/"), F.lit("sid=2"), F.lit("wp-settings=3")), (p % 3 + 1).cast("int"))),
    )
    return technologies(table(spark, sf_dir, "pages").select("page_id", "html", headers.alias("headers")))


@query("crux_join", "SELECT p.page_id, c.lcp FROM pages p JOIN (SELECT DISTINCT regexp_extract(url, '^[a-z]+://[^/?#]+', 0) AS origin, length(regexp_extract(url, '^[a-z]+://[^/?#]+', 0)) * 100 AS lcp FROM pages) c ON c.origin = regexp_extract(p.url, '^[a-z]+://[^/?#]+', 0)")
def crux_join(spark, sf_dir):
    """Field data by origin joined to its pages; one figure for each origin stands for the data."""
    pages = table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", "^[a-z]+://[^/?#]+", 0).alias("origin"))
    field = pages.select("origin", (F.length("origin") * 100).cast("long").alias("lcp")).distinct()
    return pages.join(field, "origin").select("page_id", "lcp")


def category_scores(reports: DataFrame) -> DataFrame:
    """``reports`` (report, json): report, category, score, severity of each category: under 0.5 an error, under 0.9 a warning."""
    parsed = reports.select("report", F.from_json("json", "categories map<string, struct<score: double>>").alias("j"))
    each = parsed.select("report", F.explode("j.categories").alias("category", "v")).select("report", "category", F.col("v.score").alias("score"))
    return each.withColumn("severity", F.when(F.col("score") < 0.5, "error").when(F.col("score") < 0.9, "warning").otherwise("info"))


@query(
    "lighthouse_ingest",
    """WITH v AS (SELECT page_id AS report, unnest(['performance', 'seo']) AS category, unnest([page_id % 100 / 100.0, (100 - page_id % 30) / 100.0])::DOUBLE AS score FROM pages WHERE page_id % 6 <> 0)
    SELECT *, CASE WHEN score < 0.5 THEN 'error' WHEN score < 0.9 THEN 'warning' ELSE 'info' END AS severity FROM v""",
)
def lighthouse_ingest(spark, sf_dir):
    """Category scores of an audit report of every page; the reports are made of the pages' numbers, and one in six is empty."""
    p = F.col("page_id")
    score = lambda x: F.struct((x / 100.0).alias("score"))
    made = F.to_json(F.struct(F.create_map(F.lit("performance"), score(p % 100), F.lit("seo"), score(100 - p % 30)).alias("categories")))
    return category_scores(table(spark, sf_dir, "pages").select(p.alias("report"), F.when(p % 6 == 0, "{}").otherwise(made).alias("json")))


# Audits, their metrics and the bounds of good and poor values.
AUDITS = [("largest-contentful-paint", "cwv:lcp", 2500.0, 4000.0), ("cumulative-layout-shift", "cwv:cls", 0.1, 0.25), ("total-blocking-time", "cwv:tbt", 200.0, 600.0), ("server-response-time", "cwv:ttfb", 800.0, 1800.0)]


def audit_metrics(reports: DataFrame) -> DataFrame:
    """``reports`` (report, json): metric, value and severity of each known audit: over the poor bound an error, over the good one a warning, else info; reports without audits give nothing."""
    parsed = reports.select("report", F.from_json("json", "audits map<string, struct<numericValue: double>>")["audits"].alias("a"))
    each = [F.struct(F.lit(m).alias("metric"), F.col("a")[audit]["numericValue"].alias("value"), F.lit(good).alias("good"), F.lit(poor).alias("poor")) for audit, m, good, poor in AUDITS]
    rows = parsed.select("report", F.inline(F.array(*each))).where("value IS NOT NULL")
    return rows.select("report", "metric", "value", F.when(F.col("value") > F.col("poor"), "error").when(F.col("value") > F.col("good"), "warning").otherwise("info").alias("severity"))


@query(
    "lighthouse_metrics",
    """WITH v AS (SELECT event_id AS report, unnest([{'metric': 'cwv:lcp', 'value': CAST(event_id * 7 % 6000 AS DOUBLE), 'good': 2500.0, 'poor': 4000.0}, {'metric': 'cwv:cls', 'value': event_id % 40 / 100.0, 'good': 0.1, 'poor': 0.25}, {'metric': 'cwv:tbt', 'value': CAST(event_id % 900 AS DOUBLE), 'good': 200.0, 'poor': 600.0}], max_depth := 2) FROM events WHERE event_id % 5 <> 0)
    SELECT report, metric, round(value, 6) AS value, CASE WHEN value > CAST(poor AS DOUBLE) THEN 'error' WHEN value > CAST(good AS DOUBLE) THEN 'warning' ELSE 'info' END AS severity FROM v""",
)
def lighthouse_metrics(spark, sf_dir):
    """Audit reports made of events; one in five has no audits."""
    e = F.col("event_id")
    number = lambda v: F.struct(v.cast("double").alias("numericValue"))
    audits = F.create_map(F.lit("largest-contentful-paint"), number(e * 7 % 6000), F.lit("cumulative-layout-shift"), number((e % 40) / 100.0), F.lit("total-blocking-time"), number(e % 900), F.lit("other"), number(e))
    report = F.when(e % 5 == 0, "{}").otherwise(F.to_json(F.struct(audits.alias("audits"))))
    return audit_metrics(table(spark, sf_dir, "events").select(e.alias("report"), report.alias("json"))).withColumn("value", F.round("value", 6))
