"""robots.txt and sitemaps as tables, one row for each line or URL, with built-in functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import html
from ..functions import urls
from ..registry import query, table


def robots_rules(files: DataFrame) -> DataFrame:
    """``files`` (host, content) as host, grp, agents, rules (array of path, allow), delay.

    Neighbouring user-agent lines share the rules that follow; comments and unknown keys are skipped; an
    empty path rules nothing.
    """
    lines = files.select("host", F.posexplode(F.split("content", r"\r?\n")).alias("at", "raw")).withColumn("line", F.trim(F.regexp_replace("raw", "#.*$", "")))
    kv = lines.where(F.col("line").contains(":")).select("host", "at", F.lower(F.trim(F.substring_index("line", ":", 1))).alias("key"), F.trim(F.regexp_replace("line", "^[^:]*:", "")).alias("value"))
    kv = kv.where(F.col("key").isin("user-agent", "allow", "disallow", "crawl-delay"))
    order = Window.partitionBy("host").orderBy("at")
    starts = (F.col("key") == "user-agent") & (F.coalesce(F.lag("key").over(order), F.lit("")) != "user-agent")
    kv = kv.withColumn("grp", F.sum(F.when(starts, 1).otherwise(0)).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    rule = F.when(F.col("key").isin("allow", "disallow") & (F.col("value") != ""), F.struct(F.col("at"), F.col("value").alias("path"), (F.col("key") == "allow").alias("allow")))
    return kv.where("grp > 0").groupBy("host", "grp").agg(
        F.array_sort(F.collect_set(F.when(F.col("key") == "user-agent", F.lower("value")))).alias("agents"),
        F.array_sort(F.collect_list(rule)).alias("rules"),
        F.max(F.when(F.col("key") == "crawl-delay", F.col("value").try_cast("double"))).alias("delay"),
    )


def disallowed(rules: DataFrame, requests: DataFrame) -> DataFrame:
    """``requests`` (host, agent, path) with disallowed: by the most specific group, longest rule first, ties allow."""
    token = F.lower(F.substring_index(F.trim("agent"), " ", 1))
    agent = F.explode("agents").alias("group_agent")
    met = requests.withColumn("token", token).join(rules.select("host", "grp", "rules", agent), "host", "left")
    fits = (F.col("group_agent") == "*") | F.col("token").startswith(F.col("group_agent")) | F.col("group_agent").startswith(F.col("token"))
    best = met.where(fits).groupBy("host", "agent", "path").agg(F.max_by("rules", F.struct(F.length("group_agent"), F.col("grp"))).alias("rules"))
    hit = F.filter("rules", lambda r: F.col("path").startswith(r["path"]))
    verdict = F.element_at(F.array_sort(F.transform(hit, lambda r: F.struct((-F.length(r["path"])).alias("n"), (~r["allow"]).alias("no")))), 1)["no"]
    decided = best.select("host", "agent", "path", F.when(F.size(hit) > 0, verdict).otherwise(F.lit(False)).alias("no"))
    return requests.join(decided, ["host", "agent", "path"], "left").select("host", "agent", "path", F.coalesce("no", F.lit(False)).alias("disallowed"))


def _tag(xml: Column, name: str) -> Column:
    text = F.trim(F.regexp_extract(xml, rf"(?is)<{name}>\s*(.*?)\s*</{name}>", 1))
    for a, b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return F.nullif(text, F.lit(""))


def sitemap_urls(files: DataFrame) -> DataFrame:
    """``files`` (location, xml) as location, kind (url or sitemap), loc, lastmod, changefreq, priority."""
    each = lambda kind: files.select("location", F.lit(kind).alias("kind"), F.explode(F.regexp_extract_all("xml", F.lit(rf"(?is)<{kind}>(.*?)</{kind}>"), 1)).alias("x"))
    rows = each("url").unionByName(each("sitemap"))
    return rows.select("location", "kind", _tag(F.col("x"), "loc").alias("loc"), _tag(F.col("x"), "lastmod").alias("lastmod"), _tag(F.col("x"), "changefreq").alias("changefreq"), _tag(F.col("x"), "priority").try_cast("double").alias("priority")).where("loc IS NOT NULL")


def search_results(files: DataFrame) -> DataFrame:
    """``files`` (query, html) as query, rank (from 1), url, title: results in page order, redirects undone."""
    hits = F.regexp_extract_all("html", F.lit(r'(?is)<a\b[^>]*class="result__a"[^>]*>.*?</a>'), 0)
    rows = files.select("query", F.posexplode(hits).alias("at", "a"))
    href = F.regexp_extract("a", r'(?is)\bhref="([^"]*)"', 1)
    target = F.regexp_extract(href, r"[?&]uddg=([^&]*)", 1)
    return rows.select("query", (F.col("at") + 1).alias("rank"), F.when(target != "", F.url_decode(target)).otherwise(href).alias("url"), F.trim(F.regexp_replace("a", r"<[^>]*>", "")).alias("title"))


# --- files made of the crawled pages, as the tables have none --------------------------------------

#: Robots files, one for each host by the length of its name.
ROBOTS = [
    "User-agent: *\nDisallow: /en\nAllow: /en/1\nDisallow: /fr/2\n# note\nCrawl-delay: 2\n\nUser-agent: NewsBot\nUser-agent: OtherBot\nDisallow: /\n",
    "User-agent: *\nDisallow:\n",
    "Sitemap: https://c.example/s.xml\nno colon line\nUser-agent: newsbot\nAllow: /de\nDisallow: /de\nDisallow: /de/4\n",
]
AGENTS = ["Any/1.0", "NewsBot/2"]


def _located(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", "url", urls.host(F.col("url")).alias("host"), urls.path(F.col("url")).alias("path"))


@query(
    "robots_eval",
    f"""WITH {html.SQL}, r AS (SELECT DISTINCT host, path, agent FROM pf, (VALUES ('Any/1.0'), ('NewsBot/2')) t(agent))
    SELECT host, agent, path, CASE length(host) % 3 WHEN 0 THEN agent = 'NewsBot/2' OR (starts_with(path, '/en') AND NOT starts_with(path, '/en/1')) OR starts_with(path, '/fr/2')
      WHEN 1 THEN false ELSE agent = 'NewsBot/2' AND starts_with(path, '/de/4') END AS disallowed FROM r""",
)
def robots_eval(spark, sf_dir):
    """May two agents fetch the pages of every host, by a robots file for each?"""
    at = _located(spark, sf_dir)
    files = at.select("host").distinct().select("host", F.element_at(F.array(*[F.lit(x) for x in ROBOTS]), F.length("host") % 3 + 1).alias("content"))
    requests = at.select("host", F.explode(F.array(*[F.lit(a) for a in AGENTS])).alias("agent"), "path").distinct()
    return disallowed(robots_rules(files), requests)


_FOUND = "(host || '/s' || page_id // 1000 || '.xml')"


@query(
    "sitemap_parse",
    f"""WITH {html.SQL}, m AS (SELECT page_id, url, host, {_FOUND} AS location FROM pf)
    SELECT location, 'url' AS kind, url AS loc, CASE WHEN page_id % 3 = 0 THEN '2024-01-02' END AS lastmod, CASE WHEN page_id % 4 = 1 THEN 'daily' END AS changefreq, CASE WHEN page_id % 5 = 2 THEN 0.5::DOUBLE END AS priority FROM m
    UNION ALL SELECT DISTINCT host || '/index.xml', 'sitemap', 'https://' || location, NULL, NULL, NULL::DOUBLE FROM m""",
)
def sitemap_parse(spark, sf_dir):
    """Sitemaps of all hosts, a thousand page numbers each, and the indexes that name them."""
    p, esc = F.col("page_id"), lambda c: F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    at = _located(spark, sf_dir).withColumn("location", F.concat("host", F.lit("/s"), F.expr("page_id div 1000").cast("string"), F.lit(".xml")))
    entry = F.concat(F.lit("<url><loc> "), esc(F.col("url")), F.lit(" </loc>"), F.when(p % 3 == 0, "<lastmod>2024-01-02</lastmod>").otherwise(""), F.when(p % 4 == 1, "<changefreq>daily</changefreq>").otherwise(""), F.when(p % 5 == 2, "<priority>0.5</priority>").otherwise(""), F.lit("</url><url></url>"))
    maps = at.groupBy("location").agg(F.concat(F.lit("<urlset>"), F.array_join(F.collect_list(entry), ""), F.lit("</urlset>")).alias("xml"))
    named = at.select("host", "location").distinct().groupBy(F.concat("host", F.lit("/index.xml")).alias("location")).agg(F.concat(F.lit("<sitemapindex>"), F.array_join(F.collect_list(F.concat(F.lit("<sitemap><loc>https://"), "location", F.lit("</loc></sitemap>"))), ""), F.lit("</sitemapindex>")).alias("xml"))
    return sitemap_urls(maps.unionByName(named))


@query("serp_parse", "SELECT 'topic ' || page_id AS query, unnest([1, 2])::INTEGER AS rank, unnest([url, 'https://b.example/' || page_id]) AS url, unnest(['One b ' || page_id, 'Two']) AS title FROM pages")
def serp_parse(spark, sf_dir):
    """A page of results for every page: the page itself behind a redirect, and another."""
    n = F.col("page_id").cast("string")
    found = F.concat(F.lit('<a class="result__a" href="//x.example/l/?uddg='), F.url_encode("url"), F.lit('&r=2">One <b>b</b> '), n, F.lit('</a><p></p><a rel="n" class="result__a" href="https://b.example/'), n, F.lit('">Two</a><a href="/next">Next</a>'))
    return search_results(table(spark, sf_dir, "pages").select(F.concat(F.lit("topic "), n).alias("query"), found.alias("html")))


# Crawlers that gather text for language models.
AI_BOTS = "GPTBot Google-Extended PerplexityBot ClaudeBot Anthropic-AI Bytespider Amazonbot Meta-ExternalAgent Applebot-Extended cohere-ai".split()


def blanket_blocks(files: DataFrame, agents: list[str]) -> DataFrame:
    """``files`` (host, content): host and agent of each of ``agents`` that a robots file shuts out of everything.

    A block is one user-agent line and what follows up to the next one, a blank line or a comment; it counts
    for its agent and, if that is ``*``, for all. It shuts out if the last of its rules for ``/`` or for
    nothing is for ``/``.
    """
    lines = files.select("host", F.posexplode(F.split("content", r"\r?\n")).alias("at", "raw")).withColumn("line", F.trim("raw"))
    key, value = F.lower(F.trim(F.substring_index("line", ":", 1))), F.trim(F.regexp_replace("line", "^[^:]*:", ""))
    kv = lines.select("host", "at", F.when(F.col("line").contains(":") & ~F.col("line").startswith("#"), key).alias("key"), value.alias("value"), ((F.col("line") == "") | F.col("line").startswith("#")).alias("gap"))
    order = Window.partitionBy("host").orderBy("at")
    opens = F.coalesce(F.col("key") == "user-agent", F.lit(False)) | F.col("gap")
    blocks = kv.withColumn("block", F.sum(opens.cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    decides = (F.col("key") == "disallow") & F.col("value").isin("/", "")
    each = blocks.groupBy("host", "block").agg(F.min_by("value", "at").alias("first"), F.min_by("key", "at").alias("key"), F.max_by(F.when(decides, F.col("value")), F.when(decides, F.col("at"))).alias("last"))
    shut = each.where((F.col("key") == "user-agent") & (F.col("last") == "/"))
    named = F.filter(F.array(*[F.lit(a) for a in agents]), lambda a: (F.col("first") == "*") | (F.lower(a) == F.lower("first")))
    return shut.select("host", F.explode(named).alias("agent")).distinct()


_FILES = ["User-agent: *\nDisallow: /\n", "User-agent: GPTBot\nDisallow: /\n\nUser-agent: *\nDisallow: /x\n", "User-agent: ClaudeBot\nUser-agent: GPTBot\nDisallow: /\n", "# none\nUser-agent: *\nDisallow:\n", "User-agent: bytespider\nDisallow: /\nDisallow:\n", "User-agent: cohere-ai\nAllow: /y\nDisallow: /\n# end\nDisallow:\n"]


def _robots_files(spark, sf_dir):
    """A robots file for each event: as many hosts as there are events, six kinds of files."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id")
    return e.select(F.concat(F.lit("h"), F.col("event_id").cast("string")).alias("host"), F.element_at(F.array(*[F.lit(x) for x in _FILES]), (F.col("event_id") % 6 + 1).cast("int")).alias("content"))


@query(
    "robots_ai_bots",
    """WITH b(agent) AS (VALUES ('GPTBot'), ('Google-Extended'), ('PerplexityBot'), ('ClaudeBot'), ('Anthropic-AI'), ('Bytespider'), ('Amazonbot'), ('Meta-ExternalAgent'), ('Applebot-Extended'), ('cohere-ai'))
    SELECT 'h' || event_id AS host, agent FROM events, b WHERE event_id % 6 = 0 OR (event_id % 6 IN (1, 2) AND agent = 'GPTBot') OR (event_id % 6 = 5 AND agent = 'cohere-ai')""",
)
def robots_ai_bots(spark, sf_dir):
    """Which language-model crawlers each robots file shuts out."""
    return blanket_blocks(_robots_files(spark, sf_dir), AI_BOTS)


@query("robots_blanket", "SELECT 'h' || event_id AS host FROM events WHERE event_id % 6 = 0")
def robots_blanket(spark, sf_dir):
    """Robots files that shut everybody out."""
    return blanket_blocks(_robots_files(spark, sf_dir), ["*"]).select("host")


# Rules on redirect chains: severity, code, title, condition on a chain's facts.
REDIRECT_RULES = [
    ("warning", "REDIR001", "Long redirect chain", "hops > 5"),
    ("critical", "REDIR002", "Redirect loop detected", "loop"),
    ("critical", "REDIRLOOP001", "Redirect loop detected", "loop"),
    ("warning", "REDIR003", "Mixed-protocol redirect", "mixed"),
    ("info", "REDIR004", "Single redirect detected", "hops = 1"),
    ("warning", "HTTPSRED001", "HTTP URL did not redirect to HTTPS", "stays_plain"),
    ("warning", "MIXPROT001", "HTTP to HTTPS redirect not using 301", "upgrade_other"),
    ("critical", "MIXPROT-V2002", "HTTPS redirecting to HTTP", "downgrade"),
]


def redirect_findings(hops: DataFrame) -> DataFrame:
    """``hops`` (chain, seq, from, to, status): chain, code, severity, title of each rule that a chain of redirects breaks."""
    scheme = lambda c: F.lower(F.regexp_extract(c, "^([A-Za-z][A-Za-z0-9+.-]*)://", 1))
    rows = hops.withColumns({"a": scheme("from"), "b": scheme("to")})
    chain = rows.groupBy("chain").agg(
        F.count("*").alias("hops"),
        F.countDistinct("from").alias("distinct"),
        F.bool_or(F.col("from") == F.col("to")).alias("self"),
        F.array_contains(F.collect_set("from"), F.max_by("to", F.struct("seq", "to"))).alias("back"),
        F.bool_or(F.col("a") != F.col("b")).alias("mixed"),
        F.bool_or((F.col("a") == "http") & (F.col("b") != "https")).alias("stays_plain"),
        F.bool_or((F.col("a") == "http") & (F.col("b") == "https") & F.col("status").between(300, 399) & (F.col("status") != 301)).alias("upgrade_other"),
        F.bool_or((F.col("a") == "https") & (F.col("b") == "http")).alias("downgrade"),
    )
    chain = chain.withColumn("loop", (F.col("distinct") < F.col("hops")) | F.col("self") | F.col("back"))
    made = F.array_compact(F.array(*[F.when(F.expr(when), F.struct(F.lit(code).alias("code"), F.lit(severity).alias("severity"), F.lit(title).alias("title"))) for severity, code, title, when in REDIRECT_RULES]))
    return chain.select("chain", F.inline(made))


_HOPS = """hp AS (SELECT l_orderkey AS chain, l_linenumber AS seq, CASE WHEN l_partkey % 4 = 0 THEN 'http' ELSE 'https' END || '://h.example/' || l_partkey % 97 AS a, CASE WHEN l_suppkey % 5 = 0 THEN 'http' ELSE 'https' END || '://h.example/' || (l_partkey + l_suppkey) % 97 AS b, 301 + l_suppkey % 2 AS status FROM lineitem),
ch AS (SELECT chain, count(*) AS hops, count(DISTINCT a) < count(*) OR bool_or(a = b) OR list_contains(list(a), arg_max(b, (seq, b))) AS loop, bool_or(split_part(a, ':', 1) <> split_part(b, ':', 1)) AS mixed, bool_or(starts_with(a, 'http:') AND NOT starts_with(b, 'https:')) AS stays_plain,
  bool_or(starts_with(a, 'http:') AND starts_with(b, 'https:') AND status <> 301) AS upgrade_other, bool_or(starts_with(a, 'https:') AND starts_with(b, 'http:')) AS downgrade FROM hp GROUP BY chain)"""


@query(
    "redirect_rules",
    f"""WITH {_HOPS} SELECT chain, unnest(list_filter([CASE WHEN hops > 5 THEN {{'code': 'REDIR001', 'severity': 'warning', 'title': 'Long redirect chain'}} END, CASE WHEN loop THEN {{'code': 'REDIR002', 'severity': 'critical', 'title': 'Redirect loop detected'}} END,
    CASE WHEN loop THEN {{'code': 'REDIRLOOP001', 'severity': 'critical', 'title': 'Redirect loop detected'}} END, CASE WHEN mixed THEN {{'code': 'REDIR003', 'severity': 'warning', 'title': 'Mixed-protocol redirect'}} END, CASE WHEN hops = 1 THEN {{'code': 'REDIR004', 'severity': 'info', 'title': 'Single redirect detected'}} END,
    CASE WHEN stays_plain THEN {{'code': 'HTTPSRED001', 'severity': 'warning', 'title': 'HTTP URL did not redirect to HTTPS'}} END, CASE WHEN upgrade_other THEN {{'code': 'MIXPROT001', 'severity': 'warning', 'title': 'HTTP to HTTPS redirect not using 301'}} END,
    CASE WHEN downgrade THEN {{'code': 'MIXPROT-V2002', 'severity': 'critical', 'title': 'HTTPS redirecting to HTTP'}} END], lambda x: x IS NOT NULL), max_depth := 2) FROM ch""",
)
def redirect_rules(spark, sf_dir):
    """Rules over chains of redirects; each order is a chain, its lines are the hops."""
    l = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    url = lambda plain, path: F.concat(F.when(plain, "http").otherwise("https"), F.lit("://h.example/"), (path % 97).cast("string"))
    hops = l.select(F.col("l_orderkey").alias("chain"), F.col("l_linenumber").alias("seq"), url(F.col("l_partkey") % 4 == 0, F.col("l_partkey")).alias("from"), url(F.col("l_suppkey") % 5 == 0, F.col("l_partkey") + F.col("l_suppkey")).alias("to"), (301 + F.col("l_suppkey") % 2).alias("status"))
    return redirect_findings(hops)
