"""The link graph: degrees, depth, PageRank, orphans, backlinks."""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import html
from .functions import urls
from .plans.scratch import cut, dropped, written
from .registry import query, table, texts

DAMPING, ROUNDS = 0.85, 20
#: Rounds between lineage cuts.
CUT_EVERY = 5


def links(parsed: DataFrame) -> DataFrame:
    """One row for each link of a page, in page order of nothing: page_id, source_url, target_url, anchor_text, rel, is_external."""
    return parsed.select("page_id", F.col("url").alias("source_url"), F.inline("links")).select("page_id", "source_url", F.col("href").alias("target_url"), F.col("text").alias("anchor_text"), "rel", "is_external")


def of(spark, sf_dir: str) -> DataFrame:
    return links(html.parse(texts(spark, sf_dir, "pages")))


def edges(found: DataFrame) -> DataFrame:
    """Distinct edges between URLs without fragments; self-links stay."""
    return found.select(urls.without_fragment(F.col("source_url")).alias("src"), urls.without_fragment(F.col("target_url")).alias("dst")).distinct()


def vertices(e: DataFrame) -> DataFrame:
    return e.select(F.col("src").alias("url")).union(e.select("dst")).distinct()


def pagerank(e: DataFrame, damping: float = DAMPING, rounds: int = ROUNDS) -> DataFrame:
    """url, pagerank after a fixed number of rounds; what vertices without links hold is spread over all.

    Each round is one join on the source and one sum by target, in which every vertex takes part with nothing; it
    is written, and the mass of vertices without links, a single number, is read from what was written.
    """
    e = written(e.join(e.groupBy("src").agg(F.count("*").alias("degree")), "src"))
    ends = e.select(F.explode(F.array(F.struct(F.col("src").alias("url"), F.lit(True).alias("links")), F.struct(F.col("dst").alias("url"), F.lit(False).alias("links")))).alias("v"))
    v = written(ends.groupBy("v.url").agg(F.max("v.links").alias("links")))
    n = v.count()
    if not n:
        return v.select("url", F.lit(0.0).alias("pagerank"))
    ranks = v.withColumn("pagerank", F.lit(1.0 / n))
    still = v.select("url", "links", F.lit(0.0).alias("got"))
    for _ in range(rounds):
        mass = ranks.where("NOT links").agg(F.coalesce(F.sum("pagerank"), F.lit(0.0))).first()[0]
        given = e.join(ranks.select(F.col("url").alias("src"), "pagerank"), "src").select(F.col("dst").alias("url"), F.lit(False).alias("links"), (F.col("pagerank") / F.col("degree")).alias("got"))
        summed = given.unionByName(still).groupBy("url").agg(F.max("links").alias("links"), F.sum("got").alias("got"))
        before, ranks = ranks, written(summed.select("url", "links", (F.lit((1 - damping) / n + mass * damping / n) + F.lit(damping) * F.col("got")).alias("pagerank")))
        dropped(before)
    return ranks.select("url", "pagerank")


def depths(e: DataFrame, seed: DataFrame) -> DataFrame:
    """url, depth: clicks from the one URL in ``seed``, over ``e`` (src, dst), until no new URL is found."""
    seen = seed.select("url", F.lit(0).alias("depth"))
    frontier = seen
    for d in count(1):
        step = e.join(frontier.select(F.col("url").alias("src")), "src").select(F.col("dst").alias("url")).distinct()
        frontier = cut(step.join(seen.select("url"), "url", "left_anti").withColumn("depth", F.lit(d)))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
        if d % CUT_EVERY == 0:
            seen = cut(seen)
    return seen


def _internal(found: DataFrame) -> DataFrame:
    return found.where(urls.host(F.col("source_url")) == urls.host(F.col("target_url")))


_E = f"""WITH {html.SQL},
e AS (SELECT DISTINCT regexp_replace(source_url, '#.*$', '') AS src, regexp_replace(target_url, '#.*$', '') AS dst FROM links),
v AS (SELECT src AS url FROM e UNION SELECT dst FROM e)"""


@query("links_extract", f"WITH {html.SQL} SELECT * FROM links")
def links_extract(spark, sf_dir):
    return of(spark, sf_dir)


@query("links_external_split", f"WITH {html.SQL} SELECT page_id, count(*) FILTER (is_external) AS external, count(*) FILTER (NOT is_external) AS internal FROM links GROUP BY page_id")
def links_external_split(spark, sf_dir):
    return of(spark, sf_dir).groupBy("page_id").agg(F.count_if("is_external").alias("external"), F.count_if(~F.col("is_external")).alias("internal"))


@query("link_degrees", f"{_E} SELECT v.url, (SELECT count(*) FROM e WHERE src = v.url) AS out_degree, (SELECT count(*) FROM e WHERE dst = v.url) AS in_degree FROM v")
def link_degrees(spark, sf_dir):
    e = edges(of(spark, sf_dir))
    both = e.select(F.explode(F.array(F.struct(F.col("src").alias("url"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("dst").alias("url"), F.lit(0).alias("o"), F.lit(1).alias("i")))).alias("x"))
    return both.groupBy("x.url").agg(F.sum("x.o").alias("out_degree"), F.sum("x.i").alias("in_degree"))


@query(
    "orphan_pages",
    f"""WITH {html.SQL}, t AS (SELECT DISTINCT regexp_replace(target_url, '/$', '') AS u FROM links WHERE NOT is_external AND source_url <> target_url)
    SELECT page_id, url FROM pages WHERE regexp_replace(url, '/$', '') NOT IN (SELECT u FROM t) AND page_id <> (SELECT min(page_id) FROM pages)""",
)
def orphan_pages(spark, sf_dir):
    """Pages without a link from another URL of their host; the seed, the first page, is none."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    into = of(spark, sf_dir).where("NOT is_external AND source_url <> target_url").select(urls.without_slash(F.col("target_url")).alias("u")).distinct()
    seed = pages.agg(F.min("page_id").alias("seed"))
    return pages.join(into, urls.without_slash(F.col("url")) == F.col("u"), "left_anti").crossJoin(F.broadcast(seed)).where("page_id <> seed").drop("seed")


@query("dead_ends", f"WITH {html.SQL} SELECT page_id, url FROM pf WHERE internal_links = 0 OR page_id % 9 = 0")
def dead_ends(spark, sf_dir):
    """Pages without a link to their own site; every page has its menu, so that of one in nine is taken away."""
    page = F.when(F.col("page_id") % 9 == 0, F.regexp_replace("html", "(?s)<nav>.*?</nav>", "")).otherwise(F.col("html"))
    return html.page_facts(texts(spark, sf_dir, "pages").withColumn("html", page)).where("internal_links = 0").select("page_id", "url")


@query("authority_share", f"WITH {html.SQL}, i AS (SELECT regexp_replace(target_url, '/$', '') AS url, count(*) AS n FROM links WHERE NOT is_external AND source_url <> target_url GROUP BY 1) SELECT url, n, round(100.0 * n / (SELECT count(*) FROM links), 6) AS pct FROM i ORDER BY n DESC, url LIMIT 20")
def authority_share(spark, sf_dir):
    found = of(spark, sf_dir)
    into = found.where("NOT is_external AND source_url <> target_url").groupBy(urls.without_slash(F.col("target_url")).alias("url")).agg(F.count("*").alias("n"))
    total = found.agg(F.count("*").alias("total"))
    return into.crossJoin(F.broadcast(total)).select("url", "n", F.round(100.0 * F.col("n") / F.col("total"), 6).alias("pct")).orderBy(F.desc("n"), "url").limit(20)


_rounds = ",\n".join(
    f"r{k + 1} AS (SELECT v.url, 0.15 / n + 0.85 / n * m + 0.85 * coalesce(got, 0) AS pr FROM v, k, (SELECT coalesce(sum(pr), 0) AS m FROM r{k} WHERE url NOT IN (SELECT src FROM e)) LEFT JOIN (SELECT dst, sum(pr / degree) AS got FROM e JOIN d USING (src) JOIN r{k} ON src = r{k}.url GROUP BY dst) ON dst = v.url)"
    for k in range(ROUNDS)
)


@query("pagerank", f"{_E}, d AS (SELECT src, count(*) AS degree FROM e GROUP BY src), k AS (SELECT count(*) AS n FROM v), r0 AS (SELECT url, CAST(1 AS DOUBLE) / n AS pr FROM v, k),\n{_rounds} SELECT url, round(pr * 1000, 6) AS pagerank_permille FROM r{ROUNDS}")
def pagerank_query(spark, sf_dir):
    return pagerank(edges(of(spark, sf_dir))).select("url", F.round(F.col("pagerank") * 1000, 6).alias("pagerank_permille"))


@query(
    "bfs_depth",
    f"""WITH RECURSIVE {html.SQL}, e AS (SELECT DISTINCT regexp_replace(source_url, '/$', '') AS src, regexp_replace(target_url, '/$', '') AS dst FROM links WHERE NOT is_external),
    w(url, depth) AS (SELECT regexp_replace(arg_min(source_url, page_id), '/$', ''), 0 FROM links UNION SELECT dst, depth + 1 FROM w JOIN e ON src = url WHERE depth < 8)
    SELECT url, min(depth) AS depth FROM w GROUP BY url""",
)
def bfs_depth(spark, sf_dir):
    found = of(spark, sf_dir)
    seed = found.agg(F.min_by("source_url", "page_id").alias("u")).select(urls.without_slash(F.col("u")).alias("url"))
    e = _internal(found).select(urls.without_slash(F.col("source_url")).alias("src"), urls.without_slash(F.col("target_url")).alias("dst")).distinct()
    return depths(cut(e), seed)


@query("referring_domains", f"WITH {html.SQL} SELECT {html._host('target_url')} AS domain, count(DISTINCT {html._host('source_url')}) AS referring, count(*) AS n FROM links GROUP BY 1")
def referring_domains(spark, sf_dir):
    found = of(spark, sf_dir)
    return found.groupBy(urls.host(F.col("target_url")).alias("domain")).agg(F.countDistinct(urls.host(F.col("source_url"))).alias("referring"), F.count("*").alias("n"))


@query("backlink_summary", f"{_E} SELECT (SELECT count(*) FROM e) AS edges, (SELECT count(*) FROM v) AS urls, (SELECT count(DISTINCT src) FROM e) AS sources, (SELECT count(DISTINCT {html._host('src')}) FROM e) AS domains, (SELECT count(*) FROM v WHERE url NOT IN (SELECT dst FROM e)) AS without_links")
def backlink_summary(spark, sf_dir):
    e = edges(of(spark, sf_dir))
    one = e.agg(F.count("*").alias("edges"), F.countDistinct("src").alias("sources"), F.countDistinct(urls.host(F.col("src"))).alias("domains"))
    v = vertices(e)
    alone = v.join(e.select(F.col("dst").alias("url")).distinct(), "url", "left_anti").agg(F.count("*").alias("without_links"))
    return one.crossJoin(v.agg(F.count("*").alias("urls"))).crossJoin(alone)


@query("graph_edges_csv", f"{_E} SELECT '\"' || replace(src, '\"', '\"\"') || '\",\"' || replace(dst, '\"', '\"\"') || '\"' AS line FROM e")
def graph_edges_csv(spark, sf_dir):
    quoted = lambda c: F.concat(F.lit('"'), F.replace(F.col(c), F.lit('"'), F.lit('""')), F.lit('"'))
    return edges(of(spark, sf_dir)).select(F.concat_ws(",", quoted("src"), quoted("dst")).alias("line"))


@query("graph_dot", f"{_E} SELECT '  \"' || src || '\" -> \"' || dst || '\";' AS line FROM e")
def graph_dot(spark, sf_dir):
    return edges(of(spark, sf_dir)).select(F.concat(F.lit('  "'), "src", F.lit('" -> "'), "dst", F.lit('";')).alias("line"))


@query("headings_extract", f"WITH {html.SQL} SELECT page_id, h.level AS level, h.text AS text, strlen(h.text) AS bytes FROM (SELECT page_id, unnest(headings) AS h FROM pg)")
def headings_extract(spark, sf_dir):
    return html.parse(texts(spark, sf_dir, "pages")).select("page_id", F.inline("headings")).withColumn("bytes", F.octet_length("text").cast("long"))


@query("h1_census", f"WITH {html.SQL} SELECT h1_count, count(*) AS pages FROM pf GROUP BY 1")
def h1_census(spark, sf_dir):
    return html.page_facts(texts(spark, sf_dir, "pages")).groupBy("h1_count").agg(F.count("*").alias("pages"))


@query(
    "url_parts",
    f"SELECT page_id, lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.\\-]*)://', 1)) AS scheme, {html._host('url')} AS host, {html._pathsql('url')} AS path, regexp_extract(url, '\\?([^#]*)', 1) AS query, len(list_filter(string_split({html._pathsql('url')}, '/'), lambda s: s <> '')) AS depth FROM pages",
)
def url_parts(spark, sf_dir):
    u = F.col("url")
    return table(spark, sf_dir, "pages").select("page_id", urls.scheme(u).alias("scheme"), urls.host(u).alias("host"), urls.path(u).alias("path"), urls.query_string(u).alias("query"), urls.depth(u).cast("long").alias("depth"))


_ident = f"lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.\\-]*)://', 1)) || '|' || {html._host('url')} || '|' || (CASE WHEN length({html._pathsql('url')}) > 1 THEN regexp_replace({html._pathsql('url')}, '/$', '') ELSE {html._pathsql('url')} END) || '|' || regexp_extract(url, '\\?([^#]*)', 1)"


@query("url_norm_dups", f"SELECT min(page_id) AS first_page, count(*) AS n FROM (SELECT page_id, {_ident} AS k FROM pages) GROUP BY k HAVING count(*) > 1")
def url_norm_dups(spark, sf_dir):
    return table(spark, sf_dir, "pages").groupBy(urls.identity(F.col("url"))).agg(F.min("page_id").alias("first_page"), F.count("*").alias("n")).where("n > 1").select("first_page", "n")


@query(
    "host_partition",
    "SELECT host, h, h % 8 AS partition FROM (SELECT host, list_reduce(list_concat([CAST(2166136261 AS BIGINT)], list_transform(regexp_extract_all(hex(encode(host)), '..'), lambda x: CAST('0x' || x AS BIGINT))), lambda a, b: (xor(a, b) * 16777619) % 4294967296) AS h FROM (SELECT DISTINCT " + html._host("url") + " AS host FROM pages))",
)
def host_partition(spark, sf_dir):
    hosts = table(spark, sf_dir, "pages").select(urls.host(F.col("url")).alias("host")).distinct()
    return hosts.select("host", urls.domain_hash(F.concat(F.lit("http://"), "host")).alias("h")).withColumn("partition", F.col("h") % 8)
