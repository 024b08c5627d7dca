"""What a crawl store answers: upserts, tenants, lookups, searches, canonical orders, sealed fields, plugin findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import findings, graph, html
from .registry import query, table, texts
from .rules.families import families


def upsert(rows: DataFrame, key: str, order: str) -> DataFrame:
    """One row for each key, the last by ``order``."""
    rest = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("r")).select(key, "r.*")


@query("upsert_last", "SELECT user_id, event_id, event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1")
def upsert_last(spark, sf_dir):
    return upsert(table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "value"), "user_id", "event_id")


def of_tenant(rows: DataFrame, tenant) -> DataFrame:
    """Rows of a tenant and those of nobody."""
    return rows.where((F.col("tenant") == tenant) | F.col("tenant").isNull())


_T = "t AS (SELECT event_id, user_id, CASE WHEN user_id % 5 = 0 THEN NULL ELSE user_id % 5 END AS tenant FROM events)"


def _tenants(spark, sf_dir):
    u = F.col("user_id")
    return table(spark, sf_dir, "events").select("event_id", "user_id", F.when(u % 5 != 0, u % 5).alias("tenant"))


@query("tenant_rows", f"WITH {_T} SELECT * FROM t WHERE tenant = 2 OR tenant IS NULL")
def tenant_rows(spark, sf_dir):
    return of_tenant(_tenants(spark, sf_dir), 2)


@query("tenant_runs", f"WITH {_T} SELECT DISTINCT user_id FROM t WHERE tenant = 3")
def tenant_runs(spark, sf_dir):
    """The runs (here users) that a purge of a tenant has to look at: those with rows of the tenant."""
    rows = _tenants(spark, sf_dir)
    return rows.select("user_id").distinct().join(rows.where("tenant = 3").select("user_id").distinct(), "user_id", "left_semi")


@query("link_page_ids", f"WITH {html.SQL} SELECT l.page_id, l.target_url, p.page_id AS target_id FROM links l LEFT JOIN (SELECT url, min(page_id) AS page_id FROM pages GROUP BY url) p ON p.url = l.target_url")
def link_page_ids(spark, sf_dir):
    """Links with the page that they lead to, if it was crawled."""
    pages = table(spark, sf_dir, "pages").groupBy(F.col("url").alias("target_url")).agg(F.min("page_id").alias("target_id"))
    return graph.of(spark, sf_dir).select("page_id", "target_url").join(pages, "target_url", "left")


@query("defects_by_family", f"WITH {findings.SQL}, fam(code, defect) AS (VALUES {', '.join(f'({chr(39)}{c}{chr(39)}, {chr(39)}{d}{chr(39)})' for c, d in families().items())}) SELECT defect, count(*) AS n, count(DISTINCT page_id) AS pages FROM fnd JOIN fam USING (code) GROUP BY defect")
def defects_by_family(spark, sf_dir):
    """Findings by the family that their code is of."""
    known = spark.createDataFrame(list(families().items()), "code string, defect string")
    return findings.of(spark, sf_dir).join(F.broadcast(known), "code").groupBy("defect").agg(F.count("*").alias("n"), F.countDistinct("page_id").alias("pages"))


@query("latest_validators", "SELECT url, arg_max(md5(html), page_id) AS etag, max(page_id) AS page_id FROM pages WHERE html IS NOT NULL GROUP BY url")
def latest_validators(spark, sf_dir):
    """The validator of each URL's last fetch."""
    rows = table(spark, sf_dir, "pages").where("html IS NOT NULL")
    return rows.groupBy("url").agg(F.max_by(F.md5(F.col("html").cast("binary")), "page_id").alias("etag"), F.max("page_id").alias("page_id"))


@query("findings_search", f"WITH {findings.SQL} SELECT page_id, code, title FROM fnd WHERE contains(lower(title), 'heading') OR contains(lower(code), 'heading')")
def findings_search(spark, sf_dir, text="heading"):
    """Findings whose code or title has a text in it."""
    return findings.of(spark, sf_dir).where(F.lower("title").contains(text) | F.lower("code").contains(text)).select("page_id", "code", "title")


def ordered(rows: DataFrame, *by: str) -> DataFrame:
    """``rows`` with position, from 1, in an order; sorted by range and numbered within parts."""
    from .plans.scratch import cut

    rows = cut(rows.repartitionByRange(*by).withColumn("part", F.spark_partition_id()))
    sizes = rows.groupBy("part").agg(F.count("*").alias("size"))
    before = sizes.select("part", (F.sum("size").over(Window.orderBy("part")) - F.col("size")).alias("before"))
    place = F.row_number().over(Window.partitionBy("part").orderBy(*by))
    return rows.withColumn("place", place).join(F.broadcast(before), "part").withColumn("position", F.col("before") + F.col("place")).drop("part", "place", "before")


@query("findings_ordered", f"WITH {findings.SQL} SELECT code, url, page_id, row_number() OVER (ORDER BY code, url, page_id) AS position FROM fnd")
def findings_ordered(spark, sf_dir):
    """Findings in their canonical order: by code, then URL."""
    return ordered(findings.of(spark, sf_dir).select("code", "url", "page_id"), "code", "url", "page_id")


@query("hash_order", "SELECT page_id, md5(url || ':' || page_id) AS k, row_number() OVER (ORDER BY md5(url || ':' || page_id)) AS position FROM pages")
def hash_order(spark, sf_dir):
    """Pages in an order that looks random and is the same every time."""
    rows = table(spark, sf_dir, "pages").select("page_id", F.md5(F.concat("url", F.lit(":"), F.col("page_id").cast("string")).cast("binary")).alias("k"))
    return ordered(rows, "k")


@query("latest_pages", "SELECT page_id, url FROM pages ORDER BY page_id DESC LIMIT 20")
def latest_pages(spark, sf_dir, most=20):
    """The pages fetched last: a limit that the caller sets."""
    return table(spark, sf_dir, "pages").select("page_id", "url").orderBy(F.desc("page_id")).limit(most)


@query("heading_keywords", f"WITH {html.SQL}, w AS (SELECT unnest(list_transform(list_filter(regexp_split_to_array(heading_text, '\\s+'), lambda x: x <> ''), lambda x: lower(x))) AS word FROM pf) SELECT word, count(*) AS n FROM w GROUP BY word ORDER BY n DESC, word LIMIT 10")
def heading_keywords(spark, sf_dir, most=10):
    """The most frequent words of all headings: a top list."""
    words = html.page_facts(texts(spark, sf_dir, "pages")).select(F.explode(F.filter(F.split("heading_text", r"\s+"), lambda w: w != "")).alias("w"))
    return words.groupBy(F.lower("w").alias("word")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "word").limit(most)


@query("order_breaks", "WITH e AS (SELECT event_id, user_id, CASE WHEN event_id % 7 = 3 THEN ts - INTERVAL 1 DAY ELSE ts END AS ts FROM events) SELECT user_id, count(*) AS breaks FROM (SELECT user_id, ts < lag(ts) OVER (PARTITION BY user_id ORDER BY event_id) AS b FROM e) WHERE b GROUP BY user_id")
def order_breaks(spark, sf_dir):
    """How often events of a user are not in order of time, with one clock in seven a day behind."""
    late = F.when(F.col("event_id") % 7 == 3, F.col("ts") - F.expr("INTERVAL 1 DAY")).otherwise(F.col("ts"))
    events = table(spark, sf_dir, "events").select("event_id", "user_id", late.alias("ts"))
    back = F.col("ts") < F.lag("ts").over(Window.partitionBy("user_id").orderBy("event_id"))
    return events.select("user_id", back.alias("b")).where("b").groupBy("user_id").agg(F.count("*").alias("breaks"))


@query("latency_percentiles", "SELECT event_type, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95, quantile_disc(value, 0.99) AS p99 FROM events GROUP BY event_type")
def latency_percentiles(spark, sf_dir):
    """Percentiles over all values, exact, where a sampling store keeps a reservoir."""
    return table(spark, sf_dir, "events").groupBy("event_type").agg(*[F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY value)").alias(n) for n, p in (("p50", 0.5), ("p95", 0.95), ("p99", 0.99))])


def sealed(text: Column, key: str) -> Column:
    """A text encrypted with AES-GCM and a random nonce, base64."""
    return F.base64(F.aes_encrypt(text.cast("binary"), F.lit(key), F.lit("GCM")))


def opened(text: Column, key: str) -> Column:
    return F.aes_decrypt(F.unbase64(text), F.lit(key), F.lit("GCM")).cast("string")


@query("sealed_fields", "SELECT event_id, props, true AS hidden FROM events")
def sealed_fields(spark, sf_dir):
    """Payloads encrypted, written, and opened again."""
    key = "0123456789abcdef"
    rows = table(spark, sf_dir, "events").select("event_id", "props", sealed(F.col("props"), key).alias("sealed"))
    return rows.select("event_id", opened(F.col("sealed"), key).alias("props"), (F.col("sealed") != F.col("props")).alias("hidden"))


_FINDING = "array<struct<code: string, severity: string, title: string>>"


def plugin_findings(answers: DataFrame) -> DataFrame:
    """``answers`` (page_id, json) of plugins as findings: what is no list of findings gives none, a finding without a code or title none, an unknown severity counts as info."""
    rows = answers.select("page_id", F.from_json("json", _FINDING).alias("f")).select("page_id", F.explode("f").alias("f")).where("f.code IS NOT NULL AND f.title IS NOT NULL")
    low = F.lower("f.severity")
    return rows.select("page_id", "f.code", F.when(low.isin("critical", "error", "warning", "info"), low).otherwise("info").alias("severity"), "f.title")


_ANSWERS = """CASE page_id % 5 WHEN 0 THEN '[{"code": "P1", "severity": "Warning", "title": "One"}, {"code": "P2", "title": "Two"}]' WHEN 1 THEN 'not json' WHEN 2 THEN '[]' WHEN 3 THEN '[{"severity": "error", "title": "No code"}, {"code": "P3", "severity": "fatal", "title": "Three"}]' END"""


@query("plugin_findings", "SELECT page_id, unnest(CASE page_id % 5 WHEN 0 THEN ['P1', 'P2'] WHEN 3 THEN ['P3'] ELSE [] END) AS code, unnest(CASE page_id % 5 WHEN 0 THEN ['warning', 'info'] WHEN 3 THEN ['info'] ELSE [] END) AS severity, unnest(CASE page_id % 5 WHEN 0 THEN ['One', 'Two'] WHEN 3 THEN ['Three'] ELSE [] END) AS title FROM pages")
def plugin_findings_query(spark, sf_dir):
    """Answers of a plugin for every page, good and bad ones."""
    return plugin_findings(table(spark, sf_dir, "pages").select("page_id", F.expr(_ANSWERS).alias("json")))


@query("findings_merged", f"WITH {findings.SQL}, p AS (SELECT page_id, unnest(CASE page_id % 5 WHEN 0 THEN ['P1', 'P2'] WHEN 3 THEN ['P3'] ELSE [] END) AS code FROM pages) SELECT code, count(*) AS n FROM (SELECT page_id, code FROM fnd UNION ALL SELECT page_id, code FROM p) GROUP BY code")
def findings_merged(spark, sf_dir):
    """Own and plugins' findings together, by code."""
    both = findings.of(spark, sf_dir).select("page_id", "code").unionByName(plugin_findings_query(spark, sf_dir).select("page_id", "code"))
    return both.groupBy("code").agg(F.count("*").alias("n"))


@query("backlinks_of", f"WITH {html.SQL}, top AS (SELECT target_url FROM links GROUP BY target_url ORDER BY count(*) DESC, target_url LIMIT 1) SELECT l.source_url, {html._host('l.source_url')} AS domain, count(*) AS n FROM links l JOIN top USING (target_url) GROUP BY ALL")
def backlinks_of(spark, sf_dir):
    """Who links to one URL, here the most linked one."""
    found = graph.of(spark, sf_dir)
    top = found.groupBy("target_url").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "target_url").limit(1).select("target_url")
    from .functions import urls

    return found.join(F.broadcast(top), "target_url", "left_semi").groupBy("source_url", urls.host(F.col("source_url")).alias("domain")).agg(F.count("*").alias("n"))


def metric_lines(values: DataFrame, prefix: str) -> DataFrame:
    """``values`` (name, label, value) as lines of the Prometheus text format."""
    label = F.when(F.col("label").isNull(), F.lit("")).otherwise(F.concat(F.lit('{kind="'), F.replace("label", F.lit('"'), F.lit('\\"')), F.lit('"}')))
    return values.select(F.concat(F.lit(f"{prefix}_"), "name", label, F.lit(" "), F.col("value").cast("string")).alias("line"))


@query("metrics_snapshot", f"WITH {findings.SQL} SELECT 'site_findings_total{{kind=\"' || severity || '\"}} ' || count(*) AS line FROM fnd GROUP BY severity UNION ALL SELECT 'site_pages_total ' || count(*) FROM pf")
def metrics_snapshot(spark, sf_dir):
    found = findings.of(spark, sf_dir).groupBy(F.col("severity").alias("label")).agg(F.count("*").alias("value")).withColumn("name", F.lit("findings_total"))
    pages = table(spark, sf_dir, "pages").agg(F.count("*").alias("value")).select(F.lit(None).cast("string").alias("label"), "value", F.lit("pages_total").alias("name"))
    return metric_lines(found.unionByName(pages), "site")


def alert_payload(kind: str, title: Column, text: Column) -> Column:
    """The JSON body of an alert for a chat: slack, discord, teams or a plain webhook."""
    if kind == "discord":
        return F.to_json(F.struct(F.concat_ws("\n", title, text).alias("content")))
    if kind == "teams":
        return F.to_json(F.struct(F.lit("MessageCard").alias("@type"), title.alias("title"), text.alias("text")))
    return F.to_json(F.struct(F.concat_ws("\n", title, text).alias("text"))) if kind == "slack" else F.to_json(F.struct(title.alias("title"), text.alias("message")))


@query("alert_payloads", "SELECT event_id, '{\"text\":\"' || event_type || '\\nvalue ' || event_id || '\"}' AS slack, '{\"content\":\"' || event_type || '\\nvalue ' || event_id || '\"}' AS discord, '{\"@type\":\"MessageCard\",\"title\":\"' || event_type || '\",\"text\":\"value ' || event_id || '\"}' AS teams, '{\"title\":\"' || event_type || '\",\"message\":\"value ' || event_id || '\"}' AS webhook FROM events")
def alert_payloads(spark, sf_dir):
    title, text = F.col("event_type"), F.concat(F.lit("value "), F.col("event_id").cast("string"))
    return table(spark, sf_dir, "events").select("event_id", *[alert_payload(k, title, text).alias(k) for k in ("slack", "discord", "teams", "webhook")])
