"""Whole-crawl exports: wide CSV rows, one JSON document, HTML and Markdown reports.

A report is a table of lines with an order; ``write_document`` writes it as text files that joined in the order
of their names are the document. No report passes through one task or the driver; tables over all pages
are sorted by range.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import findings, html
from ..functions.scalars import escape_html
from ..plans.scratch import cut, shared_folder
from ..registry import query, texts

#: The columns of the CSV export, in order.
CSV_COLUMNS = """url status_code title description canonical word_count load_time_ms body_size fetched_at has_structured_data schema_types
viewport_ok has_csp has_hsts images_total images_missing_alt h1_count heading_count issue_count issues links extractions""".split()
#: Version of the JSON export, colours of severities in the HTML report.
JSON_VERSION = "2.0"
COLORS = {"critical": "#dc2626", "error": "#ea580c", "warning": "#ca8a04", "info": "#2563eb"}


def fetched(facts: DataFrame) -> DataFrame:
    """page_id, status_code, load_time_ms, fetched_at, has_csp, has_hsts: how pages were fetched. The given ones were not, so it is made up from their numbers."""
    p = F.col("page_id")
    status = F.when(p % 11 == 3, 404).when(p % 13 == 5, 503).when(p % 5 == 1, 301).otherwise(200)
    at = F.date_format(F.lit("2024-01-01").cast("timestamp_ntz") + F.make_dt_interval(secs=(p % 86_400).cast("decimal(18,6)")), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return facts.select("page_id", status.cast("long").alias("status_code"), (p * 37 % 1900 + 100).alias("load_time_ms"), at.alias("fetched_at"), (p % 3 == 0).alias("has_csp"), (p % 4 != 0).alias("has_hsts"))


def crawl_rows(parsed: DataFrame, responses: DataFrame, found: DataFrame, extractions: DataFrame | None = None) -> DataFrame:
    """page_id and CSV_COLUMNS of every page, nested tables as JSON.

    ``parsed`` is ``html.parse``'s, ``responses`` ``fetched``'s, ``found`` findings (page_id, code, severity, title), ``extractions``
    page_id, rule_name, values. Findings are in order of code, links in page order.
    """
    facts = html.facts(parsed).select("page_id", "url", "title", "description", "canonical", "word_count", F.col("html_bytes").alias("body_size"), (F.col("json_ld_count") > 0).alias("has_structured_data"), F.coalesce(F.col("viewport").contains("device-width"), F.lit(False)).alias("viewport_ok"), F.col("image_count").alias("images_total"), "images_missing_alt", "h1_count", "heading_count")
    kinds = F.array_join(F.array_distinct(F.array_compact(F.transform("json_ld", lambda j: F.get_json_object(j, "$['@type']")))), ",").alias("schema_types")
    nested = parsed.select("page_id", kinds, F.to_json(F.transform("links", lambda x: F.struct(x["href"].alias("url"), x["text"].alias("text"), x["is_external"].alias("is_external")))).alias("links"))
    issues = found.groupBy("page_id").agg(F.count("*").alias("issue_count"), F.to_json(F.sort_array(F.collect_list(F.struct("code", "severity", "title")))).alias("issues"))
    rows = facts.join(nested, "page_id").join(responses, "page_id", "left").join(issues, "page_id", "left")
    if extractions is None:
        rows = rows.withColumn("extractions", F.lit(""))
    else:
        rows = rows.join(extractions.groupBy("page_id").agg(F.to_json(F.map_from_entries(F.sort_array(F.collect_list(F.struct("rule_name", "values"))))).alias("extractions")), "page_id", "left")
    return rows.withColumns({"issue_count": F.coalesce("issue_count", F.lit(0)), "issues": F.coalesce("issues", F.lit("[]"))}).select("page_id", *CSV_COLUMNS)


def write_csv(rows: DataFrame, path: str, columns: list[str] | None = None) -> None:
    """The chosen columns (all of CSV_COLUMNS, in their order) as CSV with a header."""
    wanted = [c for c in CSV_COLUMNS if columns is None or c in columns]
    rows.select(wanted).write.option("header", True).option("escape", '"').option("emptyValue", "").csv(path)


def write_document(lines: DataFrame, path: str, order: list[str]) -> None:
    """Lines as text files: joined in the order of their names they are the document."""
    lines.repartitionByRange(*order).sortWithinPartitions(*order).select("line").write.text(path)


def _stats(found: DataFrame, rows: DataFrame) -> DataFrame:
    """One row: pages, average load time, bytes, findings by severity and category as maps in order of their names."""
    def by(column: str) -> DataFrame:
        counts = found.groupBy(column).agg(F.count("*").alias("n"))
        return counts.agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(F.col(column), F.col("n"))))).alias(f"issues_by_{column}"), F.coalesce(F.sum("n"), F.lit(0)).alias(f"n_{column}"))

    total = rows.agg(F.count("*").alias("total_pages"), F.round(F.avg("load_time_ms"), 3).alias("avg_response_time_ms"), F.sum("body_size").alias("total_body_size"))
    return total.crossJoin(by("severity")).crossJoin(by("category")).withColumnRenamed("n_severity", "total_issues").drop("n_category")


def json_document(rows: DataFrame, found: DataFrame, crawl_id: str, target_url: str) -> DataFrame:
    """part, url, page_id, line: a JSON document of a crawl, a line for its head, for each page in order of URL, and for its statistics."""
    whole = {"ignoreNullFields": "false"}
    stats = _stats(found, rows)
    crawl = F.struct(F.lit(crawl_id).alias("id"), F.lit(target_url).alias("target_url"), F.col("total_pages").alias("pages_crawled"), F.col("total_issues"))
    none = [F.lit(None).cast("string").alias("url"), F.lit(None).cast("long").alias("page_id")]
    head = stats.select(F.lit(0).alias("part"), *none, F.concat(F.lit(f'{{"schema_version":"{JSON_VERSION}","crawl":'), F.to_json(crawl, whole), F.lit(',"pages":[')).alias("line"))
    nested = [c for c in CSV_COLUMNS if c not in ("issues", "links", "extractions", "issue_count")]
    page = F.concat(F.regexp_replace(F.to_json(F.struct("page_id", *nested), whole), r"\}$", ""), F.lit(',"issues":'), F.col("issues"), F.lit(',"links":'), F.coalesce("links", F.lit("[]")), F.lit("}"))
    # every page but the first follows a comma, so that none needs to know the one after
    first = rows.agg(F.min(F.struct("url", "page_id")).alias("first"))
    pages = rows.crossJoin(F.broadcast(first)).select(F.lit(1).alias("part"), "url", "page_id", F.concat(F.when(F.struct("url", "page_id") == F.col("first"), "").otherwise(","), page).alias("line"))
    end = F.struct("total_pages", "total_issues", "issues_by_severity", "issues_by_category", "avg_response_time_ms", "total_body_size")
    tail = stats.select(F.lit(2).alias("part"), *none, F.concat(F.lit('],"stats":'), F.to_json(end, whole), F.lit("}")).alias("line"))
    return head.unionByName(pages).unionByName(tail)


_STYLE = "body{font-family:sans-serif;line-height:1.5;padding:1rem}table{border-collapse:collapse}td,th{border:1px solid #ddd;padding:.25rem .5rem}.num{text-align:right}.badge{color:#fff;padding:0 .5rem}.status-error{color:#dc2626}.status-redirect{color:#ca8a04}"


def html_report(rows: DataFrame, found: DataFrame, title: str) -> DataFrame:
    """part, k, url, page_id, line: a crawl's HTML report, with its summary, a bar a severity, the twenty top issues and a row a page."""
    stats = _stats(found, rows)
    counts = cut(found.groupBy("severity", "code", "title").agg(F.count("*").alias("n"), F.countDistinct("page_id").alias("pages")))
    none = [F.lit(None).cast("string").alias("url"), F.lit(None).cast("long").alias("page_id")]

    def one(df: DataFrame, part: int, k: Column, *line) -> DataFrame:
        return df.select(F.lit(part).alias("part"), k.cast("long").alias("k"), *none, F.concat(*[x if isinstance(x, Column) else F.lit(x) for x in line]).alias("line"))

    text = lambda c: escape_html(F.col(c).cast("string"))
    color = lambda c: F.coalesce(F.create_map(*[F.lit(x) for pair in COLORS.items() for x in pair])[F.col(c)], F.lit("#6b7280"))
    safe = title.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")
    head = one(stats, 0, F.lit(0), f'<!DOCTYPE html><html lang="en"><head><meta charset="utf-8"><meta name="viewport" content="width=device-width, initial-scale=1"><title>Crawl Report — {safe}</title><style>{_STYLE}</style></head><body><h1>Crawl Report</h1><p>Pages: ', text("total_pages"), "</p><p>Issues: ", text("total_issues"), "</p><p>Bytes: ", text("total_body_size"), "</p>")
    every = found.sparkSession.createDataFrame([(s, k) for k, s in enumerate(findings.SEVERITIES)], "severity string, k int")
    bars = every.join(counts.groupBy("severity").agg(F.sum("n").alias("n")), "severity", "left").crossJoin(stats.select("total_issues")).withColumn("n", F.coalesce("n", F.lit(0)))
    share = F.when(F.col("total_issues") > 0, F.round(100.0 * F.col("n") / F.col("total_issues"))).otherwise(0.0).cast("long").cast("string")
    bar = one(bars, 1, F.col("k"), '<div role="meter" aria-valuemin="0" aria-valuemax="100" aria-valuenow="', share, '" style="background:', color("severity"), ";width:", share, '%">', text("severity"), ": ", text("n"), "</div>")
    top = counts.withColumn("k", F.row_number().over(Window.orderBy(findings.severity_rank(F.col("severity")), F.desc("pages"), "code", "title"))).where("k <= 20")
    issue = one(top, 3, F.col("k"), '<tr><td><span class="badge" style="background:', color("severity"), '">', text("severity"), "</span></td><td>", text("code"), "</td><td>", text("title"), '</td><td class="num">', text("pages"), "</td></tr>")
    told = lambda part, line: one(stats, part, F.lit(0), line)
    dash = lambda c, unit="": F.coalesce(F.concat(text(c), F.lit(unit)), F.lit("—"))
    status = F.when(F.col("status_code") >= 400, "status-error").when(F.col("status_code") >= 300, "status-redirect").otherwise("status-ok")
    line = F.concat(F.lit('<tr><td><a href="'), text("url"), F.lit('">'), text("url"), F.lit('</a></td><td class="'), status, F.lit('">'), dash("status_code"), F.lit("</td><td>"), dash("title"), F.lit('</td><td class="num">'), dash("word_count"), F.lit('</td><td class="num">'), dash("load_time_ms", "ms"), F.lit('</td><td class="num">'), text("issue_count"), F.lit("</td></tr>"))
    pages = rows.select(F.lit(5).alias("part"), F.lit(0).cast("long").alias("k"), "url", "page_id", line.alias("line"))
    parts = [bar, told(2, "<h2>Top issues</h2><table><tr><th>Severity</th><th>Code</th><th>Title</th><th>Pages</th></tr>"), issue, told(4, "</table><h2>Pages</h2><table><tr><th>URL</th><th>Status</th><th>Title</th><th>Words</th><th>Load</th><th>Issues</th></tr>"), pages, told(6, "</table></body></html>")]
    for p in parts:
        head = head.unionByName(p)
    return head


def _inputs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    parsed = cut(html.parse(texts(spark, sf_dir, "pages")))
    found = cut(findings.findings(html.facts(parsed)).where("NOT is_metric"))
    return crawl_rows(parsed, fetched(parsed), found), found


_ROWS = rf"""{findings.SQL},
fi AS (SELECT page_id, count(*) AS issue_count, '[' || string_agg('{{"code":"' || code || '","severity":"' || severity || '","title":' || to_json(title) || '}}', ',' ORDER BY code, severity, title) || ']' AS issues FROM fnd WHERE NOT is_metric GROUP BY page_id),
li AS (SELECT page_id, '[' || array_to_string(list_transform(links, lambda x: '{{"url":' || to_json(x.href) || ',"text":' || to_json(x.text) || ',"is_external":' || ({html._host('x.href')} <> host) || '}}'), ',') || ']' AS links FROM pg),
wr AS (SELECT pf.page_id, pf.url, CAST(CASE WHEN pf.page_id % 11 = 3 THEN 404 WHEN pf.page_id % 13 = 5 THEN 503 WHEN pf.page_id % 5 = 1 THEN 301 ELSE 200 END AS BIGINT) AS status_code, title, description, canonical, word_count, pf.page_id * 37 % 1900 + 100 AS load_time_ms, html_bytes AS body_size,
  strftime(TIMESTAMP '2024-01-01' + to_seconds(pf.page_id % 86400), '%Y-%m-%dT%H:%M:%SZ') AS fetched_at, json_ld_count > 0 AS has_structured_data, '' AS schema_types, coalesce(contains(viewport, 'device-width'), false) AS viewport_ok, pf.page_id % 3 = 0 AS has_csp, pf.page_id % 4 <> 0 AS has_hsts,
  image_count AS images_total, images_missing_alt, h1_count, heading_count, coalesce(issue_count, 0) AS issue_count, coalesce(issues, '[]') AS issues, links, '' AS extractions
  FROM pf LEFT JOIN fi USING (page_id) JOIN li USING (page_id))"""


@query("csv_pages", f"WITH {_ROWS} SELECT {', '.join(CSV_COLUMNS[:-1])} FROM wr")
def csv_pages(spark, sf_dir):
    """All columns but the extractions, written as CSV and read again."""
    rows, _ = _inputs(spark, sf_dir)
    path = f"{shared_folder(spark)}/csv-{uuid.uuid4().hex}"
    write_csv(rows, path, CSV_COLUMNS[:-1])
    kinds = {"status_code": "long", "word_count": "long", "load_time_ms": "long", "body_size": "long", "images_total": "long", "images_missing_alt": "long", "h1_count": "long", "heading_count": "long", "issue_count": "long", "has_structured_data": "boolean", "viewport_ok": "boolean", "has_csp": "boolean", "has_hsts": "boolean"}
    back = spark.read.schema(", ".join(f"{c} {kinds.get(c, 'string')}" for c in CSV_COLUMNS[:-1])).option("header", True).option("escape", '"').option("multiLine", True).option("emptyValue", "").csv(path)
    return back.withColumn("schema_types", F.coalesce("schema_types", F.lit("")))


@query(
    "json_export",
    rf"""WITH {_ROWS}, f AS (SELECT min({{'u': url, 'p': page_id}}) AS first FROM wr)
    SELECT page_id, CASE WHEN url = first.u AND page_id = first.p THEN '' ELSE ',' END || '{{"page_id":' || page_id || ',"url":' || to_json(url) || ',"status_code":' || status_code || ',"title":' || coalesce(to_json(title)::VARCHAR, 'null') || ',"description":' || coalesce(to_json(description)::VARCHAR, 'null') || ',"canonical":' || coalesce(to_json(canonical)::VARCHAR, 'null')
      || ',"word_count":' || word_count || ',"load_time_ms":' || load_time_ms || ',"body_size":' || body_size || ',"fetched_at":"' || fetched_at || '","has_structured_data":' || has_structured_data || ',"schema_types":"","viewport_ok":' || viewport_ok || ',"has_csp":' || has_csp || ',"has_hsts":' || has_hsts
      || ',"images_total":' || images_total || ',"images_missing_alt":' || images_missing_alt || ',"h1_count":' || h1_count || ',"heading_count":' || heading_count || ',"issues":' || issues || ',"links":' || links || '}}' AS line FROM wr, f""",
)
def json_export(spark, sf_dir):
    """The lines of the pages in a crawl's JSON document."""
    rows, found = _inputs(spark, sf_dir)
    return json_document(rows, found, "c1", "https://example.com/").where("part = 1").select("page_id", "line")


_ESCAPED = "replace(replace(replace(replace(replace({x}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#39;')"


@query(
    "report_html",
    rf"""WITH {_ROWS} SELECT page_id, '<tr><td><a href="' || {_ESCAPED.format(x='url')} || '">' || {_ESCAPED.format(x='url')} || '</a></td><td class="' || CASE WHEN status_code >= 400 THEN 'status-error' WHEN status_code >= 300 THEN 'status-redirect' ELSE 'status-ok' END || '">' || status_code || '</td><td>' || coalesce({_ESCAPED.format(x='title')}, '—')
      || '</td><td class="num">' || word_count || '</td><td class="num">' || load_time_ms || 'ms</td><td class="num">' || issue_count || '</td></tr>' AS line FROM wr""",
)
def report_html(spark, sf_dir):
    """The rows of the pages in a crawl's HTML report."""
    rows, found = _inputs(spark, sf_dir)
    return html_report(rows, found, "https://example.com/").where("part = 5").select("page_id", "line")
