"""Exports: versioned Parquet and JSON lines in a fixed column order, CSV with nested columns as JSON, Markdown."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import findings, html
from ..plans.scratch import cut
from ..registry import query, texts

# Columns of each exported table, in order: name, type, and ? if it may be null.
_COLUMNS = {
    "crawl_runs": "crawl_id string, target_url string, start_time timestamp?, end_time timestamp?, pages_crawled long, total_issues long, tenant_id string?, sequence long?",
    "pages": """crawl_id string, page_id string, url string, final_url string, status_code long, title string?, description string?, canonical_url string?, word_count long?, load_time_ms long?,
        body_size long?, fetched_at timestamp, tenant_id string?, etag string?, last_modified string?, cwv_lcp_ms double?, cwv_cls double?, cwv_inp_ms double?, has_structured_data boolean?,
        schema_types string?, viewport_ok boolean?, has_csp boolean?, has_hsts boolean?, images_total long?, images_missing_alt long?, h1_count long?, heading_count long?, extractions_json string?""",
    "findings": "crawl_id string, page_id string, issue_id string, category string, severity string, code string, title string, description string, element string?, recommendation string, tenant_id string?",
}
#: Contract of each exported table: name, type, whether it may be null, version that added it.
CONTRACTS = {t: [(n, k.rstrip("?"), k.endswith("?"), 1) for n, k in (c.split() for c in text.split(","))] for t, text in _COLUMNS.items()}
_WAREHOUSE = {
    "bigquery": {"string": "STRING", "long": "INT64", "double": "FLOAT64", "boolean": "BOOL", "timestamp": "TIMESTAMP"},
    "snowflake": {"string": "VARCHAR", "long": "NUMBER(38,0)", "double": "FLOAT", "boolean": "BOOLEAN", "timestamp": "TIMESTAMP_NTZ"},
}
_SPARK = {"timestamp": "timestamp_ntz"}


def conform(df: DataFrame, contract: str) -> DataFrame:
    """Columns of the contract, cast and in its order; a missing column is an error unless nullable."""
    have, out = set(df.columns), []
    for name, kind, nullable, _ in CONTRACTS[contract]:
        if name not in have and not nullable:
            raise ValueError(f"{contract} needs {name}")
        out.append((F.col(name) if name in have else F.lit(None)).cast(_SPARK.get(kind, kind)).alias(name))
    return df.select(*out)


def ddl(contract: str, warehouse: str) -> str:
    """Column definitions of a contract for a warehouse."""
    return ",\n".join(f"{n} {_WAREHOUSE[warehouse][t]}{'' if null else ' NOT NULL'}" for n, t, null, _ in CONTRACTS[contract])


def write_parquet(df: DataFrame, contract: str, path: str) -> None:
    conform(df, contract).write.mode("append").partitionBy("crawl_id").option("compression", "zstd").parquet(path)


def write_jsonl(df: DataFrame, contract: str, path: str) -> None:
    conform(df, contract).write.mode("append").option("ignoreNullFields", "false").json(path)


def nested(pages: DataFrame, found: DataFrame) -> DataFrame:
    """Pages with their findings as one JSON column, in order of code."""
    issues = found.groupBy("page_id").agg(F.to_json(F.array_sort(F.collect_list(F.struct("code", "severity")))).alias("issues"))
    return pages.join(issues, "page_id", "left").withColumn("issues", F.coalesce("issues", F.lit("[]")))


def markdown(html_column: str = "html"):
    """A page's body as Markdown: headings, list items, paragraphs, links."""
    x = F.regexp_replace(F.regexp_replace(F.col(html_column), html.NOISE, ""), html.HEAD, "")
    for n in range(6, 0, -1):
        x = F.regexp_replace(x, rf"(?is)<h{n}\b[^>]*>(.*?)</h{n}\s*>", "\n" + "#" * n + " $1\n")
    x = F.regexp_replace(x, r"(?is)<a\b[^>]*\bhref\s*=\s*[\"']([^\"']*)[\"'][^>]*>(.*?)</a\s*>", r"[$2]($1)")
    x = F.regexp_replace(x, r"(?is)<li\b[^>]*>", "\n- ")
    x = F.regexp_replace(x, r"(?is)<br\s*/?>|</p\s*>", "\n")
    return F.trim(F.regexp_replace(F.regexp_replace(x, html.TAG, ""), r"\s*\n\s*", "\n"))


def _shared(spark) -> str:
    from ..plans.scratch import shared_folder

    return f"{shared_folder(spark)}/export-{uuid.uuid4().hex}"


def layout(crawl_id: str, destination: str) -> list[tuple[str, str, str]]:
    """Files of a crawl's export for s3, bigquery or snowflake: name, role and table."""
    if destination == "s3":
        return [(f"exports/{crawl_id}/{t}.parquet", "parquet-table", t) for t in CONTRACTS]
    return [(f"exports/{crawl_id}/{t}.jsonl", "jsonl-table", t) for t in CONTRACTS] + [(f"exports/{crawl_id}/_schema.json", "schema-manifest", "")]


#: DuckDB: what the pages and findings of a crawl are exported as. Responses are made up from page numbers, as in ``site.crawled``.
_EXPORT = f"""{findings.SQL}, xp AS (SELECT 'c1' AS crawl_id, CAST(page_id AS VARCHAR) AS page_id, url, url AS final_url, CAST(CASE WHEN page_id % 11 = 3 THEN 404 WHEN page_id % 13 = 5 THEN 503 WHEN page_id % 5 = 1 THEN 301 ELSE 200 END AS BIGINT) AS status_code,
  title, description, canonical AS canonical_url, word_count, CAST(NULL AS BIGINT) AS load_time_ms, html_bytes AS body_size, TIMESTAMP '2024-01-01' + INTERVAL (page_id) SECOND AS fetched_at, CAST(NULL AS VARCHAR) AS tenant_id, CAST(NULL AS VARCHAR) AS etag, CAST(NULL AS VARCHAR) AS last_modified,
  CAST(NULL AS DOUBLE) AS cwv_lcp_ms, CAST(NULL AS DOUBLE) AS cwv_cls, CAST(NULL AS DOUBLE) AS cwv_inp_ms, json_ld_count > 0 AS has_structured_data, CAST(NULL AS VARCHAR) AS schema_types, coalesce(contains(viewport, 'device-width'), false) AS viewport_ok,
  page_id % 3 = 0 AS has_csp, page_id % 4 <> 0 AS has_hsts, image_count AS images_total, images_missing_alt, h1_count, heading_count, CAST(NULL AS VARCHAR) AS extractions_json FROM pf),
xf AS (SELECT 'c1' AS crawl_id, CAST(page_id AS VARCHAR) AS page_id, page_id || ':' || seq AS issue_id, category, severity, code, title, title AS description, CAST(NULL AS VARCHAR) AS element, 'See ' || code AS recommendation, CAST(NULL AS VARCHAR) AS tenant_id FROM fnd),
xr AS (SELECT 'c1' AS crawl_id, (SELECT arg_min(url, CAST(page_id AS BIGINT)) FROM xp) AS target_url, (SELECT min(fetched_at) FROM xp) AS start_time, (SELECT max(fetched_at) FROM xp) AS end_time, (SELECT count(*) FROM xp) AS pages_crawled, (SELECT count(*) FROM xf) AS total_issues, CAST(NULL AS VARCHAR) AS tenant_id, CAST(NULL AS BIGINT) AS sequence)"""


def export_tables(facts: DataFrame, crawl_id: str) -> dict[str, DataFrame]:
    """crawl_runs, pages and findings of a crawl from its page facts (with status_code, has_csp and has_hsts), in contract form."""
    at = F.lit("2024-01-01").cast("timestamp_ntz") + F.make_dt_interval(secs=F.col("page_id"))
    same = {"final_url": "url", "canonical_url": "canonical", "body_size": "html_bytes", "images_total": "image_count"}
    pages = facts.withColumns({n: F.col(c) for n, c in same.items()} | {"crawl_id": F.lit(crawl_id), "fetched_at": at, "has_structured_data": F.col("json_ld_count") > 0, "viewport_ok": F.coalesce(F.col("viewport").contains("device-width"), F.lit(False))})
    found = findings.findings(facts).select(F.lit(crawl_id).alias("crawl_id"), "page_id", F.concat_ws(":", F.col("page_id").cast("string"), F.col("seq").cast("string")).alias("issue_id"), "category", "severity", "code", "title", F.col("title").alias("description"), F.concat(F.lit("See "), "code").alias("recommendation"))
    run = pages.agg(F.min_by("url", "page_id").alias("target_url"), F.min("fetched_at").alias("start_time"), F.max("fetched_at").alias("end_time"), F.count("*").alias("pages_crawled"))
    runs = run.crossJoin(found.agg(F.count("*").alias("total_issues"))).withColumn("crawl_id", F.lit(crawl_id))
    return {"crawl_runs": conform(runs, "crawl_runs"), "pages": conform(pages, "pages"), "findings": conform(found, "findings")}


def _tables(spark, sf_dir) -> dict[str, DataFrame]:
    from .. import site

    return export_tables(site.crawled(html.page_facts(texts(spark, sf_dir, "pages"))), "c1")


def export_crawl(tables: dict[str, DataFrame], folder: str, kind: str = "parquet") -> None:
    """All tables of a crawl, each in a folder of its own, as Parquet or as JSON lines."""
    for contract, df in tables.items():
        (write_parquet if kind == "parquet" else write_jsonl)(df, contract, f"{folder}/{contract}")


def read_export(spark, folder: str, contract: str, kind: str = "parquet") -> DataFrame:
    schema = ", ".join(f"{n} {_SPARK.get(t, t)}" for n, t, _, _ in CONTRACTS[contract])
    reader = spark.read.schema(schema)
    return conform(reader.parquet(f"{folder}/{contract}") if kind == "parquet" else reader.json(f"{folder}/{contract}"), contract)


def _exported(spark, sf_dir, contract: str, kind: str) -> DataFrame:
    folder = _shared(spark)
    export_crawl({contract: _tables(spark, sf_dir)[contract]}, folder, kind)
    return read_export(spark, folder, contract, kind)


@query("warehouse_pages", f"WITH {_EXPORT} SELECT * FROM xp")
def warehouse_pages(spark, sf_dir):
    """Written as Parquet and read again."""
    return _exported(spark, sf_dir, "pages", "parquet")


@query("warehouse_findings", f"WITH {_EXPORT} SELECT * FROM xf")
def warehouse_findings(spark, sf_dir):
    return _exported(spark, sf_dir, "findings", "parquet")


@query("warehouse_runs", f"WITH {_EXPORT} SELECT * FROM xr")
def warehouse_runs(spark, sf_dir):
    return _exported(spark, sf_dir, "crawl_runs", "parquet")


@query("jsonl_roundtrip", f"WITH {_EXPORT} SELECT * FROM xf")
def jsonl_roundtrip(spark, sf_dir):
    """Written as JSON lines and read again."""
    return _exported(spark, sf_dir, "findings", "jsonl")


@query("jsonl_pages", f"WITH {_EXPORT} SELECT * FROM xp")
def jsonl_pages(spark, sf_dir):
    return _exported(spark, sf_dir, "pages", "jsonl")


def report_counts(found: DataFrame) -> DataFrame:
    """Findings by severity, category, code and title with the pages they are on: a few rows, from which reports are written."""
    return found.where("NOT is_metric").groupBy("severity", "category", "code", "title").agg(F.count("*").alias("n"), F.countDistinct("page_id").alias("pages"))


def markdown_report(counts: DataFrame, pages: DataFrame) -> DataFrame:
    """part, k, line of a report: a summary, findings by severity and by category, and the ten top issues. ``pages``: pages, bytes."""
    rank = findings.severity_rank(F.col("severity"))
    total = pages.crossJoin(counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("issues")))
    row = lambda *cells: F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |"))
    summary = total.select(F.posexplode(F.array(row(F.lit("Pages crawled"), F.col("pages").cast("string")), row(F.lit("Total issues"), F.col("issues").cast("string")), row(F.lit("Total body size"), F.concat(F.format_string("%.2f", F.col("bytes") / 1024.0), F.lit(" KB"))))).alias("k", "line")).select(F.lit(1).alias("part"), "k", "line")
    found = counts.groupBy("severity").agg(F.sum("n").alias("n"))
    every = counts.sparkSession.createDataFrame([(s, k) for k, s in enumerate(findings.SEVERITIES)], "severity string, k int")
    severity = every.join(found, "severity", "left").select(F.lit(2).alias("part"), "k", row(F.col("severity"), F.coalesce("n", F.lit(0)).cast("string")).alias("line"))
    category = counts.groupBy("category").agg(F.sum("n").alias("n"))
    category = category.select(F.lit(3).alias("part"), (F.row_number().over(Window.orderBy(F.desc("n"), "category")) - 1).alias("k"), row(F.col("category"), F.col("n").cast("string")).alias("line"))
    top = counts.groupBy("severity", "code", "title").agg(F.sum("pages").alias("pages")).withColumn("k", F.row_number().over(Window.orderBy(rank, F.desc("pages"), "code", "title"))).where("k <= 10")
    top = top.select(F.lit(4).alias("part"), "k", row(F.col("k").cast("string"), F.col("severity"), F.col("code"), F.col("title"), F.col("pages").cast("string")).alias("line"))
    return summary.unionByName(severity).unionByName(category).unionByName(top)


@query(
    "report_markdown",
    f"""WITH {findings.SQL}, rc AS (SELECT severity, category, code, title, count(*) AS n, count(DISTINCT page_id) AS pages FROM fnd WHERE NOT is_metric GROUP BY ALL),
    sev(severity, k) AS (VALUES ('critical', 0), ('error', 1), ('warning', 2), ('info', 3)),
    top AS (SELECT severity, code, title, sum(pages) AS pages, row_number() OVER (ORDER BY CASE severity WHEN 'critical' THEN 0 WHEN 'error' THEN 1 WHEN 'warning' THEN 2 ELSE 3 END, sum(pages) DESC, code, title) AS k FROM rc GROUP BY severity, code, title)
    SELECT 1 AS part, 0 AS k, '| Pages crawled | ' || count(*) || ' |' AS line FROM pf UNION ALL SELECT 1, 1, '| Total issues | ' || coalesce(sum(n), 0) || ' |' FROM rc
    UNION ALL SELECT 1, 2, '| Total body size | ' || printf('%.2f', sum(html_bytes) / 1024.0) || ' KB |' FROM pf
    UNION ALL SELECT 2, k, '| ' || severity || ' | ' || coalesce((SELECT sum(n) FROM rc WHERE rc.severity = sev.severity), 0) || ' |' FROM sev
    UNION ALL SELECT 3, row_number() OVER (ORDER BY n DESC, category) - 1, '| ' || category || ' | ' || n || ' |' FROM (SELECT category, sum(n) AS n FROM rc GROUP BY category)
    UNION ALL SELECT 4, k, '| ' || k || ' | ' || severity || ' | ' || code || ' | ' || title || ' | ' || pages || ' |' FROM top WHERE k <= 10""",
)
def report_markdown(spark, sf_dir):
    """Table rows of a crawl's Markdown report; windows order a few counts only."""
    facts = html.page_facts(texts(spark, sf_dir, "pages"))
    counts = cut(report_counts(findings.findings(facts)))
    return markdown_report(counts, facts.agg(F.count("*").alias("pages"), F.sum("html_bytes").alias("bytes")))


def _pages(spark, sf_dir):
    return html.page_facts(texts(spark, sf_dir, "pages"))


@query("csv_export", f"WITH {findings.SQL} SELECT page_id, url, coalesce((SELECT '[' || string_agg('{{\"code\":\"' || code || '\",\"severity\":\"' || severity || '\"}}', ',' ORDER BY code, severity) || ']' FROM fnd WHERE fnd.page_id = pf.page_id), '[]') AS issues FROM pf")
def csv_export(spark, sf_dir):
    """Written as CSV, findings as JSON in a column, and read again."""
    path, pages = _shared(spark), _pages(spark, sf_dir).select("page_id", "url")
    nested(pages, findings.of(spark, sf_dir)).write.option("header", True).option("escape", '"').csv(path)
    return spark.read.schema("page_id long, url string, issues string").option("header", True).option("escape", '"').csv(path)


def _duck_markdown(e: str) -> str:
    x = f"regexp_replace(regexp_replace({e}, {html._lit(html.NOISE)}, '', 'g'), {html._lit(html.HEAD)}, '', 'g')"
    for n in range(6, 0, -1):
        x = f"regexp_replace({x}, '(?is)<h{n}\\b[^>]*>(.*?)</h{n}\\s*>', chr(10) || '{'#' * n} \\1' || chr(10), 'g')"
    x = f"regexp_replace({x}, '(?is)<a\\b[^>]*\\bhref\\s*=\\s*[\"'']([^\"'']*)[\"''][^>]*>(.*?)</a\\s*>', '[\\2](\\1)', 'g')"
    x = f"regexp_replace(regexp_replace({x}, '(?is)<li\\b[^>]*>', chr(10) || '- ', 'g'), '(?is)<br\\s*/?>|</p\\s*>', chr(10), 'g')"
    return f"trim(regexp_replace(regexp_replace({x}, '<[^>]*>', '', 'g'), '\\s*\\n\\s*', chr(10), 'g'))"


@query("page_markdown", f"SELECT page_id, {_duck_markdown('html')} AS markdown FROM pages")
def page_markdown(spark, sf_dir):
    return texts(spark, sf_dir, "pages").select("page_id", markdown().alias("markdown"))


@query("markdown_merged", f"WITH m AS (SELECT page_id, url, {_duck_markdown('html')} AS markdown FROM pages) SELECT md5(markdown) AS fingerprint, min(page_id) AS page_id, count(*) AS copies, length(arg_min(markdown, page_id)) AS chars FROM m WHERE markdown <> '' GROUP BY 1")
def markdown_merged(spark, sf_dir):
    """Pages as Markdown, one for each fingerprint: the first page has it."""
    rows = texts(spark, sf_dir, "pages").select("page_id", markdown().alias("markdown")).where("markdown <> ''")
    return rows.groupBy(F.md5(F.col("markdown").cast("binary")).alias("fingerprint")).agg(F.min("page_id").alias("page_id"), F.count("*").alias("copies"), F.length(F.min_by("markdown", "page_id")).cast("long").alias("chars"))
