"""All rule families over one crawl: page facts, elements, response headers and cookies, structured data."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import elements, findings, html
from .registry import ORACLE_SQL, query, table, texts
from .rules import elements as element_rules
from .rules import headers, structured

COLUMNS = ["page_id", "code", "severity", "category", "title"]


def audited(pages: DataFrame, responses: DataFrame, blocks: DataFrame) -> DataFrame:
    """page_id, code, severity, category, title of every finding on ``pages`` (page_id, url, html), ``responses`` (page_id, url, headers) and ``blocks`` (page_id, json_ld)."""
    seo = F.lit("seo").alias("category")
    parts = [
        findings.findings(html.page_facts(pages)).select(COLUMNS),
        element_rules.element_findings(elements.element_facts(pages)).select(COLUMNS),
        headers.header_findings(responses).select("page_id", "code", "severity", F.lit("security").alias("category"), "title"),
        structured.structured_findings(blocks).select("page_id", "code", "severity", seo, F.concat_ws(" missing ", "type", "property").alias("title")),
    ]
    return reduce(DataFrame.unionByName, parts)


def _all(spark, sf_dir) -> DataFrame:
    plain = table(spark, sf_dir, "pages")
    return audited(elements.enriched(texts(spark, sf_dir, "pages")), headers.responses(plain), structured.made_blocks(plain))


_PAGES = elements.SQL + findings.SQL[len(html.SQL) :]
_ALL = f"""(WITH {_PAGES} SELECT page_id, code, severity, category FROM fnd) UNION ALL (SELECT page_id, code, severity, category FROM ({ORACLE_SQL["element_rules"]}))
UNION ALL (SELECT page_id, code, severity, 'security' FROM ({ORACLE_SQL["header_rules"]}), range(0, n)) UNION ALL (SELECT page_id, code, severity, 'seo' FROM ({ORACLE_SQL["sd_pages"]}))"""


@query("audit_findings", f"SELECT page_id, code, severity, category, count(*) AS n FROM ({_ALL}) GROUP BY ALL")
def audit_findings(spark, sf_dir):
    """Findings of all families on every page, with what is made up for the given ones."""
    return _all(spark, sf_dir).groupBy("page_id", "code", "severity", "category").agg(F.count("*").alias("n"))


@query("audit_by_category", f"SELECT category, severity, count(*) AS n, count(DISTINCT page_id) AS pages, count(DISTINCT code) AS codes FROM ({_ALL}) GROUP BY ALL")
def audit_by_category(spark, sf_dir):
    return _all(spark, sf_dir).groupBy("category", "severity").agg(F.count("*").alias("n"), F.countDistinct("page_id").alias("pages"), F.countDistinct("code").alias("codes"))
