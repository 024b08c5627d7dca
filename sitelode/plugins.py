"""Rules of users over whole sites, as Python table functions: partitioned by host, ordered, with the host's context.

A rule is a class: ``SiteRule``'s ``start`` gets the context, ``page`` each row of its host in order, ``finish``
gives the findings. What it raises ends that host's run without rows; other hosts go on.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf
from pyspark.sql.types import LongType, StringType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult, OrderingColumn, PartitioningColumn

from . import findings, html
from .registry import query, texts

SEVERITIES = ("critical", "error", "warning", "info")
_SCHEMA = StructType().add("host", StringType()).add("code", StringType()).add("severity", StringType()).add("title", StringType()).add("pages", LongType())


class SiteRule:
    """A user's rule over one host."""

    def start(self, context: dict[str, Any]) -> None:
        self.context = context

    def page(self, row: dict[str, Any]) -> None:
        raise NotImplementedError

    def finish(self) -> Iterator[tuple[str, str, str, int]]:
        """(code, severity, title, pages) of each finding."""
        raise NotImplementedError


def table_function(rule: type[SiteRule]):
    """A table function of (rows with a host and a page_id, context as JSON text) that runs ``rule`` for each host."""

    class Run:
        def __init__(self) -> None:
            self.rule, self.host, self.dead = None, None, False

        @staticmethod
        def analyze(rows: AnalyzeArgument, context: AnalyzeArgument) -> AnalyzeResult:
            if not rows.isTable:
                raise ValueError("the first argument is a table")
            names = {f.name for f in rows.dataType.fields}
            if not {"host", "page_id"} <= names:
                raise ValueError("rows need a host and a page_id")
            if not isinstance(json.loads(context.value or "{}"), dict):
                raise ValueError("the context is a JSON object")
            return AnalyzeResult(schema=_SCHEMA, partitionBy=[PartitioningColumn("host")], orderBy=[OrderingColumn("page_id")] + [OrderingColumn(c) for c in ("code",) if c in names])

        def eval(self, row, context: str) -> None:
            if self.dead:
                return
            try:
                if self.rule is None:
                    self.rule, self.host = rule(), row["host"]
                    self.rule.start(json.loads(context or "{}") | {"host": self.host})
                self.rule.page(row.asDict())
            except Exception:  # noqa: BLE001  a rule that fails has no findings, and must not end the audit
                self.dead = True

        def terminate(self):
            if self.dead or self.rule is None:
                return
            try:
                made = [(str(c), s if s in SEVERITIES else "info", str(t), int(n)) for c, s, t, n in self.rule.finish()]
            except Exception:  # noqa: BLE001
                return
            for code, severity, title, n in made:
                yield self.host, code, severity, title, n

    return udtf(Run)


def site_findings(rows: DataFrame, rule: type[SiteRule], context: dict[str, Any] | None = None) -> DataFrame:
    """host, code, severity, title, pages of what ``rule`` finds on each host of ``rows`` (host, page_id and more), told ``context``.

    The class must be importable on the executors, or be defined where it travels by value (a notebook, a function).
    A host's rows come to the rule one after another, in order of page_id (and code): it keeps what it needs. Unknown severities count as info.
    """
    return table_function(rule)(rows.asTable(), F.lit(json.dumps(context or {})))


class Prevalent(SiteRule):
    """Codes that at least a share of a host's pages have, ``context['share']``."""

    def start(self, context: dict[str, Any]) -> None:
        super().start(context)
        self.pages, self.last, self.codes = 0, None, {}

    def page(self, row: dict[str, Any]) -> None:
        if row["page_id"] != self.last:
            self.pages, self.last = self.pages + 1, row["page_id"]
        if row["code"] is not None:
            self.codes[row["code"]] = self.codes.get(row["code"], 0) + 1

    def finish(self) -> Iterator[tuple[str, str, str, int]]:
        if self.pages < self.context["least"]:
            return
        for code, n in sorted(self.codes.items()):
            if n >= self.context["share"] * self.pages:
                yield "SITE-" + code, "error" if n == self.pages else "notable", f"{code} on most pages", n


@query(
    "site_plugin",
    f"""WITH {findings.SQL}, n AS (SELECT host, count(*) AS pages FROM pf GROUP BY host), c AS (SELECT host, code, count(DISTINCT page_id) AS k FROM fnd JOIN pf USING (page_id) GROUP BY ALL)
    SELECT host, 'SITE-' || code AS code, CASE WHEN k = pages THEN 'error' ELSE 'info' END AS severity, code || ' on most pages' AS title, k AS pages FROM c JOIN n USING (host) WHERE n.pages >= 3 AND k >= 0.75 * n.pages""",
)
def site_plugin(spark, sf_dir):
    """A user's rule over the findings of every host."""
    facts = html.page_facts(texts(spark, sf_dir, "pages"))
    found = findings.findings(facts).select("page_id", "code").distinct()
    return site_findings(facts.select("host", "page_id").join(found, "page_id", "left"), Prevalent, {"share": 0.75, "least": 3})
