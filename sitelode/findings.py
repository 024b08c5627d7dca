"""From page facts to findings: rules compiled to projections, then collapse, statistics and scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import html
from .registry import query, table, texts
from .rules.families import families
from .rules.catalogue import METRICS, RULES, SEVERITIES, UTILITY, WEIGHTS, Rule

_ROBOTS = {"noindex": "robots_noindex", "index": "robots_index", "nofollow": "robots_nofollow", "follow": "robots_follow"}


def judged(facts: DataFrame) -> DataFrame:
    """Page facts with the few columns that only rules read."""
    words = F.transform(F.split(F.coalesce(F.lower("robots"), F.lit("")), ","), lambda x: F.trim(x))
    return facts.select(
        "*",
        F.lower("url").rlike("|".join(u.replace(".", r"\.") for u in UTILITY)).alias("utility_page"),
        *[F.array_contains(words, w).alias(c) for w, c in _ROBOTS.items()],
    )


def severity_rank(severity: Column) -> Column:
    return F.array_position(F.array(*[F.lit(s) for s in SEVERITIES]), severity) - 1


def made(rules: list[Rule] = RULES) -> Column:
    """The findings of a page, an array in rule order: seq, code, severity, category, title, is_metric."""
    each = [f"CASE WHEN {r.when} THEN named_struct('seq', {k}, 'code', '{r.code}', 'severity', '{r.severity}', 'category', '{r.category}', 'title', '{r.title}', 'is_metric', {str(r.code in METRICS).lower()}) END" for k, r in enumerate(rules)]
    return F.expr(f"filter(array({', '.join(each)}), x -> x IS NOT NULL)")


def findings(facts: DataFrame, rules: list[Rule] = RULES) -> DataFrame:
    """One row for each rule that a page breaks, in rule order: page_id, url, seq, code, severity, category, title, is_metric."""
    return judged(facts).select("page_id", "url", F.inline(made(rules)))


def signature(title: Column) -> Column:
    """What a title says of a defect: no parentheses, lower case, no naming decorations."""
    bare = F.lower(F.regexp_replace(title, r"\([^()]*\)", ""))
    words = F.transform(F.split(bare, r"\s+"), lambda w: F.regexp_replace(w, r"^[^a-z0-9]+|[^a-z0-9]+$", ""))
    kept = F.filter(words, lambda w: (w != "") & ~w.rlike(r"^d[deap]*$") & ~w.rlike(r"^v[0-9]+$") & ~w.isin("schema", "structured"))
    return F.array_join(kept, " ")


def defect(code: Column, title: Column, known: dict[str, str] | None = None) -> Column:
    """The defect that a code is known to report, else what its title says."""
    known = families() if known is None else known
    return F.coalesce(F.create_map(*[F.lit(x) for pair in known.items() for x in pair])[code], signature(title))


def collapse(found: DataFrame) -> DataFrame:
    """Findings of one page that describe one defect become one; other codes stay as ``also``.

    In order of code, the first finding stands for the defect; one of a stricter severity takes its place;
    repeats of the standing code stay. A page's findings of one defect are few (one for each rule and
    element), so the fold runs over an array.
    """
    item = F.struct("code", "seq", "severity", severity_rank(F.col("severity")).cast("int").alias("rank"), "category", "title", "is_metric")
    grouped = found.groupBy("page_id", "url", defect(F.col("code"), F.col("title")).alias("defect")).agg(F.array_sort(F.collect_list(item)).alias("items"))

    def step(acc: Column, x: Column) -> Column:
        first_of = F.element_at(acc, 1)
        same = first_of["code"] == x["code"]
        stricter = x["rank"] < first_of["rank"]
        return F.when(same, F.concat(acc, F.array(x))).when(stricter, F.concat(F.array(x), F.slice(acc, 2, F.greatest(F.size(acc), F.lit(1))))).otherwise(acc)

    kept = F.aggregate(F.slice("items", 2, F.greatest(F.size("items"), F.lit(1))), F.slice("items", 1, 1), step)
    codes = F.array_distinct(F.transform("items", lambda x: x["code"]))
    return grouped.select("page_id", "url", F.explode(kept).alias("f"), codes.alias("codes")).select(
        "page_id", "url", "f.seq", "f.code", "f.severity", "f.category", "f.title", "f.is_metric", F.array_join(F.filter("codes", lambda c: c != F.col("f.code")), ",").alias("also")
    )


def weights(codes: DataFrame) -> DataFrame:
    """code, score_category and weight of the most specific pattern that matches (ties: the smaller pattern)."""
    spark = codes.sparkSession
    patterns = spark.createDataFrame(WEIGHTS, "pattern string, score_category string, weight double")
    hit = codes.select("code").distinct().join(F.broadcast(patterns), F.expr("code LIKE replace(replace(pattern, '*', '%'), '?', '_')"))
    best = F.min_by(F.struct("score_category", "weight"), F.struct(-F.length(F.regexp_replace("pattern", r"[*?]", "")), F.col("pattern")))
    return hit.groupBy("code").agg(best.alias("w")).select("code", "w.score_category", "w.weight")


def penalty(weights: Column) -> Column:
    """100 times the product of what the weights leave, largest first, so that sums of floats agree."""
    return F.lit(100.0) * F.aggregate(F.sort_array(weights, asc=False), F.lit(1.0), lambda a, w: a * (F.lit(1.0) - w))


def of(spark, sf_dir: str) -> DataFrame:
    return findings(html.page_facts(texts(spark, sf_dir, "pages")))


# --- SQL twins -------------------------------------------------------------------------------------

_robots = ", ".join(f"list_contains(list_transform(string_split(coalesce(lower(robots), ''), ','), lambda x: trim(x)), '{w}') AS {c}" for w, c in _ROBOTS.items())
_duck_rule = ", ".join(
    f"CASE WHEN {r.when.replace(chr(92) + chr(92) + '%', chr(92) + '%').replace('%' + chr(92) + '%%' + chr(39), '%' + chr(92) + '%%' + chr(39) + ' ESCAPE ' + chr(39) + chr(92) + chr(39))} THEN {{'seq': {k}, 'code': '{r.code}', 'severity': '{r.severity}', 'category': '{r.category}', 'title': '{r.title}', 'is_metric': {str(r.code in METRICS).lower()}}} END"
    for k, r in enumerate(RULES)
)
_ranks = "CASE severity " + " ".join(f"WHEN '{s}' THEN {k}" for k, s in enumerate(SEVERITIES)) + " END"
#: DuckDB: common table expressions up to fnd, one row for each finding, without WITH.
SQL = f"""{html.SQL},
pj AS (SELECT *, regexp_matches(lower(url), '{"|".join(UTILITY)}') AS utility_page, {_robots} FROM pf),
fnd AS (SELECT page_id, url, unnest(f, max_depth := 2) FROM (SELECT page_id, url, unnest(list_filter([{_duck_rule}], lambda x: x IS NOT NULL)) AS f FROM pj)),
pat(pattern, score_category, weight) AS (VALUES {", ".join(f"('{p}', '{c}', CAST({w} AS DOUBLE))" for p, c, w in WEIGHTS)}),
wts AS (
  SELECT code, score_category, weight FROM (SELECT DISTINCT code FROM fnd) JOIN pat ON code LIKE replace(replace(pattern, '*', '%'), '?', '_')
  QUALIFY row_number() OVER (PARTITION BY code ORDER BY length(replace(replace(pattern, '*', ''), '?', '')) DESC, pattern) = 1
)
"""


def _product(w: str) -> str:
    return f"100.0 * list_reduce(list_concat([CAST(1 AS DOUBLE)], list_sort(list({w}), 'DESC')), lambda a, w: a * (1 - w))"


@query("page_facts", f"WITH {html.SQL} SELECT * FROM pf")
def page_facts(spark, sf_dir):
    return html.page_facts(texts(spark, sf_dir, "pages"))


@query("findings_all", f"WITH {SQL} SELECT * FROM fnd")
def findings_all(spark, sf_dir):
    return of(spark, sf_dir)


_SIGNATURE = "array_to_string(list_filter(list_transform(regexp_split_to_array(lower(regexp_replace(title, '\\([^()]*\\)', '', 'g')), '\\s+'), lambda w: regexp_replace(w, '^[^a-z0-9]+|[^a-z0-9]+$', '', 'g')), lambda w: w <> '' AND NOT regexp_matches(w, '^d[deap]*$') AND NOT regexp_matches(w, '^v[0-9]+$') AND w NOT IN ('schema', 'structured')), ' ')"


# Rules here emit once for each page, so the strictest finding of a defect, first by code, is what stays.
@query(
    "findings_collapsed",
    f"""WITH {SQL}, fam(known, defect) AS (VALUES {", ".join(f"('{c}', '{d}')" for c, d in families().items())}),
    s AS (SELECT fnd.*, coalesce(defect, {_SIGNATURE}) AS defect, {_ranks} AS rank FROM fnd LEFT JOIN fam ON known = code),
    c AS (SELECT page_id, defect, list_sort(list(DISTINCT code)) AS codes FROM s GROUP BY ALL)
    SELECT page_id, url, seq, code, severity, category, title, is_metric, array_to_string(list_filter(codes, lambda c: c <> code), ',') AS also
    FROM s JOIN c USING (page_id, defect) QUALIFY row_number() OVER (PARTITION BY page_id, defect ORDER BY rank, code, seq) = 1""",
)
def findings_collapsed(spark, sf_dir):
    return collapse(of(spark, sf_dir))


@query("issues_by_severity", f"WITH {SQL} SELECT severity, {_ranks} AS rank, count(*) AS n FROM fnd WHERE NOT is_metric GROUP BY severity")
def issues_by_severity(spark, sf_dir):
    return of(spark, sf_dir).where("NOT is_metric").groupBy("severity", severity_rank(F.col("severity")).cast("int").alias("rank")).agg(F.count("*").alias("n"))


@query("issues_by_category", f"WITH {SQL} SELECT category, count(*) AS n FROM fnd WHERE NOT is_metric GROUP BY category")
def issues_by_category(spark, sf_dir):
    return of(spark, sf_dir).where("NOT is_metric").groupBy("category").agg(F.count("*").alias("n"))


@query("crawl_stats", f"WITH {SQL} SELECT (SELECT count(*) FROM pf) AS pages, (SELECT sum(html_bytes) FROM pf)::BIGINT AS bytes, (SELECT avg(word_count) FROM pf) AS avg_words, (SELECT count(*) FROM fnd WHERE NOT is_metric) AS issues, (SELECT count(*) FROM links) AS links")
def crawl_stats(spark, sf_dir):
    facts = judged(html.page_facts(texts(spark, sf_dir, "pages"))).select("html_bytes", "word_count", "link_count", F.size(F.filter(made(), lambda x: ~x["is_metric"])).alias("found"))
    return facts.agg(F.count("*").alias("pages"), F.sum("html_bytes").alias("bytes"), F.avg("word_count").alias("avg_words"), F.sum("link_count").alias("links"), F.sum("found").alias("issues"))


@query("metric_split", f"WITH {SQL} SELECT count(*) FILTER (is_metric) AS metrics, count(*) FILTER (NOT is_metric) AS defects FROM fnd")
def metric_split(spark, sf_dir):
    return of(spark, sf_dir).agg(F.count_if("is_metric").alias("metrics"), F.count_if(~F.col("is_metric")).alias("defects"))


def issue_filter(found: DataFrame, severity=None, category=None, page_id=None, prefix=None, kind="defect") -> DataFrame:
    """Findings by any of: severity, category, page, start of the code, and kind (defect, metric or all)."""
    for column, value in (("severity", severity), ("category", category), ("page_id", page_id)):
        if value is not None:
            found = found.where(F.col(column) == value)
    if prefix is not None:
        found = found.where(F.col("code").startswith(prefix))
    return found if kind == "all" else found.where(F.col("is_metric") == F.lit(kind == "metric"))


@query("issue_filter", f"WITH {SQL} SELECT page_id, code, title FROM fnd WHERE severity = 'warning' AND category = 'seo' AND starts_with(code, 'TITLE') AND NOT is_metric")
def issue_filter_query(spark, sf_dir):
    return issue_filter(of(spark, sf_dir), "warning", "seo", prefix="TITLE").select("page_id", "code", "title")


@query("top_issues", f"WITH {SQL} SELECT severity, code, title, count(DISTINCT page_id) AS affected FROM fnd WHERE NOT is_metric GROUP BY severity, code, title ORDER BY {_ranks}, affected DESC, code, title LIMIT 10")
def top_issues(spark, sf_dir, limit=10):
    rows = of(spark, sf_dir).where("NOT is_metric").groupBy("severity", "code", "title").agg(F.countDistinct("page_id").alias("affected"))
    return rows.orderBy(severity_rank(F.col("severity")), F.desc("affected"), "code", "title").limit(limit)


@query("issue_code_aggregates", f"WITH {SQL} SELECT code, arg_min(title, page_id * 1000 + seq) AS title, min({_ranks}) AS rank, count(*) AS n, count(DISTINCT page_id) AS pages, min(url) AS first_url FROM fnd WHERE NOT is_metric GROUP BY code")
def issue_code_aggregates(spark, sf_dir):
    rows = of(spark, sf_dir).where("NOT is_metric")
    return rows.groupBy("code").agg(
        F.min_by("title", F.struct("page_id", "seq")).alias("title"), F.min(severity_rank(F.col("severity"))).cast("int").alias("rank"), F.count("*").alias("n"), F.countDistinct("page_id").alias("pages"), F.min("url").alias("first_url")
    )


def _weighted(spark, sf_dir) -> DataFrame:
    codes = spark.createDataFrame([(r.code,) for r in RULES], "code string")
    return of(spark, sf_dir).where("NOT is_metric").join(F.broadcast(weights(codes)), "code")


_W = f"WITH {SQL}, fw AS (SELECT * FROM fnd JOIN wts USING (code) WHERE NOT is_metric)"


@query("page_scores", f"{_W} SELECT url, round({_product('weight')}, 9) AS score FROM fw GROUP BY url")
def page_scores(spark, sf_dir):
    return _weighted(spark, sf_dir).groupBy("url").agg(F.round(penalty(F.collect_list("weight")), 9).alias("score"))


@query("category_scores", f"{_W} SELECT url, score_category, round({_product('weight')}, 9) AS score FROM fw GROUP BY url, score_category")
def category_scores(spark, sf_dir):
    return _weighted(spark, sf_dir).groupBy("url", "score_category").agg(F.round(penalty(F.collect_list("weight")), 9).alias("score"))


@query("site_score", f"{_W}, p AS (SELECT url, {_product('weight')} AS score FROM fw GROUP BY url) SELECT coalesce(round(avg(greatest(0.0, least(100.0, score))), 2), 100.0) AS site_score FROM p")
def site_score(spark, sf_dir):
    rows = _weighted(spark, sf_dir).groupBy("url").agg(penalty(F.collect_list("weight")).alias("score"))
    return rows.agg(F.coalesce(F.round(F.avg(F.greatest(F.lit(0.0), F.least(F.lit(100.0), "score"))), 2), F.lit(100.0)).alias("site_score"))


@query("prioritized_fixes", f"{_W} SELECT code, score_category, weight, count(*) AS pages_affected, weight * count(*) AS impact FROM fw GROUP BY code, score_category, weight")
def prioritized_fixes(spark, sf_dir):
    rows = _weighted(spark, sf_dir).groupBy("code", "score_category", "weight").agg(F.count("*").alias("pages_affected"))
    return rows.withColumn("impact", F.col("weight") * F.col("pages_affected")).orderBy(F.desc("impact"), "code")


# Insight categories, efforts and base impacts by code prefix and severity, first match wins.
INSIGHT_CATEGORIES = [("technical", "HTTP REDIR QUALITY"), ("security", "SEC CSP HSTS"), ("performance", "PERF TTFB RESP CACHE"), ("content", "CONTENT WORD READ FRESH DUP")]
EFFORTS = [("quick", "HTTP SSL SEC MOB CSP HSTS REDIR QUALITY"), ("moderate", "SEO META CANON HREF SITEMAP HEAD ROBOT LINK GRAPH ORPHAN CANNIB KEY-C COVERAGE HEALTH"), ("significant", "CONTENT SCHEMA IMAGE DUP FRESH WORD READ")]
IMPACTS = {"critical": 100.0, "error": 75.0, "warning": 50.0, "info": 25.0}


def _by_prefix(code: Column, table: list[tuple[str, str]], default: str) -> Column:
    out = F
    for value, prefixes in table:
        out = out.when(F.upper(code).rlike("^(" + "|".join(prefixes.split()) + ")"), F.lit(value))
    return out.otherwise(F.lit(default))


def _duck_prefix(table: list[tuple[str, str]], default: str) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches(upper(code), '^({'|'.join(p.split())})') THEN '{v}'" for v, p in table) + f" ELSE '{default}' END"


_impact = "CASE rank " + " ".join(f"WHEN {k} THEN {IMPACTS[s]}" for k, s in enumerate(SEVERITIES)) + " END"


@query(
    "insights_top20",
    f"""WITH {SQL}, g AS (SELECT code, min({_ranks}) AS rank, count(DISTINCT url) AS urls FROM fnd WHERE NOT is_metric GROUP BY code),
    i AS (SELECT code, {_duck_prefix(INSIGHT_CATEGORIES, 'seo')} AS category, {_duck_prefix(EFFORTS, 'moderate')} AS effort, urls, round(CAST({_impact} AS DOUBLE) * urls / (SELECT count(*) FROM pf), 6) AS impact FROM g)
    SELECT *, CASE WHEN impact >= 75 THEN 'critical' WHEN impact >= 50 THEN 'high' WHEN impact >= 25 THEN 'medium' ELSE 'low' END AS priority
    FROM i ORDER BY impact DESC, CASE effort WHEN 'quick' THEN 0 WHEN 'moderate' THEN 1 ELSE 2 END, code LIMIT 20""",
)
def insights(spark, sf_dir, most=20):
    """Codes by impact: severity's base times the share of pages; of equal impact the least effort first."""
    total = table(spark, sf_dir, "pages").agg(F.count("*").alias("total"))
    base = F.create_map(*[x for s in SEVERITIES for x in (F.lit(SEVERITIES.index(s)), F.lit(IMPACTS[s]))])
    rows = of(spark, sf_dir).where("NOT is_metric").groupBy("code").agg(F.min(severity_rank(F.col("severity")).cast("int")).alias("rank"), F.countDistinct("url").alias("urls"))
    rows = rows.crossJoin(F.broadcast(total)).select("code", _by_prefix(F.col("code"), INSIGHT_CATEGORIES, "seo").alias("category"), _by_prefix(F.col("code"), EFFORTS, "moderate").alias("effort"), "urls", F.round(base[F.col("rank")] * F.col("urls") / F.col("total"), 6).alias("impact"))
    level = F.when(F.col("impact") >= 75, "critical").when(F.col("impact") >= 50, "high").when(F.col("impact") >= 25, "medium").otherwise("low")
    effort = F.array_position(F.array(*[F.lit(name) for name, _ in EFFORTS]), F.col("effort"))
    return rows.withColumn("priority", level).orderBy(F.desc("impact"), effort, "code").limit(most)
