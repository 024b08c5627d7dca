"""Crawl against crawl: differences, vitals, alerts, series and trends; and the audit chain."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import findings, html
from .plans.scratch import cut
from .registry import query, table, texts


def crawls(spark, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Page facts as they are, and a second crawl: some pages gone, some changed, some new."""
    base = html.page_facts(texts(spark, sf_dir, "pages")).select("page_id", "url", "title", "word_count", "html_bytes")
    p = F.col("page_id")
    later = base.where("page_id % 17 <> 0").select(
        "page_id",
        F.when(p % 19 == 0, F.concat("url", F.lit("new"))).otherwise(F.col("url")).alias("url"),
        F.when(p % 5 == 0, F.concat("title", F.lit(" changed"))).otherwise(F.col("title")).alias("title"),
        F.when(p % 7 == 0, F.lit(None).cast("long")).when(p % 5 == 0, F.col("word_count") + 40).otherwise(F.col("word_count")).alias("word_count"),
        F.when(p % 4 == 0, F.col("html_bytes") + F.floor(F.col("html_bytes") / 8)).otherwise(F.col("html_bytes")).alias("html_bytes"),
    )
    return base, later


_TWO = f"""WITH {html.SQL}, a AS (SELECT page_id, url, title, word_count, html_bytes FROM pf), b AS (
  SELECT page_id, CASE WHEN page_id % 19 = 0 THEN url || 'new' ELSE url END AS url, CASE WHEN page_id % 5 = 0 THEN title || ' changed' ELSE title END AS title,
    CASE WHEN page_id % 7 = 0 THEN NULL WHEN page_id % 5 = 0 THEN word_count + 40 ELSE word_count END AS word_count,
    CASE WHEN page_id % 4 = 0 THEN html_bytes + html_bytes // 8 ELSE html_bytes END AS html_bytes FROM a WHERE page_id % 17 <> 0),
ua AS (SELECT * FROM a QUALIFY row_number() OVER (PARTITION BY url ORDER BY page_id) = 1), ub AS (SELECT * FROM b QUALIFY row_number() OVER (PARTITION BY url ORDER BY page_id) = 1),
j AS (SELECT coalesce(x.url, y.url) AS url, x.page_id AS p, y.page_id AS q, x.title AS t1, y.title AS t2, x.word_count AS w1, y.word_count AS w2, x.html_bytes AS s1, y.html_bytes AS s2 FROM ua x FULL JOIN ub y ON x.url = y.url)"""
_CONTENT = "(w1 IS NULL) <> (w2 IS NULL) OR coalesce(abs(w1 - w2) > floor(w1 * CAST(0.10 AS DOUBLE)) OR abs(w1 - w2) > 100, false)"
_SIZE = "(s1 IS NULL) <> (s2 IS NULL) OR coalesce(abs(s1 - s2) > floor(s1 * CAST(0.10 AS DOUBLE)), false)"
_KIND = f"CASE WHEN p IS NULL THEN ['added'] WHEN q IS NULL THEN ['removed'] ELSE list_filter([CASE WHEN t1 IS DISTINCT FROM t2 THEN 'title' END, CASE WHEN {_CONTENT} THEN 'content' END, CASE WHEN {_SIZE} THEN 'size' END], lambda x: x IS NOT NULL) END"


def change_kinds() -> Column:
    """What changed between two rows of a page: p, t1, w1, s1 of the first and q, t2, w2, s2 of the second."""
    return F.when(F.col("p").isNull(), F.array(F.lit("added"))).when(F.col("q").isNull(), F.array(F.lit("removed"))).otherwise(F.array_compact(F.array(F.expr("CASE WHEN t1 IS DISTINCT FROM t2 THEN 'title' END"), F.expr(f"CASE WHEN {_CONTENT} THEN 'content' END"), F.expr(f"CASE WHEN {_SIZE} THEN 'size' END"))))


def diff(base: DataFrame, later: DataFrame) -> DataFrame:
    """url, change: added, removed, or each of title, content and size that changed for pages of both crawls."""
    first = lambda d: d.groupBy("url").agg(F.min_by(F.struct("page_id", "title", "word_count", "html_bytes"), "page_id").alias("r")).select("url", "r.*")
    x, y = first(base).alias("x"), first(later).alias("y")
    j = x.join(y, "url", "full_outer").select("url", F.col("x.page_id").alias("p"), F.col("y.page_id").alias("q"), F.col("x.title").alias("t1"), F.col("y.title").alias("t2"), F.col("x.word_count").alias("w1"), F.col("y.word_count").alias("w2"), F.col("x.html_bytes").alias("s1"), F.col("y.html_bytes").alias("s2"))
    return j.select("url", F.explode(change_kinds()).alias("change"))


@query("crawl_diff", f"{_TWO} SELECT url, unnest({_KIND}) AS change FROM j")
def crawl_diff(spark, sf_dir):
    return diff(*crawls(spark, sf_dir))


@query("crawl_diff_counts", f"{_TWO}, d AS (SELECT url, unnest({_KIND}) AS change FROM j) SELECT change, count(*) AS n FROM d GROUP BY change")
def crawl_diff_counts(spark, sf_dir):
    return crawl_diff(spark, sf_dir).groupBy("change").agg(F.count("*").alias("n"))


@query("monitor_alerts", f"{_TWO}, d AS (SELECT url, unnest({_KIND}) AS change FROM j), s AS (SELECT change, count(*) AS n, CASE change WHEN 'removed' THEN 'critical' WHEN 'title' THEN 'warning' WHEN 'content' THEN 'warning' ELSE 'info' END AS severity, list_sort(list(url))[1:3] AS urls FROM d GROUP BY change) SELECT change, n, severity, array_to_string(urls, ' ') AS urls FROM s")
def monitor_alerts(spark, sf_dir, urls=3):
    """Changes by kind with a severity and the first few URLs."""
    severity = F.when(F.col("change") == "removed", "critical").when(F.col("change").isin("title", "content"), "warning").otherwise("info")
    told = cut(crawl_diff(spark, sf_dir))
    # only the first few URLs of each task and kind reach the window
    first = told.withColumn("k", F.row_number().over(Window.partitionBy("change").orderBy("url"))).where(F.col("k") <= urls)
    first = first.groupBy("change").agg(F.array_join(F.array_sort(F.collect_list("url")), " ").alias("urls"))
    return told.groupBy("change").agg(F.count("*").alias("n")).join(first, "change").select("change", "n", "urls", severity.alias("severity"))


_CWV = """v AS (SELECT page_id, 1000 + page_id * 7 % 4000 AS lcp, page_id * 3 % 600 AS inp, page_id % 40 / 100.0 AS cls FROM pages), w AS (SELECT page_id, CAST(lcp AS DOUBLE) AS lcp, CAST(inp AS DOUBLE) AS inp, CAST(cls AS DOUBLE) AS cls FROM v),
n AS (SELECT page_id, lcp * (1 + (page_id % 5) * CAST(0.05 AS DOUBLE)) AS lcp, inp * (1 + (page_id % 3) * CAST(0.08 AS DOUBLE)) AS inp, cls AS cls FROM w)"""


def _vitals(spark, sf_dir):
    p = F.col("page_id")
    old = table(spark, sf_dir, "pages").select("page_id", (1000 + p * 7 % 4000).cast("double").alias("lcp"), (p * 3 % 600).cast("double").alias("inp"), ((p % 40) / 100.0).alias("cls"))
    new = old.select("page_id", (F.col("lcp") * (1 + (p % 5) * F.lit(0.05))).alias("lcp"), (F.col("inp") * (1 + (p % 3) * F.lit(0.08))).alias("inp"), "cls")
    return old, new


def vitals_long(df: DataFrame) -> DataFrame:
    return df.select("page_id", F.expr("stack(3, 'lcp', lcp, 'inp', inp, 'cls', cls) AS (metric, value)"))


@query("cwv_regressions", f"WITH {_CWV}, a AS (UNPIVOT w ON lcp, inp, cls INTO NAME metric VALUE old), b AS (UNPIVOT n ON lcp, inp, cls INTO NAME metric VALUE new) SELECT page_id, metric, round(old, 6) AS old, round(new, 6) AS new FROM a JOIN b USING (page_id, metric) WHERE abs(old) > 1e-12 AND (new - old) / abs(old) > CAST(0.10 AS DOUBLE)")
def cwv_regressions(spark, sf_dir):
    """Vitals that got worse by more than a tenth; an old value of zero says nothing."""
    old, new = (vitals_long(x) for x in _vitals(spark, sf_dir))
    j = old.withColumnRenamed("value", "old").join(new.withColumnRenamed("value", "new"), ["page_id", "metric"])
    return j.where("abs(old) > 1e-12 AND (new - old) / abs(old) > CAST(0.10 AS DOUBLE)").select("page_id", "metric", F.round("old", 6).alias("old"), F.round("new", 6).alias("new"))


# Bounds of good and poor vitals.
_BOUNDS = {"lcp": (2500, 4000), "inp": (200, 500), "cls": (0.1, 0.25)}
_CASE = "CASE metric " + " ".join(f"WHEN '{m}' THEN CASE WHEN value <= CAST({a} AS DOUBLE) THEN 'good' WHEN value <= CAST({b} AS DOUBLE) THEN 'needs-improvement' ELSE 'poor' END" for m, (a, b) in _BOUNDS.items()) + " END"


@query("cwv_classes", f"WITH {_CWV}, a AS (UNPIVOT w ON lcp, inp, cls INTO NAME metric VALUE value) SELECT metric, {_CASE} AS class, count(*) AS n, round(avg(value), 6) AS mean FROM a GROUP BY 1, 2")
def cwv_classes(spark, sf_dir):
    return vitals_long(_vitals(spark, sf_dir)[0]).groupBy("metric", F.expr(_CASE).alias("class")).agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"))


_SNAP = "s AS (SELECT CAST(date_trunc('day', ts) AS DATE) AS day, count(*) AS pages, count(*) FILTER (event_id % 9 = 0) AS issues FROM events GROUP BY 1), h AS (SELECT *, greatest(0.0, least(1.0, 1 - CAST(issues AS DOUBLE) / pages)) AS score, row_number() OVER (ORDER BY day) - 1 AS i FROM s)"


def _snapshots(spark, sf_dir):
    s = table(spark, sf_dir, "events").groupBy(F.date_trunc("day", "ts").cast("date").alias("day")).agg(F.count("*").alias("pages"), F.count_if(F.col("event_id") % 9 == 0).alias("issues"))
    return s.withColumn("score", F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - F.col("issues") / F.col("pages"))))


_ROWS = "hs AS (SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS run_id, ts, event_id, 'page ' || user_id % 40 AS page, event_type AS category, 'metric ' || event_id % 3 AS metric, value FROM events)"


def _history(spark, sf_dir):
    """run_id, ts, page, category, metric, value (event_id tells rows of one time apart): events as rows of a history."""
    e, text = table(spark, sf_dir, "events"), lambda word, n: F.concat(F.lit(word), n.cast("string"))
    return e.select(F.col("ts").cast("date").cast("string").alias("run_id"), "ts", "event_id", text("page ", F.col("user_id") % 40).alias("page"), F.col("event_type").alias("category"), text("metric ", F.col("event_id") % 3).alias("metric"), "value")


def series(rows: DataFrame) -> DataFrame:
    """page, category, metric, samples, first, last and delta of each series, in order of time and run."""
    order = F.struct("ts", "run_id", "event_id")
    return rows.groupBy("page", "category", "metric").agg(F.count("*").alias("samples"), F.min_by("value", order).alias("first"), F.max_by("value", order).alias("last")).withColumn("delta", F.col("last") - F.col("first"))


@query("history_series", f"WITH {_ROWS} SELECT page, category, metric, count(*) AS samples, arg_min(value, (ts, run_id, event_id)) AS first, arg_max(value, (ts, run_id, event_id)) AS last, arg_max(value, (ts, run_id, event_id)) - arg_min(value, (ts, run_id, event_id)) AS delta FROM hs GROUP BY page, category, metric")
def history_series(spark, sf_dir):
    return series(_history(spark, sf_dir))


@query("history_runs", f"WITH {_ROWS} SELECT run_id, min(ts) AS first_ts, count(*) AS n FROM hs GROUP BY run_id")
def history_runs(spark, sf_dir):
    return _history(spark, sf_dir).groupBy("run_id").agg(F.min("ts").alias("first_ts"), F.count("*").alias("n"))


@query("latest_runs", f"WITH {_ROWS}, r AS (SELECT run_id, min(ts) AS first_ts FROM hs GROUP BY run_id) SELECT run_id, row_number() OVER (ORDER BY first_ts DESC, run_id DESC) AS back FROM r QUALIFY back <= 2")
def latest_runs(spark, sf_dir):
    """The latest run (1) and the one before it (2): that is what is asked for."""
    last = history_runs(spark, sf_dir).orderBy(F.desc("first_ts"), F.desc("run_id")).limit(2)
    return last.withColumn("back", F.row_number().over(Window.orderBy(F.desc("first_ts"), F.desc("run_id"))).cast("long")).select("run_id", "back")


@query("regression_deltas", f"WITH {_ROWS}, r AS (SELECT run_id, count(*) FILTER (category = 'error') AS errors, count(*) FILTER (category <> 'error') AS others, avg(value) AS level FROM hs GROUP BY run_id), d AS (SELECT run_id, errors - lag(errors) OVER (ORDER BY run_id) AS new_errors, lag(others) OVER (ORDER BY run_id) - others AS removed, round(level - lag(level) OVER (ORDER BY run_id), 6) AS change FROM r) SELECT run_id, greatest(new_errors, 0) AS new_errors, greatest(removed, 0) AS removed, change, new_errors > 0 OR removed > 5 AS regressed FROM d WHERE new_errors IS NOT NULL")
def regression_deltas(spark, sf_dir, most_removed=5):
    """Each run against the one before (runs are few): more errors, fewer other rows, change of the level; and whether a gate would close."""
    r = _history(spark, sf_dir).groupBy("run_id").agg(F.count_if(F.col("category") == "error").alias("errors"), F.count_if(F.col("category") != "error").alias("others"), F.avg("value").alias("level"))
    before = lambda c: F.lag(c).over(Window.orderBy("run_id"))
    d = r.select("run_id", (F.col("errors") - before("errors")).alias("new_errors"), (before("others") - F.col("others")).alias("removed"), F.round(F.col("level") - before("level"), 6).alias("change")).where("new_errors IS NOT NULL")
    return d.select("run_id", F.greatest("new_errors", F.lit(0)).alias("new_errors"), F.greatest("removed", F.lit(0)).alias("removed"), "change", ((F.col("new_errors") > 0) | (F.col("removed") > most_removed)).alias("regressed"))


def content_change(before, later):
    """How severe a change of the number of words is: by more than a half, by more than a fifth."""
    share = F.abs(later - before) / before
    return F.when(before.isNull() & later.isNull(), "info").when(before.isNull() | later.isNull() | (before <= 0), "warning").when(share > 0.5, "critical").when(share > 0.2, "warning").otherwise("info")


@query("content_changes", f"{_TWO} SELECT url, w1, w2, CASE WHEN w1 IS NULL AND w2 IS NULL THEN 'info' WHEN w1 IS NULL OR w2 IS NULL OR w1 <= 0 THEN 'warning' WHEN abs(w2 - w1) / CAST(w1 AS DOUBLE) > CAST(0.5 AS DOUBLE) THEN 'critical' WHEN abs(w2 - w1) / CAST(w1 AS DOUBLE) > CAST(0.2 AS DOUBLE) THEN 'warning' ELSE 'info' END AS severity FROM j WHERE p IS NOT NULL AND q IS NOT NULL")
def content_changes(spark, sf_dir):
    """For pages of both crawls, how severe the change of their length is."""
    first = lambda d, c: d.groupBy("url").agg(F.min_by(F.struct("word_count"), "page_id").alias("r")).select("url", F.col("r.word_count").alias(c))
    base, later = crawls(spark, sf_dir)
    return first(base, "w1").join(first(later, "w2"), "url").withColumn("severity", content_change(F.col("w1"), F.col("w2")))


@query("health_trend", f"WITH {_SNAP}, t AS (SELECT count(*) AS points, coalesce(regr_slope(score, i), 0) AS slope, avg(score) AS mean, arg_min(score, day) AS first, arg_max(score, day) AS last FROM h) SELECT points, round(slope, 9) AS slope, round(first, 9) AS first, round(last, 9) AS last, CASE WHEN mean > 0 AND slope / mean > 0.05 THEN 'improving' WHEN mean > 0 AND slope / mean < -0.05 THEN 'declining' ELSE 'stable' END AS direction FROM t")
def health_trend(spark, sf_dir):
    x = _snapshots(spark, sf_dir).withColumn("i", F.row_number().over(Window.orderBy("day")) - 1)
    t = x.agg(F.count("*").alias("points"), F.coalesce(F.regr_slope("score", "i"), F.lit(0.0)).alias("slope"), F.avg("score").alias("mean"), F.min_by("score", "day").alias("first"), F.max_by("score", "day").alias("last"))
    share = F.when(F.col("mean") > 0, F.col("slope") / F.col("mean")).otherwise(0.0)
    return t.select("points", F.round("slope", 9).alias("slope"), F.round("first", 9).alias("first"), F.round("last", 9).alias("last"), F.when(share > 0.05, "improving").when(share < -0.05, "declining").otherwise("stable").alias("direction"))


@query("history_snapshot", f"WITH {findings.SQL} SELECT url, category, count(*) AS n FROM fnd WHERE NOT is_metric GROUP BY url, category")
def history_snapshot(spark, sf_dir):
    return findings.of(spark, sf_dir).where("NOT is_metric").groupBy("url", "category").agg(F.count("*").alias("n"))


_HASH = "sha256(CAST(event_id AS VARCHAR) || chr(0) || CAST(user_id AS VARCHAR) || chr(0) || event_type || chr(0) || coalesce(props, ''))"
_AUDIT = f"WITH c AS (SELECT *, {_HASH} AS own FROM events), l AS (SELECT *, CASE WHEN event_id % 501 = 7 THEN 'tampered' ELSE coalesce(lag(own) OVER (PARTITION BY user_id ORDER BY event_id), '') END AS previous_hash FROM c)"


def _chain(spark, sf_dir):
    own = F.sha2(F.concat_ws("\0", F.col("event_id").cast("string"), F.col("user_id").cast("string"), "event_type", F.coalesce("props", F.lit(""))), 256)
    order = Window.partitionBy("user_id").orderBy("event_id")
    rows = table(spark, sf_dir, "events").withColumn("own", own)
    return rows.withColumn("previous_hash", F.when(F.col("event_id") % 501 == 7, F.lit("tampered")).otherwise(F.coalesce(F.lag("own").over(order), F.lit(""))))


@query("audit_chain_verify", f"{_AUDIT} SELECT user_id, count(*) AS n, count(*) FILTER (previous_hash <> want) AS broken FROM (SELECT *, coalesce(lag(own) OVER (PARTITION BY user_id ORDER BY event_id), '') AS want FROM l) GROUP BY user_id")
def audit_chain_verify(spark, sf_dir):
    """Entries whose previous_hash is not the hash of the entry before, by actor."""
    want = F.coalesce(F.lag("own").over(Window.partitionBy("user_id").orderBy("event_id")), F.lit(""))
    return _chain(spark, sf_dir).withColumn("ok", F.col("previous_hash") == want).groupBy("user_id").agg(F.count("*").alias("n"), F.count_if(~F.col("ok")).alias("broken"))


@query("history_scores", f"WITH {findings.SQL}, fw AS (SELECT * FROM fnd JOIN wts USING (code) WHERE NOT is_metric) SELECT url, category, round({findings._product('weight')}, 9) AS score FROM fw GROUP BY url, category")
def history_scores(spark, sf_dir):
    """Snapshot rows of scores by page and category."""
    return findings._weighted(spark, sf_dir).groupBy("url", "category").agg(F.round(findings.penalty(F.collect_list("weight")), 9).alias("score"))


def gate(errors, warnings, score, most_errors=0, most_warnings=None, least_score=None, new_errors=0):
    """The code a report ends with: 10 for errors, also new ones, 11 for warnings, 12 for a low score, 0 else, in that order."""
    out = F.when((errors > most_errors) | F.lit(new_errors > 0), 10)
    if most_warnings is not None:
        out = out.when(warnings > most_warnings, 11)
    if least_score is not None:
        out = out.when(score < least_score, 12)
    return out.otherwise(0)


_GATE = f"WITH {findings.SQL}, fw AS (SELECT * FROM fnd JOIN wts USING (code) WHERE NOT is_metric), c AS (SELECT count(*) FILTER (severity IN ('critical', 'error')) AS errors, count(*) FILTER (severity = 'warning') AS warnings FROM fw), s AS (SELECT coalesce(round(avg(greatest(0.0, least(100.0, score))), 2), 100.0) AS score FROM (SELECT {findings._product('weight')} AS score FROM fw GROUP BY url))"


@query("ci_gate", f"{_GATE} SELECT errors, warnings, score, CASE WHEN errors > 100 THEN 10 WHEN warnings > 1000 THEN 11 ELSE 0 END AS exit_code, CASE WHEN errors > 10000000 THEN 10 WHEN score < 99.9 THEN 12 ELSE 0 END AS by_score, 10 AS by_baseline FROM c, s")
def ci_gate(spark, sf_dir, errors=100, warnings=1000):
    """Counts, site score and the exit codes of three gates: of counts, of the score, and against a baseline with fewer errors."""
    by_page = findings._weighted(spark, sf_dir).groupBy("url").agg(F.count_if(F.col("severity").isin("critical", "error")).alias("e"), F.count_if(F.col("severity") == "warning").alias("w"), findings.penalty(F.collect_list("weight")).alias("s"))
    s = by_page.agg(F.coalesce(F.sum("e"), F.lit(0)).alias("errors"), F.coalesce(F.sum("w"), F.lit(0)).alias("warnings"), F.coalesce(F.round(F.avg(F.greatest(F.lit(0.0), F.least(F.lit(100.0), "s"))), 2), F.lit(100.0)).alias("score"))
    e, w, c = F.col("errors"), F.col("warnings"), F.col("score")
    return s.select("errors", "warnings", "score", gate(e, w, c, errors, warnings).alias("exit_code"), gate(e, w, c, 10_000_000, None, 99.9).alias("by_score"), gate(e, w, c, 10_000_000, new_errors=1).alias("by_baseline"))
