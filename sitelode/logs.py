"""Access logs: lines in the combined format or as JSON, and what they say of crawlers and errors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .registry import query, table

# Fixed value: the combined log format; a request has a method, a URL and a protocol.
COMBINED = r'^(\S+) \S+ \S+ \[([^\]]+)\] "(\S+) (\S+) [^"]*" (\d{3}) (\d+|-) "([^"]*)" "([^"]*)"'
FIELDS = ["ip", "timestamp", "method", "url", "status", "size", "referer", "user_agent"]
# Crawlers by a part of their user agent; the first that fits counts.
AGENTS = [("Googlebot", "googlebot"), ("Bingbot", "bingbot"), ("YandexBot", "yandex"), ("Slackbot", "slackbot"), ("Other Bot", "bot"), ("Other Bot", "crawler"), ("Other Bot", "spider")]
JSON = "ip string, timestamp string, method string, url string, status int, size long, referer string, user_agent string"


def parse(lines: DataFrame, format: str = "combined") -> DataFrame:
    """``lines`` (value) as log entries; lines of another form are left out, a size of ``-`` is 0."""
    if format == "json":
        return lines.select(F.from_json("value", JSON).alias("e")).where("e.ip IS NOT NULL").select("e.*")
    v = F.col("value")
    part = [F.regexp_extract(v, COMBINED, k + 1) for k in range(8)]
    part[4], part[5] = part[4].cast("int"), F.when(part[5] == "-", F.lit(0)).otherwise(part[5].try_cast("long")).cast("long")
    return lines.where(v.rlike(COMBINED)).select(*[p.alias(n) for p, n in zip(part, FIELDS)])


def agent_class(user_agent: Column, own: str | None = None) -> Column:
    """Crawler of a user agent; ``own`` is the auditor's own product token, told apart first."""
    u, out = F.lower(user_agent), F
    for name, mark in [*([("Own", own.lower())] if own else []), *AGENTS]:
        out = out.when(u.contains(mark), F.lit(name))
    return out.otherwise("Human")


_UA = ["Mozilla/5.0 (X11; Linux)", "Mozilla/5.0 (compatible; Googlebot/2.1)", "bingbot/2.0", "YandexBot/3.0", "SomeSpider/1.0", "curl/8.0"]
_array = lambda xs: ", ".join(f"'{x}'" for x in xs)


def lines_of(events: DataFrame) -> DataFrame:
    """Events written as access-log lines, a few of them malformed."""
    e = F.col("event_id")
    line = F.concat(
        F.lit("10.0."), (F.col("user_id") % 256).cast("string"), F.lit("."), (e % 7).cast("string"), F.lit(" - - ["), F.date_format("ts", "dd/MMM/yyyy:HH:mm:ss"), F.lit(' +0000] "GET /'),
        F.col("event_type"), F.lit("/"), (e % 40).cast("string"), F.when(e % 89 == 0, '" ').otherwise(' HTTP/1.1" '),
        F.when(e % 11 == 0, "404").when(e % 23 == 0, "500").otherwise("200"), F.lit(" "), F.when(e % 13 == 0, "-").otherwise((e * 3).cast("string")),
        F.lit(' "-" "'), F.element_at(F.array(*[F.lit(x) for x in _UA]), (e % 6 + 1).cast("int")), F.lit('"'),
    )
    return events.select(F.when(e % 97 == 0, F.lit("not a log line")).otherwise(line).alias("value"))


_LINES = f"""WITH l AS (SELECT CASE WHEN event_id % 97 = 0 THEN 'not a log line' ELSE '10.0.' || user_id % 256 || '.' || event_id % 7 || ' - - [' || strftime(ts, '%d/%b/%Y:%H:%M:%S') || ' +0000] "GET /' || event_type || '/' || event_id % 40 || CASE WHEN event_id % 89 = 0 THEN '" ' ELSE ' HTTP/1.1" ' END
  || CASE WHEN event_id % 11 = 0 THEN '404' WHEN event_id % 23 = 0 THEN '500' ELSE '200' END || ' ' || CASE WHEN event_id % 13 = 0 THEN '-' ELSE CAST(event_id * 3 AS VARCHAR) END || ' "-" "' || [{_array(_UA)}][event_id % 6 + 1] || '"' END AS value FROM events),
a AS (SELECT {", ".join((f"CAST(regexp_extract(value, '{COMBINED}', {k + 1}) AS INTEGER)" if n == "status" else f"CASE WHEN regexp_extract(value, '{COMBINED}', 6) = '-' THEN 0 ELSE CAST(regexp_extract(value, '{COMBINED}', 6) AS BIGINT) END" if n == "size" else f"regexp_extract(value, '{COMBINED}', {k + 1})") + f" AS {n}" for k, n in enumerate(FIELDS))} FROM l WHERE regexp_matches(value, '{COMBINED}'))"""
_CLASS = "CASE " + " ".join(f"WHEN contains(lower(user_agent), '{m}') THEN '{n}'" for n, m in AGENTS) + " ELSE 'Human' END"


def _entries(spark, sf_dir):
    return parse(lines_of(table(spark, sf_dir, "events")))


@query("access_log_entries", f"{_LINES} SELECT * FROM a")
def access_log_entries(spark, sf_dir):
    return _entries(spark, sf_dir)


@query("access_log_json", f"{_LINES} SELECT * FROM a")
def access_log_json(spark, sf_dir):
    lines = _entries(spark, sf_dir).select(F.to_json(F.struct(*FIELDS)).alias("value"))
    return parse(lines, "json")


@query("access_log_crawlers", f"{_LINES} SELECT {_CLASS} AS crawler, count(*) AS n, sum(size)::BIGINT AS bytes FROM a GROUP BY 1")
def access_log_crawlers(spark, sf_dir):
    return _entries(spark, sf_dir).groupBy(agent_class(F.col("user_agent")).alias("crawler")).agg(F.count("*").alias("n"), F.sum("size").alias("bytes"))


@query("access_log_status", f"{_LINES} SELECT status, count(*) AS n FROM a GROUP BY status")
def access_log_status(spark, sf_dir):
    return _entries(spark, sf_dir).groupBy("status").agg(F.count("*").alias("n"))


@query("access_log_top_urls", f"{_LINES} SELECT url, count(*) AS n FROM a GROUP BY url ORDER BY n DESC, url LIMIT 20")
def access_log_top_urls(spark, sf_dir):
    return _entries(spark, sf_dir).groupBy("url").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "url").limit(20)


@query("access_log_error_urls", f"{_LINES} SELECT DISTINCT url FROM a WHERE status >= 400")
def access_log_error_urls(spark, sf_dir):
    return _entries(spark, sf_dir).where("status >= 400").select("url").distinct()


def access_filter(entries: DataFrame, user=None, key=None, action=None, resource=None, after=None, before=None, failed_only=False) -> DataFrame:
    """``entries`` (user, key, action, resource, at, success) by any of seven conditions; ``action`` is a start, both times are exclusive."""
    for column, value in (("user", user), ("key", key), ("resource", resource)):
        if value is not None:
            entries = entries.where(F.col(column) == value)
    if action is not None:
        entries = entries.where(F.col("action").startswith(action))
    if after is not None:
        entries = entries.where(F.col("at") > after)
    if before is not None:
        entries = entries.where(F.col("at") < before)
    return entries.where("NOT success") if failed_only else entries


def kept_entries(written: int, most: int) -> int:
    """How many entries a log of ``most`` holds after ``written``: when it is full, the oldest tenth goes before the next."""
    if written <= most:
        return written
    tenth = most // 10
    return most - tenth + 1 + (written - most - 1) % tenth if tenth else written


def _audit(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.select("event_id", (F.col("user_id") % 50).alias("user"), (F.col("user_id") % 7).alias("key"), "event_type", F.concat("event_type", F.lit(":"), (F.col("event_id") % 4).cast("string")).alias("action"), (F.col("event_id") % 10).alias("resource"), "ts", F.col("event_id").alias("at"), (F.col("event_id") % 5 != 0).alias("success"))


@query("access_filter", "SELECT event_id FROM events WHERE user_id % 7 = 3 AND starts_with(event_type || ':' || event_id % 4, event_type || ':0') AND event_id > 100 AND event_id < 9000 AND event_id % 5 = 0 AND event_id % 10 = 0")
def access_filter_query(spark, sf_dir):
    rows = access_filter(_audit(spark, sf_dir), key=3, resource=0, after=100, before=9000, failed_only=True)
    return rows.where(F.col("action").endswith(":0")).select("event_id")


@query("access_ring", "SELECT event_id FROM events QUALIFY row_number() OVER (ORDER BY event_id DESC) <= (SELECT CASE WHEN count(*) <= 300 THEN count(*) ELSE 271 + (count(*) - 301) % 30 END FROM events)")
def access_ring(spark, sf_dir, most=300):
    """What a log of 300 entries holds at the end: the size of the log is the feature."""
    rows = table(spark, sf_dir, "events").select("event_id")
    return rows.orderBy(F.desc("event_id")).limit(kept_entries(rows.count(), most))


@query("status_changes", f"{_LINES}, b AS (SELECT url, arg_min(status, timestamp || ip || status) AS before, arg_max(status, timestamp || ip || status) AS later FROM a GROUP BY url) SELECT url, before, later, CASE WHEN before BETWEEN 200 AND 299 AND later >= 400 THEN 'critical' WHEN before <> later THEN 'warning' ELSE 'info' END AS severity FROM b")
def status_changes(spark, sf_dir):
    """How severe the change of each URL's status is, from its least to its greatest log time."""
    order = F.concat("timestamp", "ip", F.col("status").cast("string"))
    rows = _entries(spark, sf_dir).groupBy("url").agg(F.min_by("status", order).alias("before"), F.max_by("status", order).alias("later"))
    return rows.withColumn("severity", status_change(F.col("before"), F.col("later")))


def status_change(before: Column, later: Column) -> Column:
    return F.when(before.between(200, 299) & (later >= 400), "critical").when(before != later, "warning").otherwise("info")
