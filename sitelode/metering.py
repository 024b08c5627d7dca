"""Usage metering and quotas on events: daily counters, verdicts, tumbling windows and sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .registry import query, table

#: Seconds without an event that end a session.
GAP = 1800
QUOTA = 12


def usage(events: DataFrame) -> DataFrame:
    """tenant, day_utc, unit, total; an event counts once by its key."""
    once = events.dropDuplicates(["event_id"])
    return once.groupBy((F.col("user_id") % 10).alias("tenant"), F.date_trunc("day", "ts").cast("date").alias("day_utc"), F.col("event_type").alias("unit")).agg(F.count("*").alias("total"))


_U = "WITH u AS (SELECT user_id % 10 AS tenant, CAST(date_trunc('day', ts) AS DATE) AS day_utc, event_type AS unit, count(*) AS total FROM (SELECT DISTINCT ON (event_id) * FROM events) GROUP BY ALL)"


@query("usage_daily", f"{_U} SELECT * FROM u")
def usage_daily(spark, sf_dir):
    return usage(table(spark, sf_dir, "events"))


@query("quota_verdict", f"{_U} SELECT *, CASE WHEN total >= {QUOTA} THEN 'exhausted' WHEN total + 5 > {QUOTA} THEN 'partial' ELSE 'allowed' END AS verdict FROM u")
def quota_verdict(spark, sf_dir, quota=QUOTA, requested=5):
    verdict = F.when(F.col("total") >= quota, "exhausted").when(F.col("total") + requested > quota, "partial").otherwise("allowed")
    return usage(table(spark, sf_dir, "events")).withColumn("verdict", verdict)


@query("usage_purge", f"{_U} SELECT * FROM u WHERE tenant NOT IN (3, 4)")
def usage_purge(spark, sf_dir):
    """What stays after two tenants are purged."""
    rows = usage(table(spark, sf_dir, "events"))
    gone = spark.createDataFrame([(3,), (4,)], "tenant long")
    return rows.join(F.broadcast(gone), "tenant", "left_anti")


@query("events_tumbling", "SELECT time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01') AS window_start, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY ALL")
def events_tumbling(spark, sf_dir):
    w = F.window(F.col("ts").cast("timestamp"), "6 hours")
    return table(spark, sf_dir, "events").groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 6).alias("total")).select(F.col("w.start").cast("timestamp_ntz").alias("window_start"), "event_type", "n", "total")


@query(
    "events_sessionized",
    f"""WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= INTERVAL {GAP} SECOND THEN 0 ELSE 1 END AS starts FROM events),
    s AS (SELECT *, sum(starts) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS session FROM g)
    SELECT user_id, CAST(session AS BIGINT) AS session, min(ts) AS started, max(ts) AS ended, count(*) AS n FROM s GROUP BY user_id, session""",
)
def events_sessionized(spark, sf_dir):
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    gap = F.expr(f"ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= INTERVAL '{GAP}' SECOND")
    rows = table(spark, sf_dir, "events").withColumn("starts", F.when(gap, 0).otherwise(1))
    rows = rows.withColumn("session", F.sum("starts").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy("user_id", "session").agg(F.min("ts").alias("started"), F.max("ts").alias("ended"), F.count("*").alias("n"))
