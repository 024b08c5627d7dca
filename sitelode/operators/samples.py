"""Bottom-k samples: of each group the rows whose hashed ids are least, whatever the order or the partitions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..registry import query, table

#: Hex digits of the md5 that make a priority: 52 bits.
_DIGITS = 13


def priority(id: Column, seed: str = "") -> Column:
    """A number that looks random and depends on the id and seed alone."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(seed), id.cast("string"))), 1, _DIGITS), 16, 10).cast("long")


def kept(rows: DataFrame, group: str, k: int) -> DataFrame:
    """The ``k`` rows (group, id, priority, ...) of least priority of each group.

    Groups are cut by bits of the priority first, so that a crowded group meets in one task with few rows a part only.
    """
    parts = F.pmod("priority", F.lit(64))
    for by in ([group, parts], [group]):
        order = Window.partitionBy(*by).orderBy("priority", "id")
        rows = rows.withColumn("k", F.dense_rank().over(order)).where(F.col("k") <= k).drop("k")  # repeated rows share a place
    return rows


def bottom_k(rows: DataFrame, group: str, id: str, value: str, k: int, seed: str = "") -> DataFrame:
    """group, id, priority, value: a uniform sample of ``k`` rows of each group (all, if fewer).

    Rows with a null id or value are not sampled. Every run and partitioning gives the same rows; a row that comes twice counts once.
    """
    known = rows.where(F.col(id).isNotNull() & F.col(value).isNotNull()).select(F.col(group).alias("group"), F.col(id).alias("id"), F.col(value).alias("value")).withColumn("priority", priority(F.col("id"), seed))
    return kept(known, "group", k).dropDuplicates(["group", "id"]).select("group", "id", "priority", "value")


def merged(a: DataFrame, b: DataFrame, k: int) -> DataFrame:
    """The sample of both inputs together from their samples: what is in it was in one of them."""
    return kept(a.unionByName(b).dropDuplicates(["group", "id"]), "group", k)


def percentiles(sample: DataFrame, shares: dict[str, int]) -> DataFrame:
    """group, n and for each named percentage p the value at place n * p / 100 - 1 (from 0, rounded down, 0 at least) of the sorted sample."""
    values = sample.groupBy("group").agg(F.sort_array(F.collect_list("value")).alias("v"))  # k values at most
    n = F.size("v")
    at = lambda p: F.get("v", F.greatest(F.floor(n * F.lit(p) / F.lit(100)) - 1, F.lit(0)).cast("int"))
    return values.select("group", n.cast("long").alias("n"), *[at(p).alias(name) for name, p in shares.items()])


def rank_error(k: int, doubt: float = 0.01) -> float:
    """How far, as a share of all rows, any percentile of a sample of ``k`` may be off, but for a chance of ``doubt`` (Dvoretzky, Kiefer and Wolfowitz)."""
    return math.sqrt(math.log(2 / doubt) / (2 * k))


RESERVOIR = 1000
_SAMPLE = f"""s AS (SELECT event_type, event_id, value, CAST('0x' || substr(md5(CAST(event_id AS VARCHAR)), 1, {_DIGITS}) AS BIGINT) AS priority FROM events WHERE value IS NOT NULL AND event_id IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY priority, event_id) <= {RESERVOIR})"""


@query("reservoir_sample", f"WITH {_SAMPLE} SELECT event_type AS \"group\", event_id AS id, priority, value FROM s")
def reservoir_sample(spark, sf_dir):
    """A sample of the events of each type."""
    return bottom_k(table(spark, sf_dir, "events"), "event_type", "event_id", "value", RESERVOIR)


@query(
    "reservoir_percentiles",
    f"""WITH {_SAMPLE}, v AS (SELECT event_type, list_sort(list(value)) AS v, count(*) AS n FROM s GROUP BY event_type)
    SELECT event_type AS "group", n, {', '.join(f"v[1 + greatest(n * {p} // 100 - 1, 0)] AS p{p}" for p in (50, 95, 99))} FROM v""",
)
def reservoir_percentiles(spark, sf_dir):
    """Percentiles of values by event type, from the sample."""
    return percentiles(reservoir_sample(spark, sf_dir), {"p50": 50, "p95": 95, "p99": 99})
