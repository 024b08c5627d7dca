"""As-of joins: to each record the latest earlier one of its key, without comparing times pairwise."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..registry import query, table


def asof_join(left: DataFrame, right: DataFrame, key: str, ts: str, take: list[str], within: int | None = None, slice_seconds: int = 86_400) -> DataFrame:
    """``left`` with ``take``, columns of the latest row of ``right`` of the same ``key`` and no later ``ts``, and matched_ts; nulls where there is none.

    Of rows of ``right`` with one key and time the greatest by ``take`` counts. ``within``: seconds that a match may be old.
    Left rows with a null key or time match nothing. Columns of ``left`` keep their names, so ``take`` must not repeat them.

    Both sides go into one table, sorted once; the last row of the right side so far is what a row matches. Time is
    cut into slices, so that a key with very many rows is spread over tasks: what a slice ends with is carried to the next
    slices by a table with one row for each key and slice.
    """
    clash = set(take) & set(left.columns)
    if clash or "matched_ts" in left.columns:
        raise ValueError(f"columns on both sides: {sorted(clash) or ['matched_ts']}")
    step = F.floor(F.unix_seconds(F.col(ts).cast("timestamp")) / F.lit(slice_seconds))
    record = F.struct(F.col(ts).alias("matched_ts"), *take)
    r = right.where(F.col(key).isNotNull() & F.col(ts).isNotNull()).select(F.col(key).alias("_k"), F.col(ts).alias("_t"), step.alias("_s"), record.alias("_r"))
    # one record for each key and time, so that order within a time is settled before the sort
    r = r.groupBy("_k", "_t", "_s").agg(F.max("_r").alias("_r"))
    ends = r.groupBy("_k", "_s").agg(F.max("_r").alias("_r"))
    reached = left.where(F.col(key).isNotNull() & F.col(ts).isNotNull()).select(F.col(key).alias("_k"), step.alias("_s")).distinct()
    none = F.lit(None)
    steps = ends.select("_k", "_s", "_r").unionByName(reached.select("_k", "_s", none.cast(ends.schema["_r"].dataType).alias("_r")))
    steps = steps.groupBy("_k", "_s").agg(F.max("_r").alias("_r"))
    before = Window.partitionBy("_k").orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
    carried = steps.select("_k", "_s", F.last("_r", ignorenulls=True).over(before).alias("_r")).where("_r IS NOT NULL")
    row = F.struct(*[F.col(c) for c in left.columns])
    l_rows = left.select(F.col(key).alias("_k"), F.col(ts).alias("_t"), step.alias("_s"), F.lit(2).alias("_side"), none.cast(ends.schema["_r"].dataType).alias("_r"), row.alias("_l"))
    empty = none.cast(l_rows.schema["_l"].dataType).alias("_l")
    r_rows = r.select("_k", "_t", "_s", F.lit(1).alias("_side"), "_r", empty)
    c_rows = carried.select("_k", none.cast(l_rows.schema["_t"].dataType).alias("_t"), "_s", F.lit(0).alias("_side"), "_r", empty)
    order = Window.partitionBy("_k", "_s").orderBy(F.col("_side") != 0, "_t", "_side").rowsBetween(Window.unboundedPreceding, 0)
    found = l_rows.unionByName(r_rows).unionByName(c_rows).withColumn("_m", F.last("_r", ignorenulls=True).over(order)).where("_side = 2")
    fits = F.col("_k").isNotNull() & F.col("_t").isNotNull()
    if within is not None:
        fits &= F.unix_micros(F.col("_t").cast("timestamp")) - F.unix_micros(F.col("_m.matched_ts").cast("timestamp")) <= within * 1_000_000
    return found.select("_l.*", *[F.when(fits, F.col(f"_m.{c}")).alias(c) for c in ("matched_ts", *take)])


def lab_field_deltas(lab: DataFrame, field: DataFrame, metrics: list[str], key: str = "url", ts: str = "ts", within: int | None = None) -> DataFrame:
    """Each lab record with the field record of its key that was current then, and the differences lab minus field.

    ``lab`` and ``field`` have key, ts and ``metrics``; the result has key, ts, lab_, field_ and delta_ of each metric, field_ts.
    """
    renamed = field.select(key, ts, *[F.col(m).alias(f"field_{m}") for m in metrics])
    rows = asof_join(lab.select(key, ts, *[F.col(m).alias(f"lab_{m}") for m in metrics]), renamed, key, ts, [f"field_{m}" for m in metrics], within)
    delta: list[Column] = [(F.col(f"lab_{m}") - F.col(f"field_{m}")).alias(f"delta_{m}") for m in metrics]
    return rows.select("*", *delta).withColumnRenamed("matched_ts", "field_ts")


@query(
    "lab_field_deltas",
    """WITH l AS (SELECT event_id, user_id, ts, value FROM events WHERE event_type = 'purchase'),
    f AS (SELECT user_id, ts, max(value) AS value FROM events WHERE event_type = 'view' GROUP BY ALL)
    SELECT l.user_id, l.ts, l.value AS lab_value, f.value AS field_value, f.ts AS field_ts, l.value - f.value AS delta_value FROM l ASOF LEFT JOIN f ON l.user_id = f.user_id AND l.ts >= f.ts""",
)
def lab_field_query(spark, sf_dir):
    """Measured values of purchases against the user's latest view before: every event is on one side, in its time."""
    e = table(spark, sf_dir, "events")
    return lab_field_deltas(e.where("event_type = 'purchase'"), e.where("event_type = 'view'"), ["value"], "user_id")


@query(
    "asof_errors",
    """WITH l AS (SELECT event_id, user_id, ts FROM events), f AS (SELECT user_id, ts, max(event_id) AS error_id FROM events WHERE event_type = 'error' GROUP BY ALL)
    SELECT l.event_id, CASE WHEN epoch_us(l.ts) - epoch_us(f.ts) <= 3600000000 THEN f.error_id END AS error_id FROM l ASOF LEFT JOIN f ON l.user_id = f.user_id AND l.ts >= f.ts""",
)
def asof_errors(spark, sf_dir):
    """For every event the user's latest error, if it was within the hour before."""
    e = table(spark, sf_dir, "events")
    errors = e.where("event_type = 'error'").select("user_id", "ts", F.col("event_id").alias("error_id"))
    return asof_join(e.select("event_id", "user_id", "ts"), errors, "user_id", "ts", ["error_id"], 3600).select("event_id", "error_id")
