import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from sitelode import history
from sitelode.operators import bucketed
from sitelode.operators.asof import asof_join, lab_field_deltas
from sitelode.operators.samples import bottom_k, merged, percentiles, rank_error

START = datetime(2024, 1, 1)


def rows(rng, n, keys):
    return [(i, rng.choice(keys), None if rng.random() < 0.05 else START + timedelta(seconds=rng.randrange(6 * 86_400)), rng.choice([1.0, 2.5, None])) for i in range(n)]


@pytest.mark.parametrize("slice_seconds,within", [(86_400, None), (3_600, None), (10**9, None), (7_000, 40_000)])
def test_asof_against_brute_force(spark, slice_seconds, within):
    rng = random.Random(slice_seconds)
    keys = ["a", "a", "a", "b", "c", None]  # one key holds half of all rows
    left, right = rows(rng, 250, keys), rows(rng, 120, keys)
    right += [(500 + i, "a", right[0][2], 7.0) for i in range(3)] + [(600, "c", START, 1.0)]
    left += [(900, "c", START, 1.0), left[0], (901, "z", START, 1.0)]  # the same time matches; repeated rows; an unknown key
    schema = "id long, key string, ts timestamp, v double"
    l, r = spark.createDataFrame(left, schema), spark.createDataFrame(right, schema).select("key", "ts", F.col("id").alias("rid"), F.col("v").alias("rv"))
    got = [tuple(x) for x in asof_join(l, r, "key", "ts", ["rid", "rv"], within, slice_seconds).collect()]
    want = []
    for i, k, t, v in left:
        fits = [(u, j, w) for j, m, u, w in right if k is not None and t is not None and u is not None and m == k and u <= t]
        best = max(fits, key=lambda x: (x[0], x[1])) if fits else None
        if best and within is not None and t - best[0] > timedelta(seconds=within):
            best = None
        want.append((i, k, t, v, *((best[0], best[1], best[2]) if best else (None, None, None))))
    assert sorted(got, key=str) == sorted(want, key=str)
    assert sum(x[4] is not None for x in got) > 60


def test_asof_edges(spark):
    schema = "key string, ts timestamp, x long"
    none = spark.createDataFrame([], schema)
    one = spark.createDataFrame([("a", START, 1)], schema)
    right = one.withColumnRenamed("x", "y")
    assert asof_join(one, right.where("false"), "key", "ts", ["y"]).collect()[0].y is None
    assert asof_join(none, right, "key", "ts", ["y"]).count() == 0
    with pytest.raises(ValueError):
        asof_join(one, one, "key", "ts", ["x"])


def test_lab_against_field(spark):
    schema = "url string, ts timestamp, lcp double, cls double"
    lab = spark.createDataFrame([("u", START + timedelta(hours=2), 2000.0, 0.1), ("v", START, 1.0, 1.0)], schema)
    field = spark.createDataFrame([("u", START, 1500.0, None), ("u", START + timedelta(hours=3), 9.0, 9.0)], schema)
    got = {r.url: r for r in lab_field_deltas(lab, field, ["lcp", "cls"]).collect()}
    assert (got["u"].delta_lcp, got["u"].field_lcp, got["u"].delta_cls, got["u"].field_ts) == (500.0, 1500.0, None, START)
    assert got["v"].field_ts is None and got["v"].delta_lcp is None and got["v"].lab_lcp == 1.0


def test_a_sample_is_the_same_for_any_partitioning_and_merges(spark):
    data = [("hot" if i % 3 else f"g{i % 5}", i, float(i % 101)) for i in range(3000)] + [("hot", 1, 1.0)] * 50 + [("x", None, 1.0), ("x", 5000, None), (None, 6000, 1.0)]
    df = spark.createDataFrame(data, "g string, i long, v double")
    one = sorted(map(tuple, bottom_k(df.coalesce(1), "g", "i", "v", 40).collect()), key=str)
    assert one == sorted(map(tuple, bottom_k(df.repartition(9), "g", "i", "v", 40).collect()), key=str)
    sizes = {}
    for g, *_ in one:
        sizes[g] = sizes.get(g, 0) + 1
    assert sizes == {"hot": 40, "g0": 40, "g1": 40, "g2": 40, "g3": 40, "g4": 40, None: 1}
    parts = [bottom_k(df.where(f"coalesce(i, 0) % 2 = {k}"), "g", "i", "v", 40) for k in (0, 1)]
    assert sorted(map(tuple, merged(*parts, 40).collect()), key=str) == one
    assert one != sorted(map(tuple, bottom_k(df, "g", "i", "v", 40, "other").collect()), key=str)


def test_percentiles_within_the_rank_error(spark):
    df = spark.range(20_000).select(F.lit("g").alias("g"), F.col("id").alias("i"), F.col("id").cast("double").alias("v"))
    k = 2000
    got = percentiles(bottom_k(df, "g", "i", "v", k), {"p50": 50, "p95": 95, "p0": 0}).first()
    assert got.n == k and got.p0 < 100 and rank_error(k) < 0.04
    assert all(abs(getattr(got, f"p{p}") / 20_000 - p / 100) <= rank_error(k) for p in (50, 95))


def test_stored_crawls_are_compared_without_an_exchange(spark, tmp_path):
    schema = "page_id long, url string, title string, word_count long, html_bytes long"
    base = spark.createDataFrame([(i, f"u{i}", "t", i, 100) for i in range(200)] + [(900, "u3", "other", 1, 1)], schema)
    later = spark.createDataFrame([(i, f"u{i}", "t" if i % 5 else "new", i, 100 if i % 7 else 500) for i in range(20, 240)], schema)
    tag = tmp_path.name.replace("-", "_")
    for df, name in ((base, "base"), (later, "later")):
        bucketed.stored(df, f"{name}_{tag}", 8, str(tmp_path))
    out = bucketed.compared(spark, f"base_{tag}", f"later_{tag}")
    key, before = "spark.sql.autoBroadcastJoinThreshold", spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set(key, "-1")
    try:
        plan = bucketed.compared(spark, f"base_{tag}", f"later_{tag}")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set(key, before)
    assert "Exchange" not in plan and "SortMergeJoin" in plan
    want = sorted(map(tuple, history.diff(base, later).collect()))
    assert sorted(map(tuple, out.collect())) == want and {c for _, c in want} == {"added", "removed", "title", "size"}
    spark.sql(f"DROP TABLE base_{tag}"), spark.sql(f"DROP TABLE later_{tag}")
