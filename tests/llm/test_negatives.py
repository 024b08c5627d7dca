import math
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from sitelode.llm import negatives
from sitelode.llm.catalogue import ORACLE_SQL
from sitelode.llm.negatives import hard_negatives, limits, op11_hard_negatives, window

SCHEMA = "vec_id long, embedding array<double>, label int, id string, v string, more string, dim string, p string"


def brute(rows, is_anchor, n=5, k=10, lower=30, upper=90):
    ok = []
    for i, v, label in rows:
        if i is not None and label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            ok.append((i, [math.floor(256 * x) for x in v], label))
    asks = {}
    for i, v, label in ok:
        if is_anchor(i):
            asks[i] = min(asks.get(i, (label, v)), (label, v))
    out = []
    for a, (label, v) in asks.items():
        near = sorted((-max(-(2**63), min(2**63 - 1, sum(x * y for x, y in zip(v, w)))), i, other) for i, w, other in ok if i != a and len(w) == len(v))
        for place, (p, pid, _) in enumerate([x for x in near if x[2] == label][:n]):
            own = [x for x in near if x[2] != label and lower * -p <= 100 * -x[0] <= upper * -p][:k]
            out += [(a, pid, r + 1, i, -p, -s, place + 1) for r, (s, i, _) in enumerate(own)]
    return sorted(out)


def table(rng, n=150, dim=4):
    rows = [(i, [rng.uniform(-1, 1) for _ in range(dim)], rng.randrange(4)) for i in range(n)]
    rows += [(1000 + i, rows[7][1], i % 3) for i in range(20)]  # ties
    rows += [(2000, None, 1), (2010, [0.5] * dim, None), (2020, [None] * dim, 1), (2030, [float("nan")] * dim, 1), (2040, [float("inf")] * dim, 1), (None, [0.5] * dim, 1)]
    rows += [(2100, [1.0, 2.0], 1), (2101, [1.0, 1.5], 1), (2102, [0.5, 0.75], 2), (2103, [1.0, 1.0], 3), (2110, [], 1), (2111, [], 1), (2112, [], 2)]
    return [*rows, rows[3], rows[20], (20, rows[21][1], 0), (10, rows[11][1], 3)]  # repeated rows, repeated anchors


def frame(spark, rows):
    return spark.createDataFrame([(*r, *["x"] * 5) for r in rows], SCHEMA).repartition(3)


@pytest.mark.parametrize("sizes", [(4096, 256, 8, 4), (11, 3, 2, 2)])
def test_against_brute_force(spark, monkeypatch, sizes):
    for name, n in zip(("ROWS_PER_TILE", "ANCHORS_PER_TILE", "ANCHOR_GROUP", "ROW_GROUP"), sizes):
        monkeypatch.setattr(negatives, name, n)
    rows = table(random.Random(4))
    rows += [(3000, [2.0**40, 2.0**40, 0.0], 1), (3001, [2.0**41, 0.0, 1.0], 1), (3002, [2.0**20, 2.0**19, 3.0], 2), (3003, [-(2.0**40), 0.0, 0.0], 2), (3004, [2.0**30, 2.0**29, 0.0], 3)]
    got = sorted(tuple(r) for r in hard_negatives(frame(spark, rows), F.col("vec_id") % 10 == 0).collect())
    assert got == brute(rows, lambda i: i % 10 == 0) and len(got) > 100


def test_limits_are_exact():
    for score in (-7, 0, 1, 9, 10, 101, 2**62 + 1):
        least, most = limits(score, 30, 90)
        for s in {least - 1, least, least + 1, most - 1, most, most + 1}:
            assert (least <= s <= most) == (30 * score <= 100 * s <= 90 * score)


def test_window_reads_past_long_runs_of_the_same_label():
    scores = np.arange(10_000)[::-1]
    other = np.zeros(10_000, bool)
    other[[5, 4000, 9000, 9999]] = True
    assert window(~scores, other, 0, 9990, 3).tolist() == [4000, 9000, 9999]
    assert window(~scores, other, 999, 9990, 3).tolist() == [4000, 9000]
    assert window(~scores, other, 5, 4, 3).tolist() == []


def test_other_numbers(spark):
    rows = table(random.Random(5), 60)
    got = sorted(tuple(r) for r in hard_negatives(frame(spark, rows), F.col("vec_id") % 10 == 0, positives=2, k=3, lower=-50, upper=110).collect())
    assert got == brute(rows, lambda i: i % 10 == 0, 2, 3, -50, 110)


def test_query_and_sql(spark, tmp_path):
    rows = [(i, v, label) for i, v, label in table(random.Random(6), 450) if i is None or i not in (10, 20)]
    path = f"{tmp_path}/embeddings.parquet"
    frame(spark, rows).write.parquet(path)
    got = sorted(tuple(r) for r in op11_hard_negatives(spark, str(tmp_path)).collect())
    shifted = [(i, v, (label + 1) % 10 if i is not None and i % 7 == 0 and label is not None else label) for i, v, label in rows]
    assert got == brute(shifted, lambda i: i % 100 == 0) and got
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{path}/*.parquet'")
    assert sorted(con.execute(ORACLE_SQL["op11_hard_negatives"]).fetchall()) == got


def test_empty(spark):
    assert hard_negatives(frame(spark, []), F.lit(True)).count() == 0
    assert hard_negatives(frame(spark, [(10, [1.0], 1)]), F.lit(True)).count() == 0
