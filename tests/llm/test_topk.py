import math
import random

import numpy as np
from pyspark.sql import functions as F

from sitelode.llm import topk
from sitelode.llm.topk import _products, top_k


def brute(rows, k=5):
    ok = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out, asks = [], {}
    for q, a in ok:
        asks[q] = min(asks.get(q, a), a)
    for q, a in asks.items():
        if q % 10 == 0:
            found = sorted((-max(-(2**63), min(2**63 - 1, sum(x * y for x, y in zip(a, b)))), i) for i, b in ok if i != q and len(b) == len(a))
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(found[:k])]
    return sorted(out)


def test_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(topk, "ROWS_PER_TILE", 7)
    monkeypatch.setattr(topk, "QUERIES_PER_TILE", 3)
    monkeypatch.setattr(topk, "QUERY_GROUP", 2)
    monkeypatch.setattr(topk, "ROW_GROUP", 2)
    rng = random.Random(2)
    rows = [(i, [rng.uniform(-1, 1) for _ in range(6)]) for i in range(60)]
    rows += [(100 + i, rows[0][1]) for i in range(12)]  # ties
    rows += [(200, None), (210, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (220, [float("nan")] * 6), (230, [float("inf")] * 6), (240, [1.0, 2.0]), (250, [3.0, 4.0]), (None, rows[3][1]), (260, [])]
    rows += [rows[5], rows[10], (20, rows[7][1]), (20, [0.5] * 6)]  # rows and query ids that repeat
    rows += [(300, [2.0**40, 2.0**40]), (310, [-(2.0**40), 2.0**33]), (311, [2.0**41, 0.0])]  # scores beyond 64 bits
    df = spark.createDataFrame([(i, v, "q") for i, v in rows], "vec_id long, embedding array<double>, v string")
    got = sorted(tuple(r) for r in top_k(df, F.col("vec_id") % 10 == 0).collect())
    assert got == brute(rows)


def test_large_numbers_stay_exact():
    a = np.array([[2.0**40, 3.0], [1.0, 1.0]])
    assert _products(a, np.array([[2.0**20, 1.0]])).tolist() == [[2**60 + 3], [2**20 + 1]]


def test_scores_stay_within_64_bits():
    big = np.array([[2.0**40]])
    assert _products(big, big).tolist() == [[2**63 - 1]] and _products(big, -big).tolist() == [[-(2**63)]]


def test_query(spark, tmp_path):
    rows = [(i, [i / 7, 1.0 - i / 3]) for i in range(120)]
    spark.createDataFrame(rows, "vec_id long, embedding array<double>").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = sorted(tuple(r) for r in topk.op4_top_k(spark, str(tmp_path)).collect())
    assert got == [r for r in brute(rows) if r[0] % 50 == 0] and len(got) == 15


def test_empty(spark):
    assert top_k(spark.createDataFrame([], "vec_id long, embedding array<float>"), F.lit(True)).count() == 0


def test_the_least_score_of_64_bits_ranks_last(spark):
    rows = [(0, [-(2.0**32), 0.0]), (1, [2.0**32, 0.0]), (2, [1.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [tuple(r) for r in top_k(df, F.col("vec_id") == 0, k=1).collect()]
    assert got == [(0, 1, 2, -(2**48))]


def test_components_beyond_64_bits_do_not_saturate(spark):
    rows = [(0, [2.0**-8, 0.0]), (1, [2.0**60, 0.0]), (2, [2.0**61, -3.5]), (3, [2.0**-9, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert sorted(tuple(r) for r in top_k(df, F.col("vec_id") == 0, k=2).collect()) == brute(rows, 2)[:2]
    (v,) = spark.createDataFrame([([1e300, -1e300, 2.0**70, 0.3],)], "v array<double>").select(topk.quantized(F.col("v"))).first()
    assert v == [256e300, -256e300, 2.0**78, 76.0]


def test_only_outliers_leave_the_fast_product():
    rng = np.random.default_rng(1)
    a, b = np.floor(256 * rng.normal(size=(30, 8))), np.floor(256 * rng.normal(size=(400, 8)))
    b[7, 3], a[2, 0] = 2.0**60, -(2.0**50)
    want = [[max(-(2**63), min(2**63 - 1, sum(int(x) * int(y) for x, y in zip(r, s)))) for s in b] for r in a]
    assert _products(a, b).tolist() == want
