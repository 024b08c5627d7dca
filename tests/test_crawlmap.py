import random
import xml.etree.ElementTree

import numpy as np
import pytest

from sitelode import crawlmap as M


def brute(points, links, rounds):
    """All pairs, as the forces are told."""
    p = np.array([q for _, q in points], float)
    v = np.zeros_like(p)
    place = {i: k for k, (i, _) in enumerate(points)}
    for _ in range(rounds):
        f = np.zeros_like(p)
        for i in range(len(p)):
            for j in range(len(p)):
                if i != j:
                    d = p[i] - p[j]
                    s = max(d @ d, 1.0)
                    f[i] += d / s**0.5 * 2000.0 / s
        for a, b in links:
            if a in place and b in place:
                d = p[place[b]] - p[place[a]]
                n = max((d @ d) ** 0.5, 1.0)
                pull = d / n * (n - 120.0) * 0.005
                f[place[a]] += pull
                f[place[b]] -= pull
        v = (v + f) * 0.9
        p = np.clip(p + v, [60, 60], [1140, 840])
    return {i: tuple(p[k]) for k, (i, _) in enumerate(points)}


@pytest.mark.parametrize("rounds", [1, 4])
def test_close_to_all_pairs(spark, rounds):
    rng = random.Random(rounds)
    points = [(i, (rng.uniform(60, 1140), rng.uniform(60, 840))) for i in range(60)]
    if rounds > 1:  # pages apart from each other: in a crowd small differences grow from round to round
        points = [(i, (100 + 130 * (i % 8) + rng.uniform(0, 60), 100 + 90 * (i // 8) + rng.uniform(0, 40))) for i in range(60)]
    points += [(100 + i, (600 + rng.uniform(0, 25), 400 + rng.uniform(0, 25))) for i in range(15 if rounds == 1 else 0)]  # a crowd
    links = [(rng.randrange(60), rng.randrange(60)) for _ in range(80)] + [(1, 999), (3, 3)]
    df = spark.createDataFrame([(i, x, y) for i, (x, y) in points], "id long, x double, y double").repartition(3)
    got = {r.id: (r.x, r.y) for r in M.layout(df, spark.createDataFrame(links, "src long, dst long"), rounds).collect()}
    want = brute(points, links, rounds)
    assert set(got) == set(want)
    off = [np.hypot(got[i][0] - want[i][0], got[i][1] - want[i][1]) for i in want]
    lone = [k for k, (_, q) in enumerate(points) if min(np.hypot(q[0] - r[0], q[1] - r[1]) for j, (_, r) in enumerate(points) if j != k) > 15]
    assert len(lone) > 40 and max(off[k] for k in lone) < 0.1 * rounds**2 and np.median(off) < 0.1 * rounds
    assert all(60 <= x <= 1140 and 60 <= y <= 840 for x, y in got.values())
    # with cells so small that each holds one page, and all near, it is all pairs
    exact = {r.id: (r.x, r.y) for r in M.layout(df, spark.createDataFrame(links, "src long, dst long"), 1, 0.25, 1200.0).collect()}
    one = brute(points, links, 1)
    assert max(np.hypot(exact[i][0] - one[i][0], exact[i][1] - one[i][1]) for i in one) < 1e-6


def test_edges_of_the_layout(spark):
    none = spark.createDataFrame([], "id long, x double, y double")
    links = spark.createDataFrame([(1, 2)], "src long, dst long")
    assert M.layout(none, links, 2).count() == 0
    same = spark.createDataFrame([(1, 100.0, 100.0), (2, 100.0, 100.0)], "id long, x double, y double")
    assert sorted((r.id, r.x, r.y) for r in M.layout(same, links.where("false"), 2).collect()) == [(1, 100.0, 100.0), (2, 100.0, 100.0)]
    where = M.start(spark.range(500)).collect()
    assert all(60 <= r.x <= 1140 and 60 <= r.y <= 840 for r in where) and len({(r.x, r.y) for r in where}) == 500


def test_svg(spark):
    placed = spark.createDataFrame([("http://h/a?x=1&y=<2>", 100.0, 200.0), ("http://h", 300.0, 400.0), ("http://h/" + "p" * 60, 500.0, 600.0)], "id string, x double, y double")
    edges = spark.createDataFrame([("http://h", "http://h/a?x=1&y=<2>"), ("http://h", "http://gone/")], "src string, dst string")
    depths = spark.createDataFrame([("http://h", 0), ("http://h/a?x=1&y=<2>", 9)], "id string, depth int")
    lines = M.svg(placed, edges, depths).orderBy("part", "id").collect()
    root = xml.etree.ElementTree.fromstring("\n".join(r.line for r in lines))
    texts = [t.text for t in root.iter("{http://www.w3.org/2000/svg}text")]
    assert texts == ["/", "/a?x=1&y=<2>", "/" + "p" * 28 + "…"]
    assert len(list(root.iter("{http://www.w3.org/2000/svg}line"))) == 1
    assert [c.get("fill") for c in root.iter("{http://www.w3.org/2000/svg}circle")] == ["#3b82f6", "#ec4899", "#ec4899"]
