import json
import random

from pyspark.sql import functions as F

from sitelode.rules import items as I


def frame(spark, blocks):
    return spark.createDataFrame(blocks, "page_id long, block int, json string")


def brute(page, block, text):
    out = []

    def down(v, path, owner, name):
        kind = "object" if isinstance(v, dict) else "list" if isinstance(v, list) else "scalar"
        value = None if kind != "scalar" or v is None else ("true" if v else "false") if isinstance(v, bool) else str(v)
        out.append((page, block, path, owner, name, kind, value))
        for k, x in v.items() if kind == "object" else enumerate(v) if kind == "list" else ():
            down(x, f"{path}/{k}", path if kind == "object" else owner, k if kind == "object" else name)

    try:
        down(json.loads(text), "$", None, None)
    except (TypeError, ValueError):
        pass
    return out


def value(rng, depth):
    r = rng.random()
    if depth and r < 0.4:
        return {rng.choice(["@id", "@type", "a", "b", "ünï", "x y"]): value(rng, depth - 1) for _ in range(rng.randrange(4))}
    if depth and r < 0.6:
        return [value(rng, depth - 1) for _ in range(rng.randrange(4))]
    return rng.choice(["s", "", 1, 25, True, False, None, "2024-01-01"])


def test_descent_against_brute_force(spark):
    rng = random.Random(4)
    blocks = [(i // 3, i % 3, json.dumps(value(rng, 7))) for i in range(60)] + [(90, 0, "{broken"), (90, 1, None), (90, 2, ""), (91, 0, "7")]
    got = sorted(map(tuple, I.nodes(frame(spark, blocks)).collect()), key=str)
    want = [row for b in blocks for row in brute(*b)]
    assert got == sorted(want, key=str) and max(r[2].count("/") for r in want) >= 5
    assert I.nodes(frame(spark, [])).count() == 0


def test_offers_and_references(spark):
    blocks = [
        (1, 0, '{"@graph": [{"@type": "Product", "name": "deep", "x": {"y": [{"@type": ["Thing", "Product"], "name": "inner", "offers": [{"price": 5, "priceCurrency": "EUR", "availability": "https://schema.org/InStock"}, {"@id": "o"}]}]}}]}'),
        (1, 1, '{"@id": "o", "@type": "Offer", "priceSpecification": [{"@id": "s"}, {"price": "9.99"}]}'),
        (1, 2, '[{"@id": "s", "price": 8, "priceCurrency": "USD"}, {"@id": "o", "later": 1}]'),
        (2, 0, '{"@type": "Product", "offers": {"@id": "o"}}'),  # of another page: not there
        (3, 0, '{"@type": "Offer", "price": 1}'),
        (4, 0, '{"@type": "Product", "name": "none", "offers": []}'),
    ]
    got = sorted(map(tuple, I.offers(I.nodes(frame(spark, blocks))).collect()), key=str)
    assert got == [(1, "inner", "5", "EUR", "InStock"), (1, "inner", "8", "USD", None), (2, None, None, None, None)]


def test_items(spark):
    blocks = [(1, 0, '{"@id": "a", "b": {"@id": "a"}, "c": {"@id": "z"}, "d": {}}')]
    rows = {r.path: r for r in I.items(I.nodes(frame(spark, blocks))).collect()}
    assert {p: r.target.path for p, r in rows.items()} == {"$": "$", "$/b": "$", "$/c": "$/c", "$/d": "$/d"}
    assert rows["$/d"].properties == 0 and rows["$"].properties == 4 and rows["$/b"].owner == "$" and rows["$/b"].property == "b"


def test_dates(spark):
    blocks = [(1, 0, '{"a": [{"datePublished": "2024-05-02T01:00:00Z"}, {"datePublished": "2023-01-09"}], "dateModified": "2024-06-01"}'), (1, 1, '{"dateModified": "2024-13-01", "x": {"dateModified": "2024-07-01"}}'), (2, 0, '{"datePublished": "soon"}')]
    assert [(r.page_id, str(r.published), str(r.modified)) for r in I.dates(I.nodes(frame(spark, blocks))).collect()] == [(1, "2023-01-09", "2024-07-01")]
    assert I.dates(I.nodes(frame(spark, []))).select(F.col("published")).count() == 0
