import hashlib
import random
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from sitelode.llm import merkle
from sitelode.llm.catalogue import ORACLE_SQL
from sitelode.llm.merkle import fold, manifest, op13_merkle_manifest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, g string, node string, serial string, pos string, n string, block string, name string, id string"


def h(s):
    return hashlib.sha256(s.encode()).hexdigest()


def leaf(row):
    doc_id, text, lang, source, n_chars = row
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)))


def tree(nodes):
    """Levels from the lowest up, by the rule as it is told."""
    out = [nodes]
    while len(nodes) > 1:
        nodes = [h("".join(nodes[i : i + 8])) for i in range(0, len(nodes), 8)]
        out.append(nodes)
    return out


def brute(rows):
    langs = {}
    for r in rows:
        langs.setdefault(r[2], []).append(r)
    order = sorted(langs, key=lambda x: (x is not None, (x or "").encode()))
    for k in order:
        langs[k].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
    trees = {k: tree([leaf(r) for r in langs[k]]) for k in order}
    over = tree([trees[k][-1][0] for k in order])
    out = []
    for place, k in enumerate(order):
        for i, r in enumerate(langs[k]):
            tampered = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0 and r[1] is not None
            node = leaf((r[0], "".join(c.lower() if "A" <= c <= "Z" else c for c in r[1]), *r[2:])) if tampered else leaf(r)
            siblings = ""
            for levels, j in ((trees[k], i), (over, place)):
                for nodes in levels[:-1]:
                    a, b = nodes[j - j % 8 : j], nodes[j + 1 : j - j % 8 + 8]
                    siblings += "".join(a + b)
                    node = h("".join(a) + node + "".join(b))
                    j //= 8
            out.append((r[0], leaf(r), trees[k][-1][0], over[-1][0], h(siblings), node, node == over[-1][0]))
    return sorted(out, key=str)


def rows(n=700, langs=(None, "", "de", "en", "ß", "zz"), seed=3):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        text = rng.choice([None, "", "plain words", "With Capitals É", "İx", "a" * 5000, "漢字 Z"])
        out.append((i, text, rng.choice([*langs, "en", "en", "en"]), rng.choice([None, "", "web"]), rng.choice([None, 0, -5, 99])))
    return [*out, *out[:9], *[(None, t, "en", None, None) for t in ("x", "X", None, None)], (-7, "Neg", "only", "s", 1), *[(5, "HOT", "en", "s", 1)] * 40]


def frame(spark, data):
    return spark.createDataFrame([(*r, *["c"] * 8) for r in data], SCHEMA).repartition(5)


def query(df, **limits):
    lower = F.translate("text", merkle._UPPER, merkle._UPPER.lower())
    return sorted((tuple(r) for r in manifest(df, {"text": lower}, F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0, **limits).collect()), key=str)


@pytest.mark.parametrize("levels,top", [(4, 4096), (1, 1000), (2, 3), (1, 2)])
def test_against_brute_force(spark, levels, top):
    """Also with blocks and a top so small that several rounds run, for rows and for groups."""
    data = rows() if top > 3 else rows(150, [f"l{i}" for i in range(20)])
    got = query(frame(spark, data), levels=levels, top=top)
    assert got == brute(data)
    assert not all(r[-1] for r in got) and any(r[-1] for r in got)


@pytest.mark.parametrize("n", [1, 2, 8, 9, 64, 65, 513])
def test_one_group_of_any_size(spark, n):
    data = [(i, f"T{i}", "en", "s", i) for i in range(n)]
    assert query(frame(spark, data)) == brute(data)


def test_groups_alone(spark):
    data = [(i, "Text", f"l{i}", None, None) for i in range(70)]
    assert query(frame(spark, data)) == brute(data)


def test_proofs_verify_and_tampering_shows(spark):
    data = rows(100)
    got = manifest(frame(spark, data), with_proofs=True).collect()
    assert all(r["verified"] and fold(r["leaf"], zip(r["left"], r["right"])) == r["root"] for r in got)
    assert all(fold(h("other"), zip(r["left"], r["right"])) != r["root"] for r in got)
    assert all(h("".join(x + y for x, y in zip(r["left"], r["right"]))) == r["proof_sha256"] for r in got)


def test_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert manifest(df).count() == 0 and query(df) == []


def test_query_and_sql(spark, tmp_path):
    data = rows(300)
    path = f"{tmp_path}/documents.parquet"
    frame(spark, data).write.parquet(path)
    got = sorted((tuple(r) for r in op13_merkle_manifest(spark, str(tmp_path)).collect()), key=str)
    assert got == brute(data)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{path}/*.parquet'")
    assert sorted(con.execute(ORACLE_SQL["op13_merkle_manifest"]).fetchall(), key=str) == got
