import random
import re
import tracemalloc
from collections import Counter

import numpy as np
import pytest

from sitelode.llm import jaccard
from sitelode.llm.components import components
from sitelode.llm.jaccard import DEEPEST, exact_shingles, found_at, jaccard_classes, linked, shortened, tries


def sets(texts):
    out = []
    for t in texts:
        w = re.findall(r"[a-z0-9\u0080-\U0010ffff]+", (t or "").lower())
        out.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set()))
    return out


def brute(corpus):
    s = sets([t for _, t in corpus])
    n = len(s)
    near = [[i != j and bool(s[i]) and 5 * len(s[i] & s[j]) >= 4 * len(s[i] | s[j]) for j in range(n)] for i in range(n)]
    label = list(range(n))
    for _ in range(n):
        new = [min([label[i]] + [label[j] for j in range(n) if near[i][j]]) for i in range(n)]
        if new == label:
            break
        label = new
    least = {}
    for i, l in enumerate(label):
        if corpus[i][0] is not None:
            least[l] = min(least.get(l, corpus[i][0]), corpus[i][0])
    return Counter((corpus[i][0], least.get(label[i]), sum(near[i])) for i in range(n))


def got(df):
    return Counter((r.doc_id, r.class_id, r.n_links) for r in df.collect())


@pytest.mark.parametrize("block", [64, 2])
def test_against_brute_force(docs, corpus, monkeypatch, block):
    monkeypatch.setattr(jaccard, "BLOCK", block)
    assert got(jaccard_classes(docs)) == brute(corpus)


def test_chain_of_near_copies(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK", 4)
    rng = random.Random(3)
    text = [f"q{rng.random()}" for _ in range(120)]
    corpus = []
    for i in range(30):
        text = list(text)
        text[rng.randrange(120)] = f"new{i}"
        corpus.append((i, " ".join(text)))
    df = spark.createDataFrame(corpus, "doc_id long, text string")
    assert got(jaccard_classes(df)) == brute(corpus)


def test_empty(nothing):
    assert jaccard_classes(nothing).count() == 0


def test_prefixes_are_shortened_to_the_recall():
    # nothing known: as if all links were at the threshold
    d = shortened({}, 8, 20, 0.9999)
    assert found_at(0.8, d, 20) >= 0.9999 > found_at(0.8, d + 1, 20)
    # many links, all very similar: the deepest prefixes do
    assert shortened({97: 10**6}, 8, 20, 0.9999) == 8
    # the more of them are close to the threshold, the shorter
    depths = [shortened({80: k, 95: 10**6 - k}, 8, 20, 0.9999) for k in (0, 20000, 10**5, 10**6)]
    assert depths == sorted(depths, reverse=True) and depths[0] == 8 and depths[-1] == d


def test_tries_hold_every_node(spark):
    """Texts that share digits in a tree are connected by neighbours that share as many."""
    rng = random.Random(5)
    digits = {bytes([i]) * 16: [[rng.randrange(2) for _ in range(DEEPEST)] for _ in range(3)] for i in range(40)}
    raw = [(n, np.array(d, ">u2").tobytes()) for n, d in digits.items()]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")  # nodes go on from batch to batch
    found = tries(spark.createDataFrame(raw, "node binary, trie binary"), 2).collect()
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for depth in range(2, DEEPEST + 1):
        label, stars = {n: n for n in digits}, {n: n for n in digits}
        for _ in digits:
            for r in found:
                if r.shared >= depth:
                    a, b = bytes(r.a), bytes(r.b)
                    label[a] = label[b] = min(label[a], label[b])
                    a = bytes(r.heads[depth - 2]) if r.heads else a
                    stars[a] = stars[b] = min(stars[a], stars[b])
        want = {n: n for n in digits}
        for _ in digits:
            for x in digits:
                for y in digits:
                    if any(digits[x][t][:depth] == digits[y][t][:depth] for t in range(3)):
                        want[x] = want[y] = min(want[x], want[y])
        assert label == want and stars == want


def test_shingles_are_told_apart_by_bytes():
    rng = random.Random(6)
    corpus = [(i, " ".join(rng.choice("abcd") for _ in range(rng.randrange(9)))) for i in range(200)]
    codes, counts = exact_shingles([t.encode() for _, t in corpus])
    parts = np.split(codes, np.cumsum(counts)[:-1])
    want = sets([t for _, t in corpus])
    assert [len(p) for p in parts] == [len(s) for s in want]
    for a, p in zip(want, parts):
        for b, q in zip(want, parts):
            assert len(a & b) == len(set(p.tolist()) & set(q.tolist()))


def test_groups_of_links():
    rng = np.random.default_rng(2)
    for density in (0.01, 0.05, 0.3):
        near = rng.random((40, 30)) < density
        label = list(range(70))
        for _ in range(70):
            for i, j in zip(*np.nonzero(near)):
                label[i] = label[40 + j] = min(label[i], label[40 + j])
        want = {}
        for i, x in enumerate(label):
            want.setdefault(x, []).append(i)
        got = sorted(sorted([*r.tolist(), *(c + 40).tolist()]) for r, c in jaccard.groups_of(near))
        assert got == sorted(g for g in want.values() if len(g) > 1)


def test_depth_follows_the_data(spark):
    """Many near copies of high similarity: deep prefixes do; some close to the threshold shorten them."""
    from sitelode.llm.jaccard import DEEPEST, TREES, chosen_depth

    def depth(alike):
        sign = lambda n: np.array([i if i < n else 1000 + i for i in range(TREES * DEEPEST)], ">u2").tobytes()
        base = np.arange(TREES * DEEPEST).astype(">u2").tobytes()
        nodes, pairs = [], []
        for k, share in enumerate(alike):
            a, b = (bytes([k // 256, k % 256, x]) * 2 for x in (0, 1))
            nodes += [(a, base), (b, sign(int(share * TREES * DEEPEST)))]
            pairs.append((a, b, DEEPEST))
        return chosen_depth(spark.createDataFrame(nodes, "node binary, trie binary"), spark.createDataFrame(pairs, "a binary, b binary, shared int"), TREES, 0.9999)

    assert depth([0.97] * 900) > depth([0.97] * 700 + [0.82] * 200) >= depth([0.8] * 300) == shortened({}, DEEPEST, TREES, 0.9999)


def test_texts_of_words_with_equal_polynomial_hashes(spark):
    from test_tokens import thue_morse

    one, two = thue_morse(2048)
    df = spark.createDataFrame([(1, f"{one} {two} " * 4), (2, f"{two} {one} {one} {two} " * 2), (3, one), (4, two)], "doc_id long, text string")
    assert {r.doc_id: (r.class_id, r.n_links) for r in jaccard_classes(df).collect()} == {i: (i, 0) for i in range(1, 5)}


def test_recall_on_a_table(spark):
    """Against brute force over all texts of the table."""
    from sitelode.llm.jaccard import op2_jaccard_join

    sf = "/root/testdata/sf0.001"
    corpus = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert got(op2_jaccard_join(spark, sf)) == brute(corpus)


def test_blocks_count_each_link_once():
    texts = [b"a b c d e f g h i j", b"a b c d e f g h i j", b"z y x w v"]
    w, root = linked(texts, np.array([1, 3, 1]), np.array([0]), np.array([1, 2]))
    assert w.tolist() == [3, 1, 0] and root[0] == root[1] != root[2]


def test_a_large_block_takes_little_memory(monkeypatch):
    texts = [f"a b c d e f g h i j k l m n o p q r s t{i // 2}{' z' * (i % 2)}".encode() for i in range(6000)]
    at, ones = np.arange(6000), np.ones(6000, np.int64)
    tracemalloc.start()
    weight, _ = linked(texts[:5000:50], ones[:100], at[:100], at[:100])
    linked([f"t{i} b c d e f".encode() for i in range(6000)], ones, at, at)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 400 << 20
    monkeypatch.setattr(jaccard, "_SIDE", 7)
    for left, right in ((at[:100],) * 2, (at[:60], at[60:100])):
        small = linked(texts[:5000:50], ones[:100], left, right)
        monkeypatch.setattr(jaccard, "_SIDE", 2048)
        large = linked(texts[:5000:50], ones[:100], left, right)
        monkeypatch.setattr(jaccard, "_SIDE", 7)
        assert [x.tolist() for x in small] == [x.tolist() for x in large]
    assert weight.sum() > 0


def test_components(spark):
    rng = random.Random(9)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(i, i + 1) for i in range(500, 560)] + [(7, 7), (700, 701), (701, 700)]
    label = {x: x for p in pairs for x in p if p[0] != p[1]}
    changed = True
    while changed:
        changed = False
        for a, b in pairs:
            if a != b and label[a] != label[b]:
                label[a] = label[b] = min(label[a], label[b])
                changed = True
    df = spark.createDataFrame(pairs, "a long, b long")
    assert {r.node: r.label for r in components(df).collect()} == label
    assert components(df.where("false")).count() == 0
