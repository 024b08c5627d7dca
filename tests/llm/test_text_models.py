import random
import re
import time
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from sitelode.llm import decontaminate as decontamination
from sitelode.llm import langid, toxicity
from sitelode.llm.decontaminate import coverage, decontaminate, tiles

SF = "/root/testdata/sf0.01"


def test_language_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = langid.op10_language_id(spark, SF).join(docs.select("doc_id", "lang"), "doc_id")
    r = out.where("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double")), F.count("*"), F.min("score"), F.max("score")).first()
    assert r[0] > 0.97 and r[1] > 150 and 0 <= r[2] and r[3] <= 1
    assert out.count() == docs.count()


def test_language_edges(docs, corpus, nothing):
    net = langid.train([b"the and of to in is", b"der die und das ist ein"] * 10, ["en", "de"] * 10)
    rows = langid.identify(docs, net, ["doc_id", "text", "k"]).collect()
    assert len(rows) == len(corpus) and all(r.k == "a" for r in rows)
    for r in rows:
        letters = any(c.isalpha() for c in r.text or "")
        assert (r.lang_pred == "und") == (not letters) and 0 <= r.score <= 1
    assert langid.identify(nothing, net).count() == 0
    assert langid.sample_windows(nothing) == ([], [])


def test_windows_cover_whole_texts():
    net = langid.train([b"the and of to in is", b"der die und das ist ein"] * 10, ["en", "de"] * 10)
    text = b"der die und das ist ein " * 30 + b"the and of to in is " * 3000
    (lang, score), *_ = langid.classify(net, [text])
    assert lang == "en" and score > 0.8


def test_training_skips_the_held_out_quarter(spark):
    import zlib

    ids = [i for i in range(400) if zlib.crc32(str(i).encode()) % 4 == 2]
    df = spark.createDataFrame([(i, f"some text {i}", "en") for i in ids], "doc_id long, text string, lang string")
    assert langid.sample_windows(df) == ([], [])


def test_toxicity_chain_on_held_out_rows(spark):
    docs, labels = spark.read.parquet("/root/testdata/sf0.1/documents.parquet"), spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    chain = toxicity.learn(docs, labels.where("doc_id % 2 = 0"), toxicity.categories(), 2000)
    assert chain.names == ["junk", "toxic"] and len(chain.links[1].earlier) == 1
    out = toxicity.score(docs, chain, chain.names).join(labels.where("doc_id % 2 = 1"), "doc_id")
    r = out.agg(F.avg(((F.col("p_toxic") >= 0.5).cast("int") == F.col("toxic")).cast("double")), F.sum(((F.col("p_toxic") >= 0.5) & (F.col("toxic") == 0)).cast("int"))).first()
    assert r[0] > 0.93 and r[1] < 40


def test_toxicity_edges(spark, docs, corpus, nothing):
    rows = toxicity.score(docs, None, ["junk", "toxic"]).collect()
    assert len(rows) == len(corpus) and all(r.p_toxic == 0 for r in rows)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert toxicity.learn(docs, none, toxicity.categories()) is None
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(60)] + [(None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")
    chain = toxicity.learn(docs, labels, toxicity.categories())
    rows = toxicity.score(docs, chain, chain.names).collect()
    assert len(rows) == len(corpus) and all((r.p_toxic == 0) or 0 < r.p_toxic < 1 for r in rows)
    assert toxicity.score(nothing, chain, chain.names).count() == 0


def plain_tiles(a, b, least):
    """Greedy tiling by the definition: mark the longest common unmarked run, again and again."""
    ma, mb, out = [False] * len(a), [False] * len(b), []
    while True:
        best = (0, 0, 0)
        for i in range(len(a)):
            for j in range(len(b)):
                n = 0
                while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n] and not ma[i + n] and not mb[j + n]:
                    n += 1
                if n > best[0]:
                    best = (n, i, j)
        n, i, j = best
        if n < least:
            return sorted(out, reverse=True)
        ma[i : i + n] = [True] * n
        mb[j : j + n] = [True] * n
        out.append(n)


@pytest.mark.parametrize("seed", range(12))
def test_tiles_are_greedy(seed):
    rng = random.Random(seed)
    a = [rng.randrange(6 if seed % 2 else 60) for _ in range(40)]
    cut = rng.randrange(10, 30)
    b = [99] * 3 + a[cut:] + [98] + a[:cut] + [rng.randrange(6) for _ in range(20)]
    found = tiles(np.array(a), np.array(b), 3)
    assert [t[0] for t in found] == plain_tiles(a, b, 3)
    assert all(a[i : i + n] == b[j : j + n] for n, i, j in found)


def test_long_repeated_texts_are_tiled_in_time():
    started = time.perf_counter()
    assert coverage(b"x " * 5000, b"x " * 20_000) == (1.0, 1)
    assert coverage(b"x " * 20_000, b"x " * 5000) == (0.25, 1)
    five = b" ".join(b"x x x x x y%d" % i for i in range(800))
    assert coverage(five, b" ".join(b"x x x x x z%d" % i for i in range(4000))) == (5 / 6, 800)
    assert coverage(b"a b c " * 3000, b"c b a " * 9000) == (0.0, 0)
    assert time.perf_counter() - started < 8


def test_words_that_share_a_fingerprint_are_told_apart(spark):
    bench = spark.createDataFrame([(1, "one two three four abcdefghijklmnop")], "item_id long, text string")
    df = spark.createDataFrame([(1, "one two three four mddvp1yus9uj24ws"), (2, "one two three four abcdefghijklmnop")], "doc_id long, text string")
    got = {r.doc_id: (r.contaminated, r.coverage) for r in decontaminate(df, bench).collect()}
    assert got == {1: (False, 0.0), 2: (True, 1.0)}


def test_windows_of_one_hash_are_compared(monkeypatch):
    monkeypatch.setattr(decontamination, "mix", lambda x: np.zeros_like(x))  # every window hashes to 0
    rng = random.Random(3)
    for _ in range(30):
        a, b = ([rng.randrange(3) for _ in range(25)] for _ in range(2))
        assert [t[0] for t in tiles(np.array(a), np.array(b), 3)] == plain_tiles(a, b, 3)


def test_a_stock_phrase_makes_no_pairs(spark):
    phrase = "all of this has been said before by many"
    word = lambda k, n: " ".join(f"{k}x{i}" for i in range(n))
    items = [(i, f"{word(f'i{i}', 12)} {phrase}") for i in range(40)]
    texts = [(i, f"{phrase} {word(f'd{i}', 30)}") for i in range(200)] + [(900, word("z", 9) + " " + items[7][1]), (901, items[8][1].split(" all")[0])]
    bench, df = spark.createDataFrame(items, "item_id long, text string"), spark.createDataFrame(texts, "doc_id long, text string")
    counts = []
    with pytest.MonkeyPatch.context() as m:
        whole = decontamination.pairs_of
        m.setattr(decontamination, "pairs_of", lambda *a: (counts.append((p := whole(*a)).count()), p)[1])
        got = {r.doc_id: (r.best_item, r.n_items, round(r.coverage, 3)) for r in decontaminate(df, bench).collect()}
        assert counts[0] <= 4
        assert {k: v for k, v in got.items() if v[0] is not None} == {900: (7, 1, 1.0)}
        every = {r.doc_id: r.coverage for r in decontaminate(df, bench, report=0.0).collect()}
        assert counts[1] >= 40 * 200 and every[901] == pytest.approx(12 / 21) and every[0] == pytest.approx(9 / 21)


def test_common_seeds_cover_less_than_what_is_reported():
    rng = random.Random(6)
    for _ in range(50):
        seeds = [rng.randrange(30) for _ in range(rng.randrange(1, 60))]
        counts = {s: rng.randrange(1, 9) for s in set(seeds) if rng.random() < 0.8}
        out = decontamination.common_seeds(seeds, counts, 0.6)
        covered = {q for p, s in enumerate(seeds) if s in out for q in range(p, p + 5)}
        assert out <= set(counts) and len(covered) / (len(seeds) + 4) < 0.6
        assert not decontamination.common_seeds(seeds, counts, 0.0)


def test_decontamination(spark, docs, corpus, nothing):
    rng = random.Random(1)
    items = [(i, " ".join(f"b{rng.randrange(900)}" for _ in range(30))) for i in range(6)] + [(7, "too short"), (8, None), (None, "x " * 9), (9, "")]
    a, b = items[0][1].split(), items[1][1].split()
    noise = [f"n{i}" for i in range(4000)]
    texts = [(1, " ".join(noise + a + noise)), (2, " ".join(b[15:] + noise[:9] + b[:15]).upper() + "!"), (3, " ".join(noise[:20] + a[:12])), (4, None), (5, ""), (None, ", ".join(b)), (6, " ".join(a + b))]
    df = spark.createDataFrame([(i, t, "y") for i, t in texts], "doc_id long, text string, item string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item): r for r in decontaminate(df, bench, ["doc_id", "item"], report=0.0).collect()}
    flags = {k[0]: (r.contaminated, r.best_item, r.n_items, r.n_tiles) for k, r in got.items()}
    assert flags == {1: (True, 0, 1, 1), 2: (True, 1, 1, 2), 3: (False, 0, 0, 1), 4: (False, None, 0, 0), 5: (False, None, 0, 0), None: (True, 1, 1, 1), 6: (True, 0, 2, 1)}
    assert got[3, "y"].coverage == pytest.approx(0.4)
    assert decontaminate(nothing, bench).count() == 0
    assert decontaminate(docs, bench.where("false")).where("contaminated").count() == 0


def plain_words(t):
    return re.findall(r"[a-z0-9\u0080-\U0010ffff]+", (t or "").lower())


@pytest.mark.parametrize("report", [None, 0.0, 0.3])
def test_decontamination_against_brute_force(spark, report):
    """Every document against every item, tiled by the definition."""
    rng = random.Random(12)
    items = [(i, " ".join(f"v{rng.randrange(40)}" for _ in range(rng.randrange(4, 26)))) for i in range(12)] + [(3, " ".join(f"v{rng.randrange(40)}" for _ in range(15)))]
    texts = []
    for i in range(60):
        parts = [f"n{rng.randrange(300)}" for _ in range(rng.randrange(20))]
        for _ in range(rng.randrange(4)):
            own = rng.choice(items)[1].split()
            lo = rng.randrange(len(own))
            parts += own[lo : lo + rng.randrange(3, 26)] + ["x"] * rng.randrange(2)
        texts.append((i if i % 9 else None, " ".join(parts)))
    texts += [(5, texts[5][1]), (5, texts[6][1])]
    df, bench = spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = Counter((r.doc_id, r.contaminated, r.best_item, round(r.coverage, 9), r.n_items, r.n_tiles) for r in decontaminate(df, bench, report=report).collect())
    want = Counter()
    for i, t in texts:
        best, over = (0.0, 0, 0), set()
        for j, item in items:
            a, b = plain_words(item), plain_words(t)
            if len(a) < 5:
                continue
            found = plain_tiles(a, b, 5)
            share = sum(found) / len(a)
            if share >= 0.6:
                over.add(j)
            best = max(best, (share, -j, -len(found))) if share and share >= (0.6 if report is None else report) else best
        want[i, best[0] >= 0.6, -best[1] if best[0] else None, round(best[0], 9), len(over), -best[2]] += 1
    assert got == want


def test_many_items(spark):
    items = [(i, " ".join(f"i{i}w{k}" for k in range(12))) for i in range(9)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    df = spark.createDataFrame([(i, t) for i, t in items] + [(99, items[3][1] + " " + items[8][1])], "doc_id long, text string")
    got = {r.doc_id: (r.best_item, r.n_items) for r in decontaminate(df, bench).collect()}
    assert got == {**{i: (i, 1) for i in range(9)}, 99: (3, 2)}


def test_decontamination_query(spark):
    from sitelode.llm.decontaminate import op6_decontaminate

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = op6_decontaminate(spark, SF)
    assert rows.columns == ["doc_id", "contaminated", "best_item", "coverage", "n_items", "n_tiles"]
    assert rows.count() == docs.count() and 0 < rows.where("contaminated").count() < docs.count() / 5


def test_softmax_rows_sum_to_one():
    assert np.allclose(langid._softmax(np.random.default_rng(0).normal(size=(5, 3))).sum(axis=1), 1)


def test_language_forward_pass_against_plain_loops():
    """Filters at every place, the highest answer of each, softmax; a text's score is the mean of its windows."""
    rng = np.random.default_rng(3)
    net = langid.train([b"the and of to in is", b"der die und das ist ein"] * 10, ["en", "de"] * 10)
    text = bytes(rng.integers(97, 123, 300).astype(np.uint8)) + b" the and"
    data, windows = langid.padded([text])
    got = langid.window_probabilities(net, data)
    assert windows.tolist() == [2]
    for w in range(2):
        best = []
        for width, table in zip(langid.WIDTHS, net.tables):
            for f in range(langid.FILTERS):
                best.append(max(sum(float(table[j][data[w * langid.WINDOW + p + j]][f]) for j in range(width)) for p in range(langid.WINDOW)))
        z = [sum(max(b + float(c), 0) * float(net.dense[i][k]) for i, (b, c) in enumerate(zip(best, net.bias))) + float(net.offset[k]) for k in range(2)]
        e = np.exp(np.array(z) - max(z))
        assert np.allclose(got[w], e / e.sum(), atol=1e-4)


def test_chain_against_plain_folds():
    """Later categories learn from probabilities of models that never saw the row."""
    rng = np.random.default_rng(4)
    n = 240
    y = {"a": rng.integers(0, 2, n), "b": rng.integers(0, 2, n)}
    each = [np.unique(np.concatenate([rng.integers(100, 130, 5), [1 + y["a"][i]] * (rng.random() < 0.8), [10 + y["b"][i]] * (rng.random() < 0.8)])).astype(np.uint64) for i in range(n)]
    counts, words, folds = np.array([len(x) for x in each]), np.concatenate(each), np.arange(n) % toxicity.FOLDS
    chain = toxicity.train_chain(["a", "b"], words, counts, y, folds)
    owner, held = np.repeat(np.arange(n), counts), np.zeros(n)
    for f in range(toxicity.FOLDS):
        link = toxicity._fit(words, owner, n, np.zeros((n, 0)), y["a"], folds != f)
        for i in np.flatnonzero(folds == f):
            z = link.bias + sum(float(link.weights[list(link.words).index(w)]) for w in each[i] if w in link.words)
            held[i] = 1 / (1 + np.exp(-z))
    want = toxicity._fit(words, owner, n, held[:, None], y["b"], np.ones(n, bool))
    assert np.allclose(chain.links[1].weights, want.weights) and np.allclose(chain.links[1].earlier, want.earlier) and len(want.earlier) == 1


def test_vocabulary_of_executors_is_what_the_models_choose(spark, monkeypatch):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    marks = {r.doc_id: (int(r.quality == 0), int(r.toxic == 1)) for r in labels.collect()}
    texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect() if r.doc_id in marks and r.text is not None}
    chain = toxicity.learn(docs, labels, toxicity.categories())
    words, counts = toxicity.presence([t.encode() for t in texts.values()])
    ends = np.cumsum(counts)
    folds = np.array([int(words[e - c] % np.uint64(toxicity.FOLDS)) if c else 0 for e, c in zip(ends, counts)])
    plain = toxicity.train_chain(["junk", "toxic"], words, counts, {"junk": np.array([marks[i][0] for i in texts]), "toxic": np.array([marks[i][1] for i in texts])}, folds)
    for a, b in zip(chain.links, plain.links):
        assert a.words.tolist() == b.words.tolist() and np.allclose(a.weights, b.weights, atol=1e-6) and abs(a.bias - b.bias) < 1e-6


def test_contradicting_labels_and_repeated_ids(spark):
    text = [(i, f"good fine w{i % 5}" if i % 2 else f"vile rude w{i % 5}") for i in range(80)]
    labels = [(i, 1, (i + 1) % 2) for i in range(80)]
    df = spark.createDataFrame(text, "doc_id long, text string")
    one = toxicity.learn(df, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), toxicity.categories())
    more = spark.createDataFrame(labels + [(i, 1, 0) for i in range(80)], "doc_id long, quality int, toxic int")
    two = toxicity.learn(df.unionByName(df), more, toxicity.categories())
    assert one.links[1].weights.tolist() == two.links[1].weights.tolist() and one.links[1].words.tolist() == two.links[1].words.tolist()


def test_toxicity_query(spark):
    rows = toxicity.op9_toxicity(spark, SF)
    assert rows.columns == ["doc_id", "p_junk", "p_toxic", "toxic"] and rows.count() == spark.read.parquet(f"{SF}/documents.parquet").count()
