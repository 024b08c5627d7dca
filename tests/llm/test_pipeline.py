import random

import corpus_pipeline as pipeline
from sitelode.llm.scratch import drop_scratch, materialize


def test_stages_keep_clean_documents_and_take_effect(spark, tmp_path):
    rng = random.Random(4)
    en, de = "the of and to in is that with for was".split(), "der die und das ist ein nicht mit von zu".split()

    def prose(n, base):
        return " ".join(rng.choice(base) if rng.random() < 0.5 else base[0] + base[rng.randrange(10)] + str(rng.randrange(10**6)) for _ in range(n))

    docs = [(i, prose(80, en if i % 2 else de), "en" if i % 2 else "de", "s", 1) for i in range(80)]
    item = prose(30, en)
    passage = prose(30, en)
    docs[11] = (11, docs[11][1] + " " + item, "en", "s", 1)
    docs[20] = (20, docs[20][1] + " " + passage, "de", "s", 1)
    docs[31] = (31, docs[31][1] + " " + passage + " end", "en", "s", 1)
    docs += [(100, docs[3][1], "en", "s", 1), (101, docs[4][1] + " more", "de", "s", 1), (102, None, None, "s", None), (103, "12 34 !!", "en", "s", 8), (None, prose(50, en), "en", None, 1)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = {r.doc_id: r for r in pipeline.run(spark, str(tmp_path)).collect()}
    assert set(out) == ({*range(80), None} - {11})
    assert out[20].text == docs[20][1] and out[31].text == docs[31][1].replace(" " + passage, "")
    assert all(len(r.pieces) > 0 for r in out.values())


def test_every_stage_takes_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert pipeline.run(spark, str(tmp_path)).count() == 0


def test_near_duplicates_keep_one_row_of_each_class(spark):
    rng = random.Random(8)
    a, b, c, d, e = (" ".join(f"w{rng.randrange(10**6)}" for _ in range(60)) for _ in range(5))
    near = a.rsplit(" ", 1)[0] + " end"
    docs = [(5, a), (7, a), (5, b), (3, b), (9, near), (None, a)]  # ids that repeat with other texts
    docs += [(1, c), (1, c), (1, c), (2, c), (None, d), (None, d), (None, d.upper()), (2, e)]  # repeated rows, null ids
    docs += [(2**63 - 1, "w"), (None, "w"), (8, None), (8, None), (8, "")]
    rows = [(i, t, "en", "s", len(t or "")) for i, t in docs]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(4)
    out = sorted((r.doc_id, (r.text or "").lower()) for r in pipeline.near_duplicates(spark, df, "").collect() if r.doc_id is not None)
    assert out == sorted([(5, a), (3, b), (1, c), (2, e), (2**63 - 1, "w"), (8, ""), (8, ""), (8, "")])
    assert [r.text.lower() for r in pipeline.near_duplicates(spark, df, "").where("doc_id IS NULL").collect()] == [d]


def test_scratch_tables_can_be_read_again_and_dropped(spark):
    t = materialize(spark.range(5), "t")
    assert t.count() == 5 and t.columns == ["id"]
    drop_scratch(t)


def test_each_stage_against_brute_force(spark, tmp_path):
    """Every stage on its own input: what is kept, and with which text."""
    import public_tokenizers
    from test_dedup import removed, words_of
    from test_jaccard import sets
    from test_text_models import plain_tiles, plain_words

    from sitelode.llm.pieces import decode_pieces

    rng = random.Random(21)
    en, de = "the of and to in is that with for was".split(), "der die und das ist ein nicht mit von zu".split()
    prose = lambda n, base: [rng.choice(base) if rng.random() < 0.5 else f"{base[0]}{rng.randrange(10**6)}" for _ in range(n)]
    body = {i: prose(rng.randrange(15, 70), en if i % 2 else de) for i in range(60)}
    item, passage = prose(30, en), prose(20, en)
    for i in (7, 21, 33):
        body[i] += passage
    body[12] += item[10:] + ["x"] + item[:10]
    for i in (41, 42, 43):
        body[i] = body[3][: 60 - i % 3] + ["end"] * (i % 2)
    docs = [(i, " ".join(w), "en" if i % 2 else "de", "s", 1) for i, w in body.items()] + [(5, " ".join(body[9]), "en", "s", 1), (None, " ".join(body[8]), "de", "s", 1), (90, "12 34", None, "s", 1)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    items = [(1, " ".join(item)), (2, "a b c")]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = spark.read.parquet(f"{tmp_path}/documents.parquet")
    key = lambda r: (r.doc_id is None, r.doc_id or 0, r.text or "")
    steps = []
    for name, stage in pipeline.STAGES:
        before = sorted(rows.collect(), key=key)
        rows = materialize(stage(spark, rows, str(tmp_path)), "step")
        steps.append((name, before, sorted(rows.collect(), key=key)))

    # language ID: what is kept is a part of what was there, and all of it has letters
    _, before, after = steps[0]
    assert {key(r) for r in after} <= {key(r) for r in before} and len(after) >= 0.9 * len(before) and all(any(c.isalpha() for c in r.text) for r in after)
    # near duplicates: one row of each class, that of the least id
    _, before, after = steps[1]
    s, label = sets([r.text for r in before]), list(range(len(before)))
    for _ in before:
        for i in range(len(s)):
            for j in range(len(s)):
                if s[i] and 5 * len(s[i] & s[j]) >= 4 * len(s[i] | s[j]):
                    label[i] = label[j] = min(label[i], label[j])
    assert [key(r) for r in after] == [key(r) for i, r in enumerate(before) if label[i] == i]
    # substrings: the words that no smaller document has in a window of 13
    _, before, after = steps[2]
    want = [(i, " ".join(w for w, x in zip(u, gone) if not x)) for i, u, gone in removed([(r.doc_id, r.text) for r in before], words_of, 13)]
    assert sorted((r.doc_id or -1, r.text) for r in after) == sorted((i or -1, t) for i, t in want if t)
    # decontamination: tiles over at least 0.6 of some item
    _, before, after = steps[3]
    dirty = lambda t: any(len(plain_words(x)) >= 5 and sum(plain_tiles(plain_words(x), plain_words(t), 5)) >= 0.6 * len(plain_words(x)) for _, x in items)
    assert [key(r) for r in after] == [key(r) for r in before if not dirty(r.text)] and len(after) < len(before)
    # pieces: they spell the text
    _, before, after = steps[4]
    back = decode_pieces(rows, public_tokenizers.path("piece_bpe_32k.model"), ["doc_id", "text"]).collect()
    assert [key(r) for r in after] == [key(r) for r in before] and all(r.text == r.decoded for r in back)
