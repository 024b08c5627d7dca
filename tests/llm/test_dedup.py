import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest

from sitelode.llm import packs
from sitelode.llm.substrings import COVER, PERIOD, dedup_substrings
from sitelode.llm.suffixes import _Sorter, covered, dedup_suffixes

NONE = float("inf")


def removed(corpus, units, n):
    """Positions under n consecutive units that also start in a document of a smaller id."""
    least = {}
    split = [(NONE if i is None else i, i, units(t)) for i, t in corpus]
    for rank, _, u in split:
        for k in range(len(u) - n + 1):
            key = tuple(u[k : k + n])
            least[key] = min(least.get(key, NONE), rank)
    for rank, i, u in split:
        gone = [False] * len(u)
        for k in range(len(u) - n + 1):
            if least[tuple(u[k : k + n])] < rank:
                gone[k : k + n] = [True] * n
        yield i, u, gone


def words_of(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def want_words(corpus):
    return Counter((i, len(u), sum(g), " ".join(w for w, x in zip(u, g) if not x)) for i, u, g in removed(corpus, words_of, 13))


def want_bytes(corpus):
    out = Counter()
    for i, u, g in removed(corpus, lambda t: (t or "").encode(), 50):
        spans = sum(x and (k == 0 or not g[k - 1]) for k, x in enumerate(g))
        out[i, len(u), sum(g), spans, bytes(b for b, x in zip(u, g) if not x)] += 1
    return out


def got_words(df):
    return Counter((r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in df.collect())


def got_bytes(df):
    return Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in df.collect())


@pytest.mark.parametrize("common", [packs.COMMON, 2])
@pytest.mark.parametrize("size", [packs.PACK_BYTES, 300])
def test_words_and_bytes_against_brute_force(docs, corpus, monkeypatch, common, size):
    monkeypatch.setattr(packs, "COMMON", common)
    monkeypatch.setattr(packs, "PACK_BYTES", size)
    if size != packs.PACK_BYTES or common == packs.COMMON:
        assert got_words(dedup_substrings(docs)) == want_words(corpus)
    assert got_bytes(dedup_suffixes(docs)) == want_bytes(corpus)


def test_other_columns_come_along(docs):
    out = dedup_substrings(docs, ["doc_id", "text", "k", "t", "pack"])
    assert out.columns == ["doc_id", "text", "k", "t", "pack", "n_words", "n_removed", "kept_text"]
    assert all(r.k == "a" and r.t == "c" and r.n_words == len(words_of(r.text)) for r in out.collect())


def test_empty(nothing):
    assert dedup_substrings(nothing).count() == 0 and dedup_suffixes(nothing).count() == 0


def test_cover_has_every_difference():
    assert {(a - b) % PERIOD for a in COVER for b in COVER} == set(range(PERIOD))


def test_two_stage_sort_is_a_sort():
    rng = np.random.default_rng(1)
    for trial in range(30):
        sizes = rng.integers(1, 36, int(rng.integers(1, 25)))
        source = rng.integers(0, rng.integers(1, 5), 400).astype(np.uint8) + 97
        if trial % 3 == 0:
            source[:] = 97
            source[:: int(rng.integers(30, 90))] = 98
        bodies = [source[o : o + s + 49] for s, o in zip(sizes, rng.integers(0, 300, len(sizes)))]
        sorter = _Sorter(np.concatenate(bodies), sizes)
        unit = np.repeat(np.arange(len(sizes)), sizes + 49 + sorter.chars)
        strings = [bytes(bodies[unit[p]][p - sorter.first[unit[p]] :][:50]) for p in sorter.suffixes()]
        assert strings == sorted(strings) and len(strings) == sizes.sum()
        ids = rng.integers(0, 6, len(sizes))
        least = {}
        windows = [(d, bytes(b[k : k + 50])) for d, b, s in zip(ids, bodies, sizes) for k in range(s)]
        for d, w in windows:
            least[w] = min(least.get(w, 9), d)
        assert covered(ids, sizes, np.concatenate(bodies)).tolist() == [least[w] < d for d, w in windows]


def test_digest_columns(spark, tmp_path):
    from sitelode.llm.substrings import op5_substring_dedup
    from sitelode.llm.suffixes import op3_suffix_dedup

    text = " ".join(f"v{random.Random(1).random()}{i}" for i in range(40))
    spark.createDataFrame([(1, text), (2, "start " + text)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    five = {r.doc_id: r for r in op5_substring_dedup(spark, str(tmp_path)).collect()}
    assert five[1].n_removed == 0 and five[2].n_removed == 40
    assert five[2].kept_sha256 == hashlib.sha256(b"start").hexdigest()
    three = {r.doc_id: r for r in op3_suffix_dedup(spark, str(tmp_path)).collect()}
    assert three[2].kept_sha256 == hashlib.sha256(b"start ").hexdigest() and three[2].n_spans == 1


def test_words_with_equal_polynomial_hashes_stay_apart(spark):
    from test_tokens import thue_morse

    one, two = thue_morse(2048)
    common = " ".join(f"c{i}" for i in range(12))
    rows = [(1, f"{common} {one}"), (2, f"{common} {two}"), (3, f"{common} {one}")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert got_words(dedup_substrings(df)) == want_words(rows)
    assert got_bytes(dedup_suffixes(df)) == want_bytes(rows)


def test_groups_are_of_equal_bytes():
    from sitelode.llm.words import gram_ids, groups, words_of

    rng = random.Random(3)
    w = words_of([" ".join(rng.choice(["a", "bb", "ccccccccc", "ccccccccd", "d" * 200, "e" * 200]) for _ in range(300)).encode()])
    each = [w.data[s:e].tobytes() for s, e in zip(w.starts, w.ends)]
    for hashes in (w.hashes, np.zeros(len(each), np.uint64), w.hashes % np.uint64(2)):
        group, first = groups(w.data, w.starts, w.ends, hashes)
        assert len(set(zip(group.tolist(), each))) == len(set(each)) == len(set(group.tolist()))
        assert all(each[first[g]] == x for g, x in zip(group, each))
    ids, three = w.ids(), [tuple(each[i : i + 3]) for i in range(298)]
    assert len(set(zip(gram_ids(ids, 3).tolist(), three))) == len(set(three)) == len(set(gram_ids(ids, 3).tolist()))


def test_common_prefixes():
    body = np.frombuffer(b"abcabcabd" * 12, np.uint8)
    s = _Sorter(body, np.array([len(body) - 49]))
    at = [(i, j) for i in range(len(body) - 49) for j in range(len(body) - 49)]
    a, b = np.array(at).T
    text = body.tobytes()

    def plain(i, j):
        n = 0
        while n < 50 and text[i + n] == text[j + n]:
            n += 1
        return n

    assert s.common_prefix(s.first[0] + a, s.first[0] + b).tolist() == [plain(i, j) for i, j in at]


def test_neighbours_in_order_agree_as_any_two_places_do():
    rng = random.Random(7)
    for letters in (b"ab", b"abcdefgh \n", bytes(range(256))):
        sizes = np.array([rng.randrange(1, 90) for _ in range(40)])
        passage = bytes(rng.choice(letters) for _ in range(150))
        body = b"".join((passage if rng.random() < 0.5 else bytes(rng.choice(letters) for _ in range(150)))[: n + 49] for n in sizes)
        s = _Sorter(np.frombuffer(body, np.uint8), sizes)
        order = s.suffixes()
        assert len(s.key) == len(s.code) + 50 and s.code.dtype == np.uint16
        assert s.neighbours(order).tolist() == s.common_prefix(order[1:], order[:-1]).tolist()
        assert s.neighbours(order[:1]).tolist() == s.neighbours(order[:0]).tolist() == []
