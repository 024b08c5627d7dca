import random
import time
import zlib
from collections import Counter

import numpy as np
import pyarrow.fs
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")

from sitelode.llm import records  # noqa: E402
from sitelode.llm.pieces import Lattice, decode_pieces, encode_pieces, lattice  # noqa: E402
from sitelode.llm.records import RecordFile, read_back, write_records  # noqa: E402

WORDS = public_tokenizers.path("word_bpe_49k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")


def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(WORDS)


def test_records_against_the_library(docs, corpus):
    folder, manifest = write_records(docs, WORDS)
    rows = read_back(folder, manifest).collect()
    tok = library()
    want = Counter()
    for i, t in corpus:
        ids = tok.encode(t or "", add_special_tokens=False).ids + [2]
        want[i, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())] += 1
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in rows) == want
    at, last = 0, -1
    for r in sorted(rows, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
        now = -1 if r.doc_id is None else r.doc_id
        assert now >= last
        last = now


def test_shuffled_reads_and_damage(docs):
    folder, manifest = write_records(docs, WORDS)
    name = max(manifest.collect(), key=lambda r: r.docs).file
    f = RecordFile(folder, name)
    index = f.index()
    straight = [(d, i.tolist()) for d, i in f.read(index[:, 0].tolist())]
    back = [(d, i.tolist()) for d, i in f.read(index[::-1, 0].tolist())]
    assert back == straight[::-1]
    fs, root = pyarrow.fs.FileSystem.from_uri(folder)
    raw = bytearray(fs.open_input_file(f"{root}/{name}.rec").read())
    raw[30] ^= 1
    with fs.open_output_stream(f"{root}/bad.rec") as out:
        out.write(bytes(raw))
    f.name = "bad"
    with pytest.raises(ValueError, match="damaged"):
        list(f.read([0]))


def test_words_beyond_the_cache(monkeypatch):
    monkeypatch.setattr(records, "CACHE_WORDS", 3)
    e, tok = records.Encoder(WORDS), library()
    for t in ["It's one's we're  Ünïcode²  漢字🎉 1234 á a\x1cb", "a b c d e f", "a b ½ x́", "<|endoftext|> ΣΑΣ"]:
        assert np.frombuffer(e(t.encode()), "<u2").tolist() == tok.encode(t, add_special_tokens=False).ids


def test_no_rows(nothing):
    assert read_back(*write_records(nothing, WORDS)).count() == 0
    assert encode_pieces(nothing, PIECES).count() == 0


def test_pieces_are_lossless_and_reproducible(docs, corpus):
    coded = encode_pieces(docs, PIECES, ["doc_id", "text", "k"])
    rows = decode_pieces(coded, PIECES, ["doc_id", "text"]).collect()
    assert len(rows) == len(corpus) and all(r.decoded == r.text for r in rows)
    one = sorted(map(repr, coded.collect()))
    two = sorted(map(repr, encode_pieces(docs.repartition(2), PIECES, ["doc_id", "text", "k"]).collect()))
    assert one == two
    cut = lattice(PIECES)
    assert all("".join(cut.bytes_of[p].decode("latin1") for p in r.pieces) == (" " + r.text if r.text else "").encode().decode("latin1") for r in coded.where("text is not null").collect())


def test_samples_follow_the_weights():
    cut = lattice(PIECES)
    word, n = b"there", 20000
    ids, counts = cut.sample([word] * n, np.arange(n).astype(np.uint64) * 7919)
    ends = np.cumsum(counts)
    got = Counter(tuple(ids[e - c : e].tolist()) for e, c in zip(ends, counts))
    weight = dict(zip(cut.piece.tolist(), cut.weight.tolist()))
    known = {b: i for i, b in enumerate(cut.bytes_of) if i in weight}

    def ways(s):
        if not s:
            yield (), 1.0
        for k in range(1, len(s) + 1):
            if s[:k] in known:
                for rest, w in ways(s[k:]):
                    yield (known[s[:k]], *rest), w * weight[known[s[:k]]]

    every = dict(ways(b" " + word))
    total = sum(every.values())
    assert set(got) <= set(every)
    for way, w in every.items():
        p = w / total
        assert abs(got[way] / n - p) < 0.015


def test_high_theta_is_close_to_the_best():
    cut = Lattice(PIECES, theta=50.0)
    ids, counts = cut.sample([b"the cat"] * 50, np.arange(50).astype(np.uint64))
    assert len({tuple(x) for x in ids.reshape(50, -1).tolist()}) == 1 and counts[0] * 50 == len(ids)


@pytest.mark.parametrize("name, by_part", [("word_bpe_49k.json", True), ("byte_bpe_50k.json", False)])
def test_shortcuts_only_where_a_probe_allows(name, by_part):
    e = records.Encoder(public_tokenizers.path(name))
    assert e.by_part is by_part and e.by_word is by_part
    for t in ["Hello  there, General!\n\nYes-no (maybe)? It's <|endoftext|> fine..", ""]:
        assert np.frombuffer(e(t.encode()), e.kind).tolist() == e.library.encode(t, add_special_tokens=False).ids


def thue_morse(size):
    """Two words whose polynomial hashes modulo 2**64 agree, whatever the base."""
    out = b"a"
    while len(out) < size:
        out += out.translate(bytes.maketrans(b"ab", b"ba"))
    return out.decode(), out.translate(bytes.maketrans(b"ab", b"ba")).decode()


def test_round_trip_against_encode_and_decode(spark, docs, corpus, tmp_path):
    from sitelode.llm.pieces import op8_sentencepiece, round_trip

    one, two = thue_morse(2048)
    more = [(300, f"{one} {two}"), (301, f"{two} {one} x"), (302, "a" * 5000)]
    df = docs.select("doc_id", "text", "k").unionByName(spark.createDataFrame([(i, t, "z") for i, t in more], "doc_id long, text string, k string"))
    rows = round_trip(df, PIECES).collect()
    want = Counter()
    for r in encode_pieces(df, PIECES, ["doc_id", "text"]).collect():
        raw = np.array(r.pieces or [], "<u4").tobytes()
        want[r.doc_id, len(r.pieces or []), zlib.crc32(raw), zlib.crc32((r.text or "").encode()), True] += 1
    assert Counter(tuple(r) for r in rows) == want and len(rows) == len(corpus) + 3
    df.write.parquet(f"{tmp_path}/documents.parquet")
    assert Counter(tuple(r) for r in op8_sentencepiece(spark, str(tmp_path)).collect()) == want


def test_a_word_is_cut_alike_wherever_it_stands():
    cut = lattice(PIECES)
    key = np.array([77], np.uint64)
    alone = cut.sample([b"there was a thing"], key)[0].tolist()
    before = [b"filler%d " % i * 40 for i in range(300)]
    ids, counts = cut.sample([*before, b"there was a thing"], np.append(np.arange(300).astype(np.uint64), key))
    assert ids[-counts[-1] :].tolist() == alone
    one = cut.edges(np.frombuffer(b" there", np.uint8), np.array([0]), np.array([6]))[0]
    text = np.frombuffer(b" xy" * 40000 + b" there", np.uint8)
    far, base = cut.edges(text, np.append(np.arange(40000) * 3, 120000), np.append(np.full(40000, 3), 6))
    mask = np.uint64((1 << 32) - 1)
    here = far.starts >= base[-1]
    assert (far.upto[here] - (np.uint64(base[-1]) << np.uint64(32))).tolist() == one.upto.tolist() and (one.upto & mask).max() > 0


def test_records_query(spark, docs, corpus, tmp_path):
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    rows = records.op7_token_records(spark, str(tmp_path)).collect()
    tok = library()
    assert sum(r.n_tokens for r in rows) == sum(len(tok.encode(t or "", add_special_tokens=False).ids) + 1 for _, t in corpus)


def test_long_words_are_cut_in_rounds_and_one_by_one_alike(monkeypatch):
    from sitelode.llm import pieces

    rng = random.Random(7)
    cut = lattice(PIECES)
    letters = b"abcdefghijklmnopqrstuvwxyzABC019+/"
    long = bytes(rng.choice(letters) for _ in range(4000))
    texts = [long, "漢字かな交じり文".encode() * 90, b"aaaaaaaaaaa" * 200, b"word two " * 40 + long[:900], b"", b"a", *(long[i * 9 : i * 10] for i in range(40))]
    keys = np.arange(len(texts)).astype(np.uint64)
    found = []
    for few in (0, 1, 12, 10**6):
        monkeypatch.setattr(pieces, "FEW", few)
        ids, counts = cut.sample(texts, keys)
        found.append((ids.tolist(), counts.tolist()))
        assert cut.decode(ids, counts) == texts
    assert all(f == found[0] for f in found)


def test_a_text_without_blanks_costs_a_few_times_one_with_blanks():
    rng = random.Random(8)
    cut = lattice(PIECES)
    long = bytes(rng.choice(b"abcdefghijklmnopqrstuvwxyz0123456789") for _ in range(100_000))
    short = b" ".join(long[i : i + 6] for i in range(0, len(long), 6))
    seconds = {}
    for name, text in (("short", short), ("long", long), ("short", short)):
        started = time.perf_counter()
        cut.sample([text], np.array([1], np.uint64))
        seconds[name] = time.perf_counter() - started
    assert seconds["long"] < max(2.0, 12 * seconds["short"])
