"""Sampled SentencePiece segmentations, by forward filtering and backward sampling.

All ways to write a text in pieces form a lattice over its bytes. Going forward, each place gets the
total weight of the ways up to it; going backward from the end, the piece that ends at a place is drawn
in proportion to its weight times that of the ways to its start. That draws whole segmentations in
proportion to their weights. Draws come from a counter: a hash of the row key and the place. Shares are
whole numbers of 1 / 2**32, made word by word with additions, multiplications and divisions alone, which
every machine rounds alike, so a text is cut alike in every run, batch and cluster.

The model file is a merge model: its scores are merge ranks, not probabilities. A piece's weight here is
that of a word of its rank under Zipf's law, 1 / (rank + 2), to the power ``theta`` (a power is taken only once
for each piece, and not for the default of 1).

Spaces are pieces' word marks, and a text gets one more in front, as the library does. A word mark that
is part of the text, and every character without a piece of its own, can be written in byte pieces, so
that decoding gives the text back, byte by byte.
"""

from __future__ import annotations

import bisect
import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .chunks import by_bytes, runs, utf8
from .words import groups, hashed, mix

#: Exponent of the weights; larger ones keep closer to the likeliest segmentation.
THETA = 1.0
SEED = 20250101
_CHUNK = 1 << 19
_MARK = "▁"
_SLOTS = np.uint64((1 << 20) - 1)
#: Words that are still unfinished go on one by one, not in rounds, once there are as few of them.
FEW = 12
_models: dict[tuple[str, float], Lattice] = {}


@dataclass
class Edges:
    """Lattice edges of distinct words, sorted by the byte place where they end."""

    ends: np.ndarray
    starts: np.ndarray
    pieces: np.ndarray
    first: np.ndarray  # first edge of each place
    upto: np.ndarray  # place * 2**32 + running share of its edges, of 2**32


def _forward(edges: tuple[list[int], list[float]], first: list[int], origin: int, begin: int, total: list[float], scale: list[int]) -> list[int]:
    """The rounds of ``Lattice.edges`` for one word from place ``begin`` on: the shares of its edges from there.

    ``edges`` (starts and weights) and ``first`` begin there, ``total`` and ``scale`` at the word's ``origin``;
    those two grow. The same operations in the same order give the same numbers.
    """
    starts, weights = edges
    share: list[int] = []
    for place in range(len(first) - 1):
        lo, hi = first[place] - first[0], first[place + 1] - first[0]
        terms, top = [], None
        for k in range(lo, hi):
            at = starts[k] - origin
            value, power = (weights[k], 0) if at == 0 else (weights[k] * total[at], scale[at])
            if value > 0 and (top is None or power > top):
                top = power
            terms.append((value, power))
        ways, running = 0.0, []
        for value, power in terms:
            if value > 0:
                ways += math.ldexp(value, max(power - top, -2000))
            running.append(ways)
        share += [math.floor(x / ways * 2.0**32) if ways > 0 else 0 for x in running]
        if hi > lo:
            share[-1] = 1 << 32
        fraction, exponent = math.frexp(ways)
        total.append(fraction)
        scale.append(exponent + top if ways > 0 else 0)
    return share


class Lattice:
    def __init__(self, path: str, theta: float = THETA):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        self.bytes_of: list[bytes] = []
        texts, ids = [], []
        byte_ids = np.zeros(256, np.int64)
        for i in range(n):
            if sp.is_byte(i):
                b = int(sp.id_to_piece(i)[3:5], 16)
                byte_ids[b] = i
                self.bytes_of.append(bytes([b]))
            elif sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i):
                self.bytes_of.append(b"")
            else:
                t = sp.id_to_piece(i).replace(_MARK, " ").encode()
                self.bytes_of.append(t)
                texts.append(t)
                ids.append(i)
        if any(b" " in t.lstrip(b" ") for t in texts):
            raise ValueError("a piece reaches over a word's start")
        order = np.argsort([-sp.get_score(i) for i in ids], kind="stable")
        ranks = np.arange(len(ids) + 1) + 2.0
        weights = 1.0 / (ranks if theta == 1 else ranks**theta)
        weight = np.empty(len(ids))
        weight[order] = weights[:-1]
        self.byte_ids, self.byte_weight = byte_ids, float(weights[-1])
        self.most = max(map(len, texts))
        # a trie of the pieces: a node for each prefix, found from its parent's number and its last byte
        known = dict(zip(texts, zip(ids, weight)))
        prefixes = sorted({t[:k] for t in texts for k in range(1, len(t) + 1)})
        number = {t: i + 1 for i, t in enumerate(prefixes)} | {b"": 0}
        self.piece = np.array([-1] + [known.get(t, (-1, 0.0))[0] for t in prefixes])
        self.weight = np.array([0.0] + [known.get(t, (-1, 0.0))[1] for t in prefixes])
        keys = self.steps(np.array([number[t[:-1]] for t in prefixes]), np.array([t[-1] for t in prefixes]))
        by = np.argsort(keys)
        self.keys, self.child = keys[by], np.append(by + 1, 0)
        self._index()
        self.lengths = np.array([len(b) for b in self.bytes_of], np.int64)
        self.joined = np.frombuffer(b"".join(self.bytes_of), np.uint8)
        self.offsets = np.cumsum(self.lengths) - self.lengths

    def _index(self) -> None:
        """Two tables from bits of a key to its place: the second has those keys whose slot in the first was taken."""
        n = len(self.keys)
        self.keys = np.append(self.keys, np.uint64(0))  # place n is no key
        self.one = np.full(int(_SLOTS) + 1, n, np.int32)
        slot = (self.keys[:n] & _SLOTS).astype(np.int64)
        self.one[slot] = np.arange(n)
        rest = np.flatnonzero(self.one[slot] != np.arange(n))
        for odd in range(1, 20001, 2):
            self.odd = np.uint64(odd * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
            other = self._second(self.keys[rest])
            if len(np.unique(other)) == len(rest):
                break
        else:
            raise ValueError("no multiplier parts the keys")
        self.two = np.full(1 << 22, n, np.int32)
        self.two[other] = rest

    def _second(self, h: np.ndarray) -> np.ndarray:
        return ((h * self.odd) >> np.uint64(42)).astype(np.int64)

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of ``h`` are steps of the trie, and the places of those."""
        place = self.one[(h & _SLOTS).astype(np.int64)]
        ok = self.keys[place] == h
        miss = np.flatnonzero(~ok)
        again = self.two[self._second(h[miss])]
        hit = (self.keys[again] == h[miss]) & (again < len(self.keys) - 1)
        place[miss[hit]] = again[hit]
        ok[miss[hit]] = True
        ok &= place < len(self.keys) - 1
        return ok, place[ok]

    @staticmethod
    def steps(node: np.ndarray, byte: np.ndarray) -> np.ndarray:
        """A number of its own for each node and byte."""
        return mix((node.astype(np.uint64) << np.uint64(8)) | byte.astype(np.uint64))

    def edges(self, data: np.ndarray, start: np.ndarray, length: np.ndarray) -> tuple[Edges, np.ndarray]:
        """Edges of the words ``data[start:start + length]``, laid one after another, and each word's offset there."""
        base = np.cumsum(length) - length
        text = data[runs(start, length)]
        n = len(text)
        stop = np.repeat(base + length, length)
        live, node = np.arange(n), np.zeros(n, np.int64)
        found_s, found_e, found_p, found_w = [], [], [], []
        for k in range(self.most):
            inside = live + k < stop[live]
            live, node = live[inside], node[inside]
            if not len(live):
                break
            ok, place = self.find(self.steps(node, text[live + k]))
            live, node = live[ok], self.child[place]
            hit = self.piece[node] >= 0
            found_s.append(live[hit])
            found_e.append(live[hit] + k + 1)
            found_p.append(self.piece[node[hit]])
            found_w.append(self.weight[node[hit]])
        # characters without a piece of their own: an edge for each byte
        lead = (text & 0xC0) != 0x80
        lead[base[length > 0]] = True
        char = np.flatnonzero(lead)
        size = np.diff(np.append(char, n))
        own, size_at = np.zeros(n, bool), np.zeros(n, np.int64)
        size_at[char] = size
        for s, e in zip(found_s, found_e):
            own[s[e - s == size_at[s]]] = True
        bare = runs(char[~own[char]], size[~own[char]])
        s = np.concatenate([*found_s, bare])
        e = np.concatenate([*found_e, bare + 1])
        p = np.concatenate([*found_p, self.byte_ids[text[bare]]])
        w = np.concatenate([*found_w, np.full(len(bare), self.byte_weight)])
        by = np.argsort(e, kind="stable")
        s, e, p, w = s[by], e[by], p[by], w[by]
        # forward: places of all words at one distance from their word's start go together
        first = np.zeros(n + 2, np.int64)
        np.cumsum(np.bincount(e, minlength=n + 1), out=first[1:])
        origin = np.repeat(base, length)
        depth = np.arange(n) - origin + 1  # of place i + 1
        at_depth = np.argsort(depth, kind="stable")
        cuts = np.searchsorted(depth[at_depth], np.arange(1, int(depth.max(initial=0)) + 2))
        # ways to a place, as an end, are total * 2**scale
        total, scale = np.zeros(n + 1), np.zeros(n + 1, np.int64)
        share = np.zeros(len(e), np.int64)
        for d in range(1, len(cuts)):
            place = at_depth[cuts[d - 1] : cuts[d]] + 1
            if len(place) <= FEW:
                for at in place.tolist():  # the rest of each long word
                    o, end = int(origin[at - 1]), int(stop[at - 1]) + 1
                    lo, hi = first[at], first[end]
                    share[lo:hi] = _forward((s[lo:hi].tolist(), w[lo:hi].tolist()), first[at : end + 1].tolist(), o, at, total[o:at].tolist(), scale[o:at].tolist())
                break
            lo, hi = first[place], first[place + 1]
            some = hi > lo
            place, lo, size = place[some], lo[some], (hi - lo)[some]
            if not len(place):
                continue
            rank = np.arange(int(size.max()))[None, :]
            mine = np.where(rank < size[:, None], lo[:, None] + rank, -1)
            before = s[mine]
            begin = before == origin[before]
            value = w[mine] * np.where(begin, 1.0, total[before])
            power = np.where(begin, 0, scale[before])
            real = (mine >= 0) & (value > 0)
            top = np.where(real, power, -(1 << 40)).max(axis=1)
            # terms a thousand binary places below the largest scale weigh nothing
            value = np.where(real, np.ldexp(value, np.clip(power - top[:, None], -2000, 0).astype(np.int32)), 0.0)
            running = np.cumsum(value, axis=1)
            ways = running[:, -1]
            good = ways > 0
            part = np.zeros_like(running)
            part[good] = np.floor(running[good] / ways[good][:, None] * 2.0**32)
            flat = mine >= 0
            share[mine[flat]] = part[flat].astype(np.int64)
            fraction, exponent = np.frexp(ways)
            total[place], scale[place] = fraction, np.where(good, exponent + top, 0)
            share[lo + size - 1] = 1 << 32
        upto = (e.astype(np.uint64) << np.uint64(32)) + share.astype(np.uint64)
        return Edges(e, s, p, first, upto), base

    def sample(self, texts: list[bytes], keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pieces of all texts, one after another, and how many each has. ``keys``: 64-bit row keys."""
        lens = np.array([len(t) + 1 if t else 0 for t in texts], np.int64)
        data = np.frombuffer(b"".join(b" " + t for t in texts if t), np.uint8)
        n = len(data)
        if not n:
            return np.empty(0, np.int64), np.zeros(len(texts), np.int64)
        space = data == 0x20
        begin = space.copy()
        begin[1:] &= ~space[:-1]
        heads = (np.cumsum(lens) - lens)[lens > 0]
        begin[heads] = True
        start = np.flatnonzero(begin)
        length = np.diff(np.append(start, n))
        which, pick = groups(data, start, start + length, hashed(data, start, start + length))
        edges, base = self.edges(data, start[pick], length[pick])
        # backward: one piece for every unfinished word in each round
        shift = start - base[which]  # place in the chunk = place among distinct words + shift
        place = base[which] + length
        floor = base[which]
        owner = np.searchsorted(np.cumsum(lens), start, side="right")
        salt = mix(keys ^ np.uint64(SEED))
        text_at = np.cumsum(lens) - lens
        out = np.full(n + 1, -1, np.int32)
        live = np.arange(len(start))
        while len(live) > FEW:
            here = place[live]
            counter = (here + shift[live] - text_at[owner[live]]).astype(np.uint64)
            u = mix(salt[owner[live]] + counter * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)
            e = np.searchsorted(edges.upto, (here.astype(np.uint64) << np.uint64(32)) + u, side="right")
            out[here + shift[live]] = edges.pieces[e]
            place[live] = edges.starts[e]
            live = live[place[live] > floor[live]]
        for i in live.tolist():  # the rest of each long word
            at, low, by = int(place[i]), int(floor[i]), int(shift[i])
            counted, seed = by - int(text_at[owner[i]]), salt[owner[i]]
            draws = (mix(seed + (np.arange(low, at + 1) + counted).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)).tolist()
            e0 = int(edges.first[low])
            upto, begins = edges.upto[e0 : edges.first[at + 1]].tolist(), edges.starts[e0 : edges.first[at + 1]].tolist()
            while at > low:
                e = bisect.bisect_right(upto, (at << 32) + draws[at - low])
                out[at + by] = edges.pieces[e0 + e]
                at = begins[e]
        used = np.flatnonzero(out >= 0)
        ends = np.cumsum(lens)
        counts = np.searchsorted(used, ends, side="right") - np.searchsorted(used, ends - lens, side="right")
        return out[used].astype(np.int64), counts

    def decode(self, pieces: np.ndarray, counts: np.ndarray) -> list[bytes]:
        """The texts that ``sample`` took apart."""
        size = self.lengths[pieces]
        data = self.joined[runs(self.offsets[pieces], size)].tobytes()
        at = np.concatenate([[0], np.cumsum(size)])[np.concatenate([[0], np.cumsum(counts)])].tolist()
        return [data[lo + 1 : hi] for lo, hi in zip(at[:-1], at[1:])]


def lattice(path: str, theta: float = THETA) -> Lattice:
    if (path, theta) not in _models:
        _models[path, theta] = Lattice(path, theta)
    return _models[path, theta]


def row_keys(column: pa.Array) -> np.ndarray:
    """A 64-bit key of each doc_id; null has one of its own."""
    return mix(np.array([0x5EED if i is None else i & (1 << 64) - 1 for i in column.to_pylist()], np.uint64))


def encode_pieces(docs: DataFrame, model: str, keep: list[str] | None = None, theta: float = THETA) -> DataFrame:
    """``docs``' columns named in ``keep`` (doc_id if none) and pieces, the ids of one sampled segmentation.

    Draws depend on doc_id and the text alone, so equal rows get equal pieces, and copies under other ids
    others. Null text gives null pieces, empty text none. Whole texts are cut, whatever their length; a
    null doc_id is a key like any. An empty table gives no rows.
    """
    keep = keep or ["doc_id"]
    inner = docs.select(*[F.col(c).alias(f"c{i}") for i, c in enumerate(keep)], F.col("doc_id").cast("long").alias("k"), F.col("text").alias("x"))
    schema = T.StructType([*inner.drop("k", "x").schema.fields, T.StructField("p", T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut = lattice(model, theta)
        for batch in batches:
            texts, keys = utf8(batch.column("x")), row_keys(batch.column("k"))
            for lo, hi in by_bytes(texts, _CHUNK):
                ids, counts = cut.sample([t or b"" for t in texts[lo:hi]], keys[lo:hi])
                ends = np.concatenate([[0], np.cumsum(counts)])
                null = np.array([t is None for t in texts[lo:hi]] + [False])
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32(), mask=null), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([*[c.slice(lo, hi - lo) for c in batch.columns[:-2]], lists], names=[*batch.schema.names[:-2], "p"])

    out = inner.mapInArrow(run, schema)
    return out.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(keep)], F.col("p").alias("pieces"))


def decode_pieces(rows: DataFrame, model: str, keep: list[str] | None = None, theta: float = THETA) -> DataFrame:
    """``rows``' columns named in ``keep`` (doc_id if none) and decoded, the text that ``pieces`` spell."""
    keep = keep or ["doc_id"]
    inner = rows.select(*[F.col(c).alias(f"c{i}") for i, c in enumerate(keep)], F.col("pieces").alias("x"))
    schema = T.StructType([*inner.drop("x").schema.fields, T.StructField("t", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut = lattice(model, theta)
        for batch in batches:
            lists = batch.column("x")
            counts = np.asarray(lists.value_lengths().fill_null(0), np.int64)
            texts = cut.decode(np.asarray(lists.flatten(), np.int64), counts)
            made = pa.array([None if null else t for t, null in zip(texts, lists.is_null().to_pylist())], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], made], names=[*batch.schema.names[:-1], "t"])

    out = inner.mapInArrow(run, schema)
    return out.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(keep)], F.col("t").cast("string").alias("decoded"))


def _round_trip(model: str, theta: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut = lattice(model, theta)
        for batch in batches:
            texts, keys = utf8(batch.column("text")), row_keys(batch.column("doc_id"))
            for lo, hi in by_bytes(texts, _CHUNK):
                ids, counts = cut.sample([t or b"" for t in texts[lo:hi]], keys[lo:hi])
                back = cut.decode(ids, counts)
                ends, raw = np.cumsum(counts), ids.astype("<u4")
                crc = [zlib.crc32(raw[e - n : e].tobytes()) for e, n in zip(ends.tolist(), counts.tolist())]
                cols = [pa.array(counts, pa.int64()), pa.array(crc, pa.int64()), pa.array([zlib.crc32(b) for b in back], pa.int64()), pa.array([b == (t or b"") for b, t in zip(back, texts[lo:hi])])]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, hi - lo).cast(pa.int64()), *cols], names=["doc_id", "n_pieces", "pieces_crc32", "decoded_crc32", "lossless"])

    return run


def round_trip(docs: DataFrame, model: str, theta: float = THETA) -> DataFrame:
    """doc_id, n_pieces, pieces_crc32 (of the ids as little-endian 32-bit numbers), decoded_crc32 and lossless.

    Encodes as ``encode_pieces`` does, decodes as ``decode_pieces`` does, and keeps digests only, in one
    pass. lossless compares the decoded bytes with the text's. Null text counts as empty (no pieces, both
    checksums 0, lossless); a null doc_id is a key like any; repeated rows give equal rows, copies under
    other ids other pieces; other columns are ignored; an empty table gives no rows.
    """
    return docs.select("doc_id", "text").mapInArrow(_round_trip(model, theta), "doc_id long, n_pieces long, pieces_crc32 long, decoded_crc32 long, lossless boolean")


def op8_sentencepiece(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return round_trip(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("piece_bpe_32k.model"))
