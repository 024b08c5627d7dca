"""Exact matches across documents: packs of whole texts that trade anchors and units by key.

Texts are packed, once, into rows of about ``PACK_BYTES``, a written table. Keys are dealt to parts, each of
which stands for a fixed share of the text and is one task. Then

1. each pack sends its distinct anchors to the parts of their keys, which tell the packs of shared ones so;
2. each pack sends its distinct units, stretches around shared anchors, to the parts of their keys, which
   compare them exactly and tell the packs which windows start in a document with a smaller id;
3. each pack applies those answers to its texts.

What a pack has for a part is one row, so there are never more rows than anchors or units, however many
packs and parts there are; and rows of any size are read as flat arrays, so small ones cost no more for each
entry than large ones. Equal content of one pack travels once: a passage that every document has costs its
part one entry for each pack, some 10 bytes in step 1 and the unit in step 2.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .chunks import runs, utf8
from .scratch import materialize, shuffle_partitions

PACK_BYTES = 2 << 20
PACK_ROWS = 20_000
#: Text bytes behind one part, about.
SHARE_BYTES = 16 << 20
#: Bytes of units that are compared at a time; units of one key stay together.
COMPARE_BYTES = 4 << 20
#: Occurrences from which an anchor is common; its windows then go to buckets one by one.
COMMON = 1000
#: Documents without an id count as having this one, the largest.
NO_ID = np.iinfo(np.int64).max
_PACK = "pack long, size long, ids binary, lens binary, text binary, extra binary"
_ANCHORS = "part int, pack long, keys binary, times binary"
_SHARED = "pack long, part int, shared binary, common binary"
_UNITS = "part int, pack long, docs binary, sizes binary, subs binary, body binary"
_FOUND = "pack long, part int, bits binary"


def _squeezed(data: bytes | np.ndarray) -> bytes:
    return pa.compress(data, "zstd", asbytes=True)


def _restored(data: bytes, size: int) -> bytes:
    return pa.decompress(data, size, "zstd", asbytes=True) if size else b""


def _packer(key: str, text: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        base = TaskContext.get().partitionId() << 32
        held: list[pa.RecordBatch] = []
        size = rows = n = 0

        def pack() -> pa.RecordBatch:
            table = pa.Table.from_batches(held).combine_chunks()
            texts = [t or b"" for t in utf8(table.column(text))]
            ids = np.array([NO_ID if i is None else i for i in table.column(key).to_pylist()], np.int64)
            sink = pa.BufferOutputStream()
            rest = table.drop_columns([text]).append_column("void", table.column(text).is_null())
            with pa.ipc.new_stream(sink, rest.schema) as w:
                w.write_table(rest)
            cols = [ids.tobytes(), np.array([len(t) for t in texts], np.int64).tobytes(), _squeezed(b"".join(texts)), sink.getvalue().to_pybytes()]
            return pa.RecordBatch.from_arrays([pa.array([base + n], pa.int64()), pa.array([size], pa.int64()), *[pa.array([c], pa.binary()) for c in cols]], names=["pack", "size", "ids", "lens", "text", "extra"])

        for batch in batches:
            sizes = np.asarray(pa.compute.binary_length(batch.column(text)).fill_null(0), np.int64)
            start = 0
            for i, s in enumerate(sizes.tolist()):
                if rows and (size + s > PACK_BYTES or rows >= PACK_ROWS):
                    held.append(batch.slice(start, i - start))
                    yield pack()
                    n, held, size, rows, start = n + 1, [], 0, 0, i
                size += s
                rows += 1
            held.append(batch.slice(start))
        if rows:
            yield pack()

    return run


class Pack:
    """A row of the pack table, opened."""

    def __init__(self, ids: bytes, lens: bytes, text: bytes):
        self.ids, self.lens = np.frombuffer(ids, np.int64), np.frombuffer(lens, np.int64)
        self.ends = np.cumsum(self.lens)
        self.text = _restored(text, int(self.lens.sum()))

    def texts(self) -> list[bytes]:
        return [self.text[e - n : e] for e, n in zip(self.ends.tolist(), self.lens.tolist())]


def _binaries(data: np.ndarray, lengths: np.ndarray) -> pa.Array:
    """Consecutive pieces of ``data`` as an array of binaries."""
    offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(lengths), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])


def _joined(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """All binaries of a column as one array of bytes, and the length of each."""
    lengths = np.asarray(pa.compute.binary_length(column).fill_null(0).combine_chunks(), np.int64)
    return np.frombuffer(b"".join(x for x in column.to_pylist() if x), np.uint8), lengths


def _packed(bits: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """Consecutive runs of ``bits`` as binaries; a run that has none set is null."""
    wide = -(-sizes // 8)
    at = np.cumsum(wide) - wide
    spread = np.zeros(int(wide.sum()) * 8, np.uint8)
    spread[runs(at * 8, sizes)] = bits
    data = np.packbits(spread)
    some = np.add.reduceat(data, at, dtype=np.int64) > 0 if len(at) else np.zeros(0, bool)
    full = _binaries(data, wide)
    return pa.compute.if_else(pa.array(some), full, pa.nulls(len(full), pa.binary()))


def _unpacked(column: pa.ChunkedArray, sizes: np.ndarray) -> np.ndarray:
    """The runs of bits that ``_packed`` has made, null ones as zeros."""
    data, lengths = _joined(column)
    out = np.zeros(int(sizes.sum()), bool)
    have = lengths > 0
    raw = np.unpackbits(data)
    first = np.cumsum(sizes) - sizes
    out[runs(first[have], sizes[have])] = raw[runs((np.cumsum(lengths) - lengths)[have] * 8, sizes[have])]
    return out


def _dealt(keys: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order of ``keys`` by part; the parts there are, and how many keys each has."""
    part = (keys % np.uint64(parts)).astype(np.int32)
    order = np.argsort(part, kind="stable")
    there, n = np.unique(part, return_counts=True)
    return order, there, n


def _distinct(keys: np.ndarray, parts: int):
    """Distinct keys in sending order, each key's place in it, the parts and how many keys each has."""
    uniq, inverse = np.unique(keys, return_inverse=True)
    order, there, n = _dealt(uniq, parts)
    place = np.empty(len(uniq), np.int64)
    place[order] = np.arange(len(uniq))
    return uniq[order], place[inverse], there, n


class Method:
    """What an operator adds: anchors, units and their comparison. Each must be a function of the pack alone."""

    def anchors(self, pack: Pack):
        """State, then a fingerprint and a document id for each anchor."""
        raise NotImplementedError

    def units(self, pack: Pack, state, shared: np.ndarray, common: np.ndarray):
        """From marks for each anchor: state, then of the units to send their keys, document ids, numbers of windows (under 256), bodies in one array and the ends of each in it."""
        raise NotImplementedError

    def lengths(self, sizes: np.ndarray) -> np.ndarray:
        """Bytes of the bodies of units with so many windows."""
        raise NotImplementedError

    def compare(self, docs: np.ndarray, sizes: np.ndarray, body: np.ndarray) -> np.ndarray:
        """For each window of the units, one after another, whole keys together: does a smaller document have it?"""
        raise NotImplementedError

    def finish(self, pack: Pack, state, bits: np.ndarray | None) -> list[pa.Array]:
        """Result columns for the pack's documents."""
        raise NotImplementedError


def _send(method: Method, parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for pid, ids, lens, text in zip(*(batch.column(c).to_pylist() for c in ("pack", "ids", "lens", "text"))):
                _, keys, docs = method.anchors(Pack(ids, lens, text))
                uniq, place, there, n = _distinct(keys, parts)
                times = np.bincount(place, minlength=len(uniq))
                low, high = np.full(len(uniq), NO_ID), np.full(len(uniq), np.iinfo(np.int64).min)
                np.minimum.at(low, place, docs)
                np.maximum.at(high, place, docs)
                times = np.where(low == high, 1, np.clip(times, 2, 255)).astype(np.uint8)  # one document counts once
                # five bytes of what the part does not tell; a clash costs work, never results
                short = (uniq // np.uint64(parts)).view(np.uint8).reshape(-1, 8)[:, :5]
                yield pa.RecordBatch.from_arrays([pa.array(there), pa.array(np.full(len(there), pid)), _binaries(short, n * 5), _binaries(times, n)], names=["part", "pack", "keys", "times"])

    return run


def _gathered(batches: Iterator[pa.RecordBatch]) -> pa.Table | None:
    held = [b for b in batches if len(b)]
    return pa.Table.from_batches(held) if held else None


def _flat(table: pa.Table, name: str) -> np.ndarray:
    return np.asarray(table.column(name).combine_chunks())


def _vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    table = _gathered(batches)
    if table is None:
        return
    times, sizes = _joined(table.column("times"))
    wide = np.zeros((len(times), 8), np.uint8)
    wide[:, :5] = _joined(table.column("keys"))[0].reshape(-1, 5)
    keys = wide.view(np.uint64)[:, 0] ^ (np.repeat(_flat(table, "part").astype(np.uint64), sizes) << np.uint64(40))
    _, group = np.unique(keys, return_inverse=True)
    total = np.bincount(group, weights=times)
    out = pa.table({"pack": table.column("pack"), "part": table.column("part"), "shared": _packed((total >= 2)[group], sizes), "common": _packed((total >= COMMON)[group], sizes)})
    yield from out.filter(pa.compute.is_valid(out.column("shared"))).combine_chunks().to_batches()


def _units_of(method: Method, parts: int, pack: Pack, votes: pa.Table):
    """The units of a pack whose anchors the parts say to be shared."""
    state, keys, _ = method.anchors(pack)
    uniq, place, there, n = _distinct(keys, parts)
    first = np.cumsum(n) - n
    at = np.searchsorted(there, _flat(votes, "part"))
    marks = np.zeros((2, len(uniq)), bool)
    for row, name in enumerate(("shared", "common")):
        marks[row, runs(first[at], n[at])] = _unpacked(votes.column(name), n[at])
    return method.units(pack, state, *marks[:, place])


def _open(left: pa.Table) -> tuple[int, Pack]:
    row = left.slice(0, 1)
    return row.column("pack")[0].as_py(), Pack(*(row.column(c)[0].as_py() for c in ("ids", "lens", "text")))


def _ship(method: Method, parts: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        pid, pack = _open(left)
        _, keys, docs, sizes, body, ends = _units_of(method, parts, pack, right)
        order, there, n = _dealt(keys, parts)
        lengths = np.diff(ends, prepend=0)[order]
        body = body[runs(ends[order] - lengths, lengths)]
        cuts = np.concatenate([[0], np.cumsum(np.add.reduceat(lengths, np.cumsum(n) - n))]) if len(n) else np.zeros(1, np.int64)
        bodies = [_squeezed(body[lo:hi]) for lo, hi in zip(cuts[:-1], cuts[1:])]
        # numbers for units of one key to be compared together
        subs = (keys[order] // np.uint64(parts)).astype(np.uint16)
        return pa.table(
            {
                "part": pa.array(there),
                "pack": pa.array(np.full(len(there), pid)),
                "docs": _binaries(docs[order], n * 8),
                "sizes": _binaries(sizes[order].astype(np.uint8), n),
                "subs": _binaries(subs, n * 2),
                "body": pa.array(bodies, pa.binary()),
            }
        )

    return run


def _compare(method: Method):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _gathered(batches)
        if table is None:
            return
        sizes, counts = _joined(table.column("sizes"))
        sizes = sizes.astype(np.int64)
        docs, subs = _joined(table.column("docs"))[0].view(np.int64), _joined(table.column("subs"))[0].view(np.uint16)
        lengths = method.lengths(sizes)
        raw = np.add.reduceat(lengths, np.cumsum(counts) - counts).tolist()
        body = np.frombuffer(b"".join(_restored(x, n) for x, n in zip(table.column("body").to_pylist(), raw)), np.uint8)
        start, first = np.cumsum(lengths) - lengths, np.cumsum(sizes) - sizes
        order = np.argsort(subs, kind="stable")
        # ranges of whole subs of about COMPARE_BYTES
        last = np.flatnonzero(np.concatenate([np.diff(subs[order]) != 0, [True]])) + 1
        share = np.cumsum(lengths[order])[last - 1] // COMPARE_BYTES
        stops = last[np.concatenate([np.diff(share) != 0, [True]])]
        bits = np.zeros(int(sizes.sum()), bool)
        for lo, hi in zip([0, *stops[:-1].tolist()], stops.tolist()):
            own = order[lo:hi]
            bits[runs(first[own], sizes[own])] = method.compare(docs[own], sizes[own], body[runs(start[own], lengths[own])])
        windows = np.add.reduceat(sizes, np.cumsum(counts) - counts)
        out = pa.table({"pack": table.column("pack"), "part": table.column("part"), "bits": _packed(bits, windows)})
        yield from out.filter(pa.compute.is_valid(out.column("bits"))).combine_chunks().to_batches()

    return run


def _finish(method: Method, parts: int, names: list[str], order_out: list[str]):
    """``order_out`` names the columns to give: of the pack's other columns, ``t`` for the text itself, and ``names``."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        _, pack = _open(left)
        found = _flat(right, "step") == 2
        answers = right.filter(pa.array(found))
        state, keys, _, sizes, _, _ = _units_of(method, parts, pack, right.filter(pa.array(~found)))
        order, there, n = _dealt(keys, parts)
        first = np.cumsum(sizes) - sizes
        bits = np.zeros(int(sizes.sum()), bool)
        if len(answers):
            at = np.searchsorted(there, _flat(answers, "part"))
            mine = order[runs((np.cumsum(n) - n)[at], n[at])]  # units that got an answer, row by row
            windows = np.add.reduceat(sizes[mine], np.cumsum(n[at]) - n[at])
            bits[runs(first[mine], sizes[mine])] = _unpacked(answers.column("bits"), windows)
        made = method.finish(pack, state, bits)
        extra = pa.ipc.open_stream(left.column("extra")[0].as_py()).read_all()
        have = dict(zip(names, made)) | {n: c.combine_chunks() for n, c in zip(extra.column_names, extra.columns)}
        if "t" in order_out:
            have["t"] = pa.array([None if void else t for void, t in zip(have["void"].to_pylist(), pack.texts())], pa.binary()).cast(pa.string())
        return pa.Table.from_arrays([have[n] for n in order_out], names=order_out)

    return run


def exchange(docs: DataFrame, method: Method, keep: list[str], made: list[tuple[str, str]]) -> DataFrame:
    """Run ``method`` over ``docs`` (doc_id, text): columns ``keep``, then what ``method.finish`` makes."""
    spark = docs.sparkSession
    # a kept text column is not packed twice: it is the pack's own text
    columns = {c: "t" if c == "text" else f"c{i}" for i, c in enumerate(keep)}
    inner = docs.select(F.col("doc_id").cast("long").alias("k"), *[F.col(c).alias(a) for c, a in columns.items() if a != "t"], F.col("text").cast("string").alias("t"))
    packs = materialize(inner.mapInArrow(_packer("k", "t"), _PACK), "packs")
    total = packs.agg(F.sum("size")).first()[0] or 0
    parts = max(shuffle_partitions(spark), -(-total // SHARE_BYTES))
    bodies = packs.select("pack", "ids", "lens", "text")
    anchors = bodies.mapInArrow(_send(method, parts), _ANCHORS)
    shared = materialize(anchors.repartitionById(parts, "part").mapInArrow(_vote, _SHARED), "shared")
    units = bodies.groupBy("pack").cogroup(shared.groupBy("pack")).applyInArrow(_ship(method, parts), _UNITS)
    found = materialize(units.repartitionById(parts, "part").mapInArrow(_compare(method), _FOUND), "found")
    names = [f"m{i}" for i in range(len(made))]
    order_out = [*columns.values(), *names]
    schema = T.StructType([*[inner.schema[a] for a in columns.values()], *[T.StructField(n, T._parse_datatype_string(t)) for n, (_, t) in zip(names, made)]])
    none = F.lit(None).cast("binary")
    answers = shared.select("pack", F.lit(1).alias("step"), "part", "shared", "common", none.alias("bits")).unionByName(found.select("pack", F.lit(2).alias("step"), "part", none.alias("shared"), none.alias("common"), "bits"))
    out = packs.drop("size").groupBy("pack").cogroup(answers.groupBy("pack")).applyInArrow(_finish(method, parts, names, order_out), schema)
    return out.select(*[F.col(a).alias(c) for c, a in columns.items()], *[F.col(n).alias(c) for n, (c, _) in zip(names, made)])
