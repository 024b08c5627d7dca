"""Benchmark decontamination by greedy string tiling.

Documents and benchmark items are joined on shared seeds (a few words in a row), and each matched pair is
tiled: the longest common runs of words not yet marked are found with running Karp-Rabin hashes, marked in
both, and so on with shorter runs down to the seed's length. The tiles' share of the item is its coverage,
which does not depend on the order in which the document has the item's passages.

A sieve, a bitmap of fixed size that holds the seeds' hashes, goes to every task, so that of the documents
only those seeds travel that the benchmark may have, and only the words under them. Seeds that many
documents share are left out of an item's join as long as all of them together cover less of the item than
what is reported, so that a stock phrase pairs nothing. Hashes only guide; the words' bytes decide.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunks import by_bytes, utf8
from .scratch import drop_scratch, materialize
from .words import LETTERED, Words, grams, lowered, mix, whole, words_of

#: Words of the shortest tile, and of a seed.
LEAST = 5
#: Share of an item's words under tiles from which a document counts as contaminated.
COVERAGE = 0.6
#: Bits of the sieve: at most 16 MB to the driver and to each task, however large the benchmark.
SIEVE_BITS = 27
_BLOCK = 4096
_CHUNK = 1 << 20
#: Bytes of a found document's row in memory, at most.
_FOUND_BYTES = 128
_MULTIPLIER = 0x9E3779B97F4A7C15
_INVERSE = pow(_MULTIPLIER, -1, 1 << 64)


class _Windows:
    """Karp-Rabin hashes of all windows of a word sequence: differences of running sums, modulo 2**64."""

    def __init__(self, ids: np.ndarray):
        n = len(ids)
        powers = lambda x: np.cumprod(np.array([1, *[x] * n], np.uint64))
        terms = mix(ids.astype(np.uint64) + np.uint64(1)) * powers(_MULTIPLIER)[:n]
        self.ids, self.sums, self.back = ids, np.concatenate([np.zeros(1, np.uint64), np.cumsum(terms)]), powers(_INVERSE)
        self.free = ids >= 0

    def of(self, s: int) -> tuple[np.ndarray, np.ndarray]:
        """Places of the unmarked windows of ``s`` words, and their hashes."""
        marked = np.concatenate([[0], np.cumsum(~self.free)])
        at = np.flatnonzero(marked[s:] == marked[: len(marked) - s]) if s < len(marked) else np.empty(0, np.int64)
        return at, (self.sums[at + s] - self.sums[at]) * self.back[at]


def _marked_at(a: _Windows, b: _Windows, s: int) -> list[tuple[int, int]]:
    """Marks common runs of ``s`` words, the longest there are, in the order of their places: (in a, in b)."""
    (at, ha), (bt, hb) = a.of(s), b.of(s)
    both = np.intersect1d(ha, hb)
    at, ha = at[np.isin(ha, both)], ha[np.isin(ha, both)]
    bt, hb = bt[np.isin(hb, both)], hb[np.isin(hb, both)]
    order = np.argsort(hb, kind="stable")
    lo, hi = (np.searchsorted(hb[order], ha, side).tolist() for side in ("left", "right"))
    places = bt[order].tolist()
    used: dict[int, int] = {}  # of the places with one hash, how many are marked for sure
    out, end = [], 0
    for i, first, last in zip(at.tolist(), lo, hi):
        if i < end:
            continue
        # windows were free before this round, and all marks since are as long, so the ends tell
        k = used.get(first, first)
        while k < last and not (b.free[places[k]] and b.free[places[k] + s - 1]):
            k += 1
        used[first] = k
        while k < last:
            j = places[k]
            if b.free[j] and b.free[j + s - 1] and np.array_equal(a.ids[i : i + s], b.ids[j : j + s]):
                a.free[i : i + s] = b.free[j : j + s] = False
                out.append((i, j))
                end = i + s
                break
            k += 1  # marked meanwhile, or another run with the same hash
    return out


def tiles(item: np.ndarray, other: np.ndarray, least: int = LEAST) -> list[tuple[int, int, int]]:
    """Greedy tiles (length, place in item, place in other), longest first, then by place in both.

    Words are numbers; negative ones match nothing. The longest common run is found by halving, as a run of
    s words holds runs of s - 1. A round marks all runs of that length, so there are as many rounds as
    different lengths, at most the root of twice the item's words, each in time near its words'.
    """
    a, b = _Windows(np.asarray(item, np.int64)), _Windows(np.asarray(other, np.int64))
    common = lambda s: bool(np.isin(a.of(s)[1], b.of(s)[1]).any())
    out, high = [], min(len(item), len(other))
    while high >= least:
        if not common(high):
            low = least - 1
            while high - low > 1:  # common at low (or it is too short), not at high
                mid = (low + high) // 2
                low, high = (mid, high) if common(mid) else (low, mid)
            high = low
            if high < least:
                break
        out += [(high, i, j) for i, j in _marked_at(a, b, high)]
        high -= 1
    return out


def _seeds(texts: list[bytes | None], least: int) -> tuple[Words, np.ndarray, np.ndarray]:
    """Of all texts together: their words, and the seeds' fingerprints and places."""
    w = words_of([lowered(t) for t in texts], LETTERED)
    at = np.flatnonzero(whole(w.counts, least))
    return w, grams(w.hashes, least)[at], at


def _bytes_of(w: Words, first: int, last: int) -> bytes:
    """Words ``first`` to ``last`` (exclusive), parted by white space."""
    part = w.data[w.starts[first] : w.ends[last - 1]]
    return np.where(LETTERED[part], part, np.uint8(32)).tobytes()


def _slots(seeds: np.ndarray) -> np.ndarray:
    return (seeds >> np.uint64(64 - SIEVE_BITS)).astype(np.int64)


def _of_items(least: int):
    """For each item with as many words its words, and the seed at each of its places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            w, seeds, at = _seeds(utf8(batch.column("t")), least)
            ends = np.cumsum(w.counts)
            which = np.searchsorted(ends, at, side="right")
            rows = [(i, _bytes_of(w, ends[i] - w.counts[i], ends[i]), seeds[slice(*np.searchsorted(which, (i, i + 1)))].view(np.int64).tolist()) for i in np.unique(which).tolist()]
            at, words, own = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column("i").take(pa.array(at, pa.int32())), pa.array(words, pa.binary()), pa.array(own, pa.list_(pa.int64()))], names=["item", "words", "seeds"])

    return run


def common_seeds(seeds: list[int], counts: dict[int, int], report: float, least: int = LEAST) -> set[int]:
    """Seeds of an item, those of most documents first, that cover less than ``report`` of it all together.

    What a document shares with the item by them alone is less too, so they need not bring the two together.
    """
    places: dict[int, list[int]] = {}
    for p, seed in enumerate(seeds):
        places.setdefault(seed, []).append(p)
    n = len(seeds) + least - 1
    covered, total, out = bytearray(n), 0, set()
    for seed in sorted(counts, key=lambda x: (-counts[x], x)):
        new = {q for p in places[seed] for q in range(p, p + least) if not covered[q]}
        if (total + len(new)) / n < report:
            total += len(new)
            out.add(seed)
            for q in new:
                covered[q] = 1
    return out


def _sown(report: float, least: int):
    """The seeds by which each item is joined."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n, seeds, counts in zip(*(batch.column(c).to_pylist() for c in ("n", "seeds", "counts"))):
                counts = {x["seed"]: x["docs"] for x in counts}
                own = sorted(set(counts) - common_seeds(seeds, counts, report, least))
                yield pa.RecordBatch.from_arrays([pa.array([n] * len(own), pa.int64()), pa.array(own, pa.int64())], names=["n", "seed"])

    return run


def _marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The blocks of the sieve that this partition's seeds mark."""
    sieve = np.zeros(((1 << SIEVE_BITS - 3) // _BLOCK, _BLOCK), np.uint8)
    for batch in batches:
        slot = _slots(np.asarray(batch.column("seed"), np.int64).view(np.uint64))
        np.bitwise_or.at(sieve.reshape(-1), slot >> 3, (1 << (slot & 7)).astype(np.uint8))
    at = np.flatnonzero(sieve.any(axis=1))
    yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array([sieve[i].tobytes() for i in at], pa.binary())], names=["block", "bits"])


def _merged(table: pa.Table) -> pa.Table:
    bits = np.bitwise_or.reduce([np.frombuffer(x, np.uint8) for x in table.column("bits").to_pylist()])
    return pa.table({"block": table.column("block").slice(0, 1), "bits": pa.array([bits.tobytes()], pa.binary())})


def _sifted(sieve, least: int):
    """Of each document: the words that the sieve's seeds cover, a run in a line, and those seeds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = sieve.value
        for batch in batches:
            texts = utf8(batch.column("x"))
            for lo, hi in by_bytes(texts, _CHUNK):
                w, seeds, at = _seeds(texts[lo:hi], least)
                slot = _slots(seeds)
                hit = np.flatnonzero(bits[slot >> 3] >> (slot & 7).astype(np.uint8) & 1)
                if not len(hit):
                    continue
                seeds, at = seeds[hit], at[hit]
                text = np.searchsorted(np.cumsum(w.counts), at, side="right")
                rows = []
                for t in np.unique(text).tolist():
                    own = slice(*np.searchsorted(text, (t, t + 1)))
                    place = at[own]
                    # a tile lies in words that seeds cover, so only those runs travel
                    new = np.flatnonzero(np.concatenate([[True], np.diff(place) > least]))
                    first, last = place[new], np.append(place[new[1:] - 1], place[-1]) + least
                    rows.append((lo + t, b"\n".join(_bytes_of(w, i, j) for i, j in zip(first, last)), np.unique(seeds[own]).view(np.int64).tolist()))
                row, words, own = zip(*rows)
                key = [batch.column(c).take(pa.array(row)) for c in ("k1", "k2")]
                yield pa.RecordBatch.from_arrays([*key, pa.array(words, pa.binary()), pa.array(own, pa.list_(pa.int64()))], names=["k1", "k2", "words", "seeds"])

    return run


def coverage(item: bytes, words: bytes, least: int = LEAST) -> tuple[float, int]:
    """The share of an item's words under tiles with a document's runs of words, and the number of tiles.

    Words are parted by white space, runs by newlines.
    """
    ids: dict[bytes, int] = {}
    own = np.array([ids.setdefault(x, len(ids)) for x in item.split()], np.int64)
    other = np.array([ids.get(x, -1) for line in words.split(b"\n") for x in (*line.split(), b"")], np.int64)
    # of the document only runs of the item's words that are long enough for a tile
    edges = np.flatnonzero(np.diff(np.concatenate([[False], other >= 0, [False]]).view(np.int8)))
    parts = [other[i : j + 1] for i, j in zip(edges[0::2].tolist(), edges[1::2].tolist()) if j - i >= least]
    found = tiles(own, np.concatenate(parts), least) if parts else []
    return sum(x[0] for x in found) / len(own), len(found)


def _tiled(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [coverage(*row, least) for row in zip(*(batch.column(c).to_pylist() for c in ("item_words", "words")))]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("k1", "k2", "item")), pa.array([c for c, _ in made], pa.float64()), pa.array([n for _, n in made], pa.int32())], names=["k1", "k2", "item", "coverage", "tiles"])

    return run


def pairs_of(sifted: DataFrame, items: DataFrame, report: float) -> DataFrame:
    """k1, k2 and n of the documents and items that may share ``report`` of an item."""
    docs = sifted.select("k1", "k2", F.explode("seeds").alias("seed"))
    counts = docs.groupBy("seed").agg(F.count(F.lit(1)).alias("docs"))
    known = items.select("n", F.explode(F.array_distinct("seeds")).alias("seed")).join(counts.hint("merge"), "seed").groupBy("n").agg(F.collect_list(F.struct("seed", "docs")).alias("counts"))
    sown = items.select("n", "seeds").join(known, "n").mapInArrow(_sown(report, LEAST), "n long, seed long")
    return docs.join(sown.hint("merge"), "seed").select("k1", "k2", "n").distinct()


def decontaminate(docs: DataFrame, benchmark: DataFrame, keep: list[str] | None = None, threshold: float = COVERAGE, report: float | None = None) -> DataFrame:
    """``docs``' columns named in ``keep`` (doc_id if none) with contaminated, best_item, coverage, n_items and n_tiles.

    best_item is the item of the highest coverage (ties: the smaller id), n_items how many items reach
    ``threshold``. Coverages below ``report`` (``threshold`` if none) count as no coverage; with a ``report``
    of 0 all are told, at the price of pairing every document and item with a common seed. Words are runs
    of ASCII letters, digits and non-ASCII characters, in lower case, told apart by their bytes. A null or
    short text is not contaminated (coverage 0, no item); items of fewer than five words or with null
    text or id match nothing; repeated rows and ids are judged each; an empty table gives no rows, an
    empty benchmark finds nothing.

    Repeated item ids are items each, of which the one with the highest coverage counts; n_items counts ids.

    Documents are known by hashes of doc_id and text, 128 bits together; rows that repeat both get one
    answer. Pairs of documents and items meet by an equi-join on seeds and are told apart before any
    words are sent to them. Found documents join back by their hashes; they are broadcast only if, counted,
    they fit Spark's bound for that.
    """
    keep = keep or ["doc_id"]
    report = threshold if report is None else min(report, threshold)
    spark = docs.sparkSession
    items = benchmark.where(F.col("item_id").isNotNull() & F.col("text").isNotNull()).select(F.col("item_id").cast("long").alias("i"), F.col("text").alias("t"))
    items = materialize(items.mapInArrow(_of_items(LEAST), "item long, words binary, seeds array<long>").withColumn("n", F.monotonically_increasing_id()), "items")
    sieve = np.zeros(1 << SIEVE_BITS - 3, np.uint8)
    blocks = "block int, bits binary"
    for r in items.select(F.explode("seeds").alias("seed")).distinct().mapInArrow(_marked, blocks).groupBy("block").applyInArrow(_merged, blocks).collect():
        sieve[r["block"] * _BLOCK : (r["block"] + 1) * _BLOCK] = np.frombuffer(r["bits"], np.uint8)
    shared = spark.sparkContext.broadcast(sieve)

    known = [F.xxhash64("doc_id", "text"), F.xxhash64(F.lit(7), "text", F.col("doc_id").isNull(), "doc_id")]
    rows = docs.select(*[F.col(c).alias(f"c{i}") for i, c in enumerate(keep)], known[0].alias("k1"), known[1].alias("k2"))
    sifted = materialize(docs.select(known[0].alias("k1"), known[1].alias("k2"), F.col("text").alias("x")).mapInArrow(_sifted(shared, LEAST), "k1 long, k2 long, words binary, seeds array<long>").dropDuplicates(["k1", "k2"]), "sifted")
    pairs = pairs_of(sifted, items, report)
    # written tables are far larger than their compressed files, by which Spark would judge what to broadcast
    met = pairs.join(items.select("item", "n", F.col("words").alias("item_words")).hint("merge"), "n").join(sifted.drop("seeds").hint("merge"), ["k1", "k2"])
    tiled = met.select("k1", "k2", "item", "item_words", "words").mapInArrow(_tiled(LEAST), "k1 long, k2 long, item long, coverage double, tiles int").where((F.col("coverage") > 0) & (F.col("coverage") >= report))
    best = F.max(F.struct("coverage", (-F.col("item")).alias("i"), "tiles")).alias("best")
    each = tiled.groupBy("k1", "k2", "item").agg(F.max(F.struct("coverage", (-F.col("tiles")).alias("t"))).alias("top")).select("k1", "k2", "item", "top.coverage", (-F.col("top.t")).alias("tiles"))
    found = materialize(each.groupBy("k1", "k2").agg(best, F.count_if(F.col("coverage") >= threshold).alias("items")), "found")
    drop_scratch(items)
    drop_scratch(sifted)
    most = int(spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get("spark.sql.autoBroadcastJoinThreshold")))
    found = found.hint("broadcast" if found.count() * _FOUND_BYTES <= most else "merge")
    return rows.join(found, ["k1", "k2"], "left").select(
        *[F.col(f"c{i}").alias(c) for i, c in enumerate(keep)],
        F.coalesce(F.col("best.coverage") >= threshold, F.lit(False)).alias("contaminated"),
        (-F.col("best.i")).alias("best_item"),
        F.coalesce(F.col("best.coverage"), F.lit(0.0)).alias("coverage"),
        F.coalesce(F.col("items"), F.lit(0)).cast("int").alias("n_items"),
        F.coalesce(F.col("best.tiles"), F.lit(0)).alias("n_tiles"),
    )


def op6_decontaminate(spark, sf_dir: str) -> DataFrame:
    return decontaminate(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
