"""Suffix-array dedup of bytes, with two-stage suffix sorting.

A byte goes if a 50-byte string over it also starts in a document with a smaller id. Strings that
repeat end up next to each other in a suffix array with a common prefix of 50 bytes or more. One suffix
array of all texts would be shuffled many times over, and most of it is of no use: only stretches that
can repeat are sorted, and each bucket builds the suffix array of the stretches it got.

Stretches are found by minimizers: the least 16-byte string in a 50-byte window depends on the window
alone, so equal windows have equal minimizers. Windows in a row with one minimizer make a stretch,
which goes to the minimizer's bucket if the minimizer occurs in two documents; for a minimizer that
very many share, single windows go by a hash of their own.

Sorting is in two stages. A suffix smaller than its successor (type B) is sorted directly. A suffix
larger than its successor (type A) is not compared at all: scanning buckets by first byte upwards, its
rank follows from the rank of the suffix after its run of equal bytes, which a bucket before has fixed.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunks import runs
from .packs import Method, Pack, exchange
from .words import groups, hashed, mix

#: Bytes of a window, of a minimizer's string, and minimizer places in a window.
WINDOW, GRAM = 50, 16
PLACES = WINDOW - GRAM + 1


def _loads(data: np.ndarray, n: int, at: int) -> np.ndarray:
    """The eight bytes from each of the places at, at+1, ... as numbers."""
    return np.ndarray((n,), np.uint64, data, offset=at, strides=(1,))


def minimizers(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Stretches of windows in a row with one minimizer: first window, windows, minimizer's fingerprint, text."""
    n = len(data) - WINDOW + 1
    none = np.empty(0, np.int64)
    if n <= 0:
        return none, none, none.astype(np.uint64), none
    m = len(data) - GRAM + 1
    h = _loads(data, m, 0) * np.uint64(0x9DDFEA08EB382D69)
    h ^= h >> np.uint64(32)
    h += _loads(data, m, 8)
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(29)
    low = np.uint64((1 << 31) - 1)
    key = (h & ~low) | np.arange(m, dtype=np.uint64)
    width = 1
    while width * 2 <= PLACES:
        key = np.minimum(key[: len(key) - width], key[width:])
        width *= 2
    key = np.minimum(key[:n], key[PLACES - width : PLACES - width + n])
    place = (key & low).astype(np.int64)
    # a window must end in the text where it starts
    lens = np.diff(np.concatenate([[0], ends]))
    text = np.repeat(np.arange(len(ends)), lens)
    ok = text[:n] == text[WINDOW - 1 :]
    change = np.ones(n, bool)
    change[1:] = (place[1:] != place[:-1]) | ~ok[:-1]
    first = np.flatnonzero(change & ok)
    stop = np.flatnonzero(np.concatenate([change[1:] | ~ok[1:], [True]]) & ok)
    return first, stop - first + 1, mix(h[place[first]]), text[first]


def _least(ids: np.ndarray, *keys: np.ndarray):
    """Groups of equal keys: group of each, first member (of the least id) of each group."""
    order = np.lexsort((ids, *keys))
    new = np.zeros(len(order), bool)
    if len(order):
        new[0] = True
    for k in keys:
        s = k[order]
        new[1:] |= s[1:] != s[:-1]
    group = np.empty(len(order), np.int64)
    group[order] = np.cumsum(new) - 1
    return group, order[new]


class _Sorter:
    """Two-stage sort of the suffixes that start in windows, by their first WINDOW bytes."""

    def __init__(self, body: np.ndarray, sizes: np.ndarray):
        lengths = sizes + WINDOW - 1
        bytes_used = np.flatnonzero(np.bincount(body, minlength=256))
        self.bits = max(1, int(len(bytes_used)).bit_length())
        self.chars = min(63 // self.bits, WINDOW)
        lut = np.zeros(256, np.uint16)
        lut[bytes_used] = np.arange(1, len(bytes_used) + 1)
        # zeros behind each unit, so that a key never reads into the next
        pad = self.chars
        self.first = np.concatenate([[0], np.cumsum(lengths + pad)])[:-1]
        code = np.zeros(int((lengths + pad).sum()), np.uint16)
        #: places fit into half the bytes unless there are very many
        self.index = np.int32 if len(code) < np.iinfo(np.int32).max else np.int64
        code[runs(self.first, lengths)] = lut[body]
        self.code, self.sizes, self.last = code, sizes, self.first + lengths - 1
        self.top = len(bytes_used)
        # end of the unit, exclusive, at each place
        self.end = np.repeat((self.last + 1).astype(self.index), lengths + pad)
        self.key = self._keys()

    def _keys(self) -> np.ndarray:
        """The next ``chars`` symbols at each place as one number."""
        b, n = self.bits, len(self.code)
        width, built = 1, {1: self.code}
        while width * 2 <= self.chars:
            kind = next(t for t in (np.uint16, np.uint32, np.uint64) if 2 * width * b <= 8 * t().itemsize)
            k = built[width].astype(kind)
            k <<= kind(b * width)
            k[: n - width] |= built[width][width:]
            built[width * 2] = k
            width *= 2
        out, have = np.zeros(n + WINDOW, np.uint64), 0  # zeros for places past the end
        for w in sorted(built, reverse=True):
            if self.chars - have >= w:
                out <<= np.uint64(b * w)
                out[: n - have] |= built[w][have:]
                have += w
        return out

    def at(self, place: np.ndarray, offset: int) -> np.ndarray:
        return np.where(place + offset < self.end[place], self.key[place + offset], np.uint64(0))

    def _agreed(self, x: np.ndarray, offset: int) -> np.ndarray:
        """How many symbols agree where keys at ``offset``, those before being equal, differ in the bits ``x``."""
        # symbols before the highest bit that differs
        high = np.where(x >> np.uint64(32), np.frexp((x >> np.uint64(32)).astype(np.float64))[1] + 32, np.frexp((x & np.uint64(0xFFFFFFFF)).astype(np.float64))[1])
        return np.minimum(offset + self.chars - 1 - (high - 1) // self.bits, WINDOW)

    def common_prefix(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many of the places' next WINDOW symbols agree, up to the first that does not."""
        out = np.full(len(a), WINDOW)
        live = np.arange(len(a))
        rest_a, rest_b = self.end[a] - a, self.end[b] - b
        for offset in range(0, WINDOW, self.chars):
            x = np.where(offset < rest_a, self.key[a + offset], np.uint64(0)) ^ np.where(offset < rest_b, self.key[b + offset], np.uint64(0))
            differ = np.flatnonzero(x)
            if len(differ):
                out[live[differ]] = self._agreed(x[differ], offset)
                on = np.flatnonzero(x == 0)
                live, a, b, rest_a, rest_b = live[on], a[on], b[on], rest_a[on], rest_b[on]
        return out

    def neighbours(self, order: np.ndarray) -> np.ndarray:
        """``common_prefix`` of each but the first of ``order`` with the one before it. All start windows, so no key is past its unit."""
        out = np.full(max(len(order) - 1, 0), WINDOW)
        for offset in range(0, WINDOW, self.chars):
            k = self.key[order + offset]
            x = k[1:] ^ k[:-1]
            differ = np.flatnonzero((x != 0) & (out == WINDOW))
            out[differ] = self._agreed(x[differ], offset)
        return out

    def same(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return self.common_prefix(a, b) == WINDOW

    def direct(self, places: np.ndarray) -> np.ndarray:
        """``places`` in the order of their next WINDOW symbols."""
        k = self.key[places]
        by = np.argsort(k)
        order, k = places[by], k[by]
        tie = np.zeros(len(order), bool)
        tie[1:] = k[1:] == k[:-1]
        offset = self.chars
        while offset < WINDOW and tie.any():
            # groups of equal symbols so far, unless all their members agree up to the window's end
            group = np.cumsum(~tie) - 1
            at = np.flatnonzero(tie)
            differ = at[~self.same(order[at], order[at - 1])]
            if not len(differ):
                break
            open_group = np.zeros(int(group[-1]) + 1, bool)
            open_group[group[differ]] = True
            slots = np.flatnonzero(open_group[group])
            g = group[slots]
            k = self.at(order[slots], offset)
            by = np.lexsort((k, g))
            order[slots] = order[slots[by]]
            k = k[by]
            tie = np.zeros(len(order), bool)
            tie[slots[1:]] = (k[1:] == k[:-1]) & (g[1:] == g[:-1])
            offset += self.chars
        return order

    def suffixes(self) -> np.ndarray:
        """Starts of windows, sorted."""
        n = len(self.code)
        index = np.arange(n, dtype=self.index)
        breaks = np.ones(n, bool)
        breaks[:-1] = self.code[:-1] != self.code[1:]
        stop = np.where(breaks, index, self.index(n))
        stop = np.minimum.accumulate(stop[::-1])[::-1]  # last place of the run of equal symbols
        after = np.minimum(stop + 1, n - 1)
        larger = (self.code[after] < self.code) & (after < self.end)
        b_next = np.minimum.accumulate(np.where(larger, self.index(n), index)[::-1])[::-1]
        final = b_next[self.first + self.sizes - 1]  # type B at or after the last window; the unit's last place is one
        used = runs(self.first, final - self.first + 1)
        is_a = larger[used]
        a, b = used[is_a], self.direct(used[~is_a])
        first_a, first_b = self.code[a], self.code[b]
        n_a, n_b = np.bincount(first_a, minlength=self.top + 1), np.bincount(first_b, minlength=self.top + 1)
        start = np.concatenate([[0], np.cumsum(n_a + n_b)])
        rank = np.zeros(n, self.index)
        begin_b = np.concatenate([[0], np.cumsum(n_b)])[:-1]
        rank[b] = (start[:-1] + n_a - begin_b)[first_b] + np.arange(len(b))
        by_symbol = a[np.argsort(first_a, kind="stable")]
        begin_a = np.concatenate([[0], np.cumsum(n_a)])
        for c in np.flatnonzero(n_a):
            own = by_symbol[begin_a[c] : begin_a[c + 1]]
            length = stop[own] - own + 1
            order = np.argsort((length << 40) | rank[after[own]])
            rank[own[order]] = start[c] + np.arange(len(own))
        out = np.empty(len(used), np.int64)
        out[rank[used]] = used
        is_window = np.zeros(n, bool)
        is_window[runs(self.first, self.sizes)] = True
        return out[is_window[out]]


def covered(docs: np.ndarray, sizes: np.ndarray, body: np.ndarray) -> np.ndarray:
    """For each window of the units: does a unit of a smaller document have it too?"""
    if not len(sizes):
        return np.empty(0, bool)
    s = _Sorter(body, sizes)
    order = s.suffixes()
    new = np.ones(len(order), bool)
    new[1:] = s.neighbours(order) < WINDOW
    doc = np.zeros(len(s.code), np.int64)
    windows = runs(s.first, sizes)
    doc[windows] = np.repeat(docs, sizes)
    d = doc[order]
    least = np.minimum.reduceat(d, np.flatnonzero(new))
    out = np.zeros(len(s.code), bool)
    out[order] = d > least[np.cumsum(new) - 1]
    return out[windows]


class ByteWindows(Method):
    def anchors(self, pack: Pack):
        data = np.frombuffer(pack.text, np.uint8)
        first, windows, keys, text = minimizers(data, pack.ends)
        return (data, first, windows, keys, text), keys, pack.ids[text]

    def units(self, pack: Pack, state, shared: np.ndarray, common: np.ndarray):
        data, first, windows, keys, text = state
        # stretches of minimizers that not too many share, then single windows of the others
        s, c = np.flatnonzero(shared & ~common), np.flatnonzero(common)
        start = np.concatenate([first[s], runs(first[c], windows[c])])
        size = np.concatenate([windows[s], np.ones(int(windows[c].sum()), np.int64)])
        end = start + size + WINDOW - 1
        body_hash = hashed(data, start, end)
        key = np.concatenate([keys[s], body_hash[len(s) :]])
        owner = np.concatenate([text[s], np.repeat(text[c], windows[c])])
        ids = pack.ids[owner]
        # equal bytes have equal minimizers, so they go to one bucket
        group, pick = _least(ids, groups(data, start, end, body_hash)[0])
        own = ids > ids[pick][group] if len(pick) else np.empty(0, bool)
        lengths = size[pick] + WINDOW - 1
        body = data[runs(start[pick], lengths)]
        return (data, start, size, own, group, size[pick]), key[pick], ids[pick], size[pick], body, np.cumsum(lengths)

    def lengths(self, sizes: np.ndarray) -> np.ndarray:
        return sizes + WINDOW - 1

    def compare(self, docs: np.ndarray, sizes: np.ndarray, body: np.ndarray) -> np.ndarray:
        return covered(docs, sizes, body)

    def finish(self, pack: Pack, state, bits: np.ndarray) -> list[pa.Array]:
        data, start, size, own, group, sent = state
        n = len(data)
        edge = np.zeros(n + WINDOW + 1, np.int64)
        if len(start):
            base = np.concatenate([[0], np.cumsum(sent)])[:-1]
            gone = bits[runs(base[group], size)] | np.repeat(own, size)
            at = runs(start, size)[gone]
            np.add.at(edge, at, 1)
            np.add.at(edge, at + WINDOW, -1)
        dead = np.cumsum(edge)[:n] > 0
        lens, ends = pack.lens, pack.ends
        before = np.concatenate([[0], np.cumsum(dead)])
        removed = before[ends] - before[ends - lens]
        # a run begins at a removed byte that the text's first is, or that a kept one precedes
        begins = dead.copy()
        begins[1:] &= ~dead[:-1]
        heads = (ends - lens)[lens > 0]
        begins[heads] = dead[heads]
        spans = np.concatenate([[0], np.cumsum(begins)])
        kept = data[~dead].tobytes()
        upto = ends - before[ends]
        texts = [kept[hi - k : hi] for hi, k in zip(upto.tolist(), (lens - removed).tolist())]
        return [pa.array(lens, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans[ends] - spans[ends - lens], pa.int64()), pa.array(texts, pa.binary())]


def dedup_suffixes(docs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """``docs``' columns named in ``keep`` (doc_id if none) with n_bytes, n_removed, n_spans and kept.

    Texts are UTF-8 bytes. A byte goes if a 50-byte string over it also starts in a document with a
    smaller doc_id, as judged on the input; kept is the rest, n_spans the maximal removed runs.

    Null text is empty; texts under 50 bytes keep all. A null doc_id counts as larger than any; rows
    that share an id take nothing from each other. Very long texts are packed alone. An empty table
    gives no rows. Bytes decide everywhere; fingerprints only bring together what may be equal.
    """
    return exchange(docs, ByteWindows(), keep or ["doc_id"], [("n_bytes", "long"), ("n_removed", "long"), ("n_spans", "long"), ("kept", "binary")])


def op3_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    out = dedup_suffixes(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
