"""Substring dedup by words, with difference-cover anchors.

Of every document the words at positions that fall in a difference cover modulo a period are anchors;
an anchor's fingerprint is that of the words from there on. Whatever two positions a match has in its
two documents, within one period both are covered by an anchor at the same distance from its start. So
two equal windows share an anchor, and only windows around shared anchors are compared in full.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunks import runs
from .packs import Method, Pack, exchange
from .words import SPACED, grams, whole, words_of

#: Consecutive words of a window.
WINDOW = 13
#: Every residue modulo PERIOD is a difference of two members of COVER.
PERIOD, COVER = 7, (1, 2, 4)
#: Words of an anchor: with any offset below the period it stays inside the window.
ANCHOR = WINDOW - PERIOD + 1


class WordWindows(Method):
    def anchors(self, pack: Pack):
        w = words_of(pack.texts(), SPACED)
        first = np.repeat(np.cumsum(w.counts) - w.counts, w.counts)
        doc = np.repeat(np.arange(len(w.counts)), w.counts)
        place = np.arange(len(doc)) - first
        ok = np.isin(place % PERIOD, COVER) & (w.counts[doc] >= WINDOW)
        ok[: max(0, len(ok) - ANCHOR + 1)] &= whole(w.counts, ANCHOR)
        ok[max(0, len(ok) - ANCHOR + 1) :] = False
        at = np.flatnonzero(ok)
        return (w, doc, at), grams(w.hashes, ANCHOR)[at], pack.ids[doc[at]]

    def units(self, pack: Pack, state, shared: np.ndarray, common: np.ndarray):
        w, doc, at = state
        n = max(0, len(w.hashes) - WINDOW + 1)
        mark = np.zeros(len(w.hashes) + 1, np.int64)
        mark[1:][at[shared]] = 1
        before = np.cumsum(mark)
        starts = np.flatnonzero((before[PERIOD : PERIOD + n] > before[:n]) & whole(w.counts, WINDOW)) if n else np.empty(0, np.int64)
        # the words under those windows, by digests that nobody can make clash
        edge = np.zeros(len(w.hashes) + WINDOW + 1, np.int64)
        np.add.at(edge, starts, 1)
        np.add.at(edge, starts + WINDOW, -1)
        under = np.flatnonzero(np.cumsum(edge)[: len(w.hashes)])
        words = np.zeros((2, len(w.hashes)), np.uint64)
        words[:, under] = w.digests(under).T
        one = grams(words[0], WINDOW)[starts]
        two = grams(words[1], WINDOW, 0xD6E8FEB86659FD93)[starts]
        ids = pack.ids[doc[starts]]
        order = np.lexsort((ids, two, one))
        a, b, c = one[order], two[order], ids[order]
        new = np.ones(len(order), bool)
        new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        group = np.cumsum(new) - 1
        least = c[new]
        # later documents of this pack are decided here; the answer for the first holds for its repeats too
        own = np.empty(len(order), bool)
        own[order] = c > least[group]
        member = np.empty(len(order), np.int64)
        member[order] = group
        body = np.stack([a[new], b[new]], axis=1).view(np.uint8).ravel()
        sizes = np.ones(len(least), np.int64)
        return (w, doc, starts, own, member), a[new], least, sizes, body, np.arange(1, len(least) + 1) * 16

    def lengths(self, sizes: np.ndarray) -> np.ndarray:
        return sizes * 16

    def compare(self, docs: np.ndarray, sizes: np.ndarray, body: np.ndarray) -> np.ndarray:
        one, two = body.view(np.uint64).reshape(-1, 2).T
        order = np.lexsort((docs, two, one))
        a, b, c = one[order], two[order], docs[order]
        new = np.ones(len(order), bool)
        new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        out = np.empty(len(order), bool)
        out[order] = c > c[new][np.cumsum(new) - 1]
        return out

    def finish(self, pack: Pack, state, bits: np.ndarray) -> list[pa.Array]:
        w, _, starts, own, member = state
        gone = starts[own | bits[member]] if len(starts) else starts
        edge = np.zeros(len(w.hashes) + WINDOW + 1, np.int64)
        np.add.at(edge, gone, 1)
        np.add.at(edge, gone + WINDOW, -1)
        keep = np.cumsum(edge)[: len(w.hashes)] == 0
        owner = np.repeat(np.arange(len(w.counts)), w.counts)
        # each kept word with one byte after it, which becomes the space between it and the next
        lengths = (w.ends - w.starts + 1)[keep]
        text = w.data[runs(w.starts[keep], lengths)]
        ends = np.cumsum(lengths)
        text[ends - 1] = 0x20
        kept = np.bincount(owner[keep], minlength=len(w.counts))
        upto = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(kept)])]
        raw = text.tobytes()
        texts = [raw[lo : max(lo, hi - 1)] for lo, hi in zip(upto[:-1].tolist(), upto[1:].tolist())]
        return [pa.array(w.counts, pa.int64()), pa.array(w.counts - kept, pa.int64()), pa.array(texts, pa.binary()).cast(pa.string())]


def dedup_substrings(docs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """``docs``' columns named in ``keep`` (doc_id if none) with n_words, n_removed and kept_text.

    A word goes if it lies in a window of 13 words whose sequence also starts in a document with a
    smaller doc_id, as judged on the input. kept_text has the other words, one space between them.

    Null text has no words; documents under 13 words keep all. A null doc_id counts as larger than
    any; rows that share an id take nothing from each other. Very long texts are packed alone. An empty
    table gives no rows. Words are told apart by 128-bit digests of their bytes, windows by two numbers of 64
    bits, each made of one half of those digests.
    """
    return exchange(docs, WordWindows(), keep or ["doc_id"], [("n_words", "long"), ("n_removed", "long"), ("kept_text", "string")])


def op5_substring_dedup(spark, sf_dir: str) -> DataFrame:
    out = dedup_substrings(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))
