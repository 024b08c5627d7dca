"""Toxicity by a chain of linear classifiers over word presence.

The categories are taken in order. The model of each sees the words and the probabilities of the
categories before it; those probabilities come from out-of-fold models while training, so a later
model never learns from answers its predecessors had memorised.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .chunks import by_bytes, utf8
from .scratch import drop_scratch, materialize
from .words import LETTERED, lowered, words_of

#: Labelled rows that training looks at, about: each class of the last category has half of them at most, expected.
TRAIN_ROWS = 8000
FOLDS = 3
#: A word is a feature if at least so many sampled texts have it and its chi-squared is so high.
LEAST_TEXTS, CHI2, MOST_WORDS = 5, 25.0, 2000
THRESHOLD = 0.5
_CHUNK = 1 << 20


@dataclass
class Link:
    """One category's model: sorted word fingerprints, their weights, weights of earlier categories, bias."""

    words: np.ndarray
    weights: np.ndarray
    earlier: np.ndarray
    bias: float


@dataclass
class Chain:
    names: list[str]
    links: list[Link] = field(default_factory=list)


def presence(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct words of each text (sorted fingerprints, one after another) and how many each has."""
    w = words_of([lowered(t) for t in texts], LETTERED)
    owner = np.repeat(np.arange(len(texts)), w.counts)
    order = np.lexsort((w.hashes, owner))
    h, o = w.hashes[order], owner[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (o[1:] != o[:-1])
    return h[new], np.bincount(o[new], minlength=len(texts))


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _sums(link_words: np.ndarray, weights: np.ndarray, words: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    if not len(link_words) or not len(words):
        return np.zeros(n)
    slot = np.minimum(np.searchsorted(link_words, words), len(link_words) - 1)
    hit = link_words[slot] == words
    return np.bincount(owner[hit], weights=weights[slot[hit]], minlength=n)


def _fit(words: np.ndarray, owner: np.ndarray, n: int, earlier: np.ndarray, y: np.ndarray, rows: np.ndarray) -> Link:
    """Logistic regression on the rows that ``rows`` marks, classes weighted evenly, with an L2 penalty."""
    use = rows[owner]
    w, o = words[use], owner[use]
    vocabulary, column = np.unique(w, return_inverse=True)
    n1 = max(1.0, float((rows & (y == 1)).sum()))
    n0 = max(1.0, float((rows & (y == 0)).sum()))
    a = np.bincount(column, weights=(y[o] == 1), minlength=len(vocabulary))
    b = np.bincount(column, weights=(y[o] == 0), minlength=len(vocabulary))
    c, d = n1 - a, n0 - b
    chi = (n1 + n0) * (a * d - b * c) ** 2 / np.maximum(n1 * n0 * (a + b) * (c + d), 1e-9)
    good = np.flatnonzero((a + b >= LEAST_TEXTS) & (chi >= CHI2))
    good = np.sort(good[np.argsort(-chi[good], kind="stable")[:MOST_WORDS]])
    chosen = vocabulary[good]
    slot = np.full(len(vocabulary), -1)
    slot[good] = np.arange(len(good))
    col = slot[column]
    o, col = o[col >= 0], col[col >= 0]
    at = np.flatnonzero(rows)
    place = np.zeros(n, np.int64)
    place[at] = np.arange(len(at))
    o, e, t = place[o], earlier[at], y[at].astype(float)
    weight = np.where(t == 1, (n0 + n1) / (2 * n1), (n0 + n1) / (2 * n0)) / len(at)
    theta = np.zeros(len(good) + e.shape[1] + 1)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, 301):
        z = np.bincount(o, weights=theta[col], minlength=len(at)) + e @ theta[len(good) : -1] + theta[-1]
        r = (_sigmoid(z) - t) * weight
        g = np.concatenate([np.bincount(col, weights=r[o], minlength=len(good)), e.T @ r, [r.sum()]])
        g[:-1] += 1e-4 * theta[:-1]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        theta -= 0.1 * (1 - step / 320) * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-9)
    return Link(chosen, theta[: len(good)], theta[len(good) : -1], float(theta[-1]))


def _answer(link: Link, words: np.ndarray, owner: np.ndarray, earlier: np.ndarray) -> np.ndarray:
    return _sigmoid(_sums(link.words, link.weights, words, owner, len(earlier)) + earlier @ link.earlier + link.bias)


def train_chain(names: Sequence[str], words: np.ndarray, counts: np.ndarray, labels: dict[str, np.ndarray], folds: np.ndarray) -> Chain:
    """``labels``: 0 or 1 for each text and category, -1 where unknown."""
    n = len(counts)
    owner = np.repeat(np.arange(n), counts)
    chain, earlier = Chain(list(names)), np.zeros((n, 0))
    for name in names:
        y = labels[name]
        known = y >= 0
        out_of_fold = np.zeros(n)
        for f in range(FOLDS):
            link = _fit(words, owner, n, earlier, y, known & (folds != f))
            part = folds == f
            out_of_fold[part] = _answer(link, words, owner, earlier)[part]
        chain.links.append(_fit(words, owner, n, earlier, y, known))
        earlier = np.column_stack([earlier, out_of_fold])
    return chain


def predict(chain: Chain, texts: list[bytes | None]) -> np.ndarray:
    """Probabilities (texts by categories); all 0 for a text without words."""
    out = np.zeros((len(texts), len(chain.names)))
    for lo, hi in by_bytes(texts, _CHUNK):
        words, counts = presence(texts[lo:hi])
        owner = np.repeat(np.arange(hi - lo), counts)
        p = np.zeros((hi - lo, 0))
        for link in chain.links:
            p = np.column_stack([p, _answer(link, words, owner, p)])
        out[lo:hi] = p * (counts > 0)[:, None]
    return out


def _vocabulary(words: DataFrame, names: Sequence[str], sizes: dict[str, np.ndarray]) -> list[int]:
    """The words that any model of the chain may choose, by ``_fit``'s own rule.

    ``words``: word, fold and y_<category> for each distinct word of each text. ``sizes``: for each
    category, texts by class (0, 1) and fold. A model is fitted on all folds or all but one, so at most
    MOST_WORDS times FOLDS + 1 words of each category come out.
    """
    cells = [(n, y, f) for n in names for y in (0, 1) for f in range(FOLDS)]
    counted = materialize(words.groupBy("word").agg(*[F.count_if((F.col(f"y_{n}") == y) & (F.col("fold") == f)).alias(f"{n}_{y}_{f}") for n, y, f in cells]), "words")
    tops = []
    for n in names:
        for left_out in range(-1, FOLDS):
            folds = [f for f in range(FOLDS) if f != left_out]
            n0, n1 = (max(1.0, float(sizes[n][y, folds].sum())) for y in (0, 1))
            b, a = (sum(F.col(f"{n}_{y}_{f}") for f in folds).cast("double") for y in (0, 1))
            c, d = F.lit(n1) - a, F.lit(n0) - b
            chi = F.lit(n1 + n0) * (a * d - b * c) * (a * d - b * c) / F.greatest(F.lit(n1 * n0) * (a + b) * (c + d), F.lit(1e-9))
            # a little under the bound, which _fit applies itself
            tops.append(counted.where((a + b >= LEAST_TEXTS) & (chi >= CHI2 * 0.999)).orderBy(chi.desc(), "word").limit(MOST_WORDS + 50).select("word"))
    found = sorted({r["word"] for t in tops for r in t.collect()})
    drop_scratch(counted)
    return found


def learn(docs: DataFrame, labels: DataFrame, categories: dict[str, Column], rows: int = TRAIN_ROWS, seed: int = 11) -> Chain | None:
    """A chain over ``categories`` (name -> boolean expression over ``labels``, in chain order).

    Looks at about ``rows`` labelled documents at most, picked by a hash of doc_id, the classes of the last
    category evenly. Words are taken apart and counted on the executors; the driver gets the words that
    models may choose, and which of those each picked text has. Of contradicting labels of one document
    the highest mark of each category counts; of several texts with one id the least. Null labels are
    unknown; None where there are no usable labels.
    """
    last = list(categories)[-1]
    names = list(categories)
    marks = labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("d")).agg(*[F.max(c.cast("int")).alias(f"y_{n}") for n, c in categories.items()])
    sizes = {r[0]: r[1] for r in marks.groupBy(f"y_{last}").count().collect() if r[0] is not None}
    if len(sizes) < 2:
        return None
    drawn = F.pmod(F.xxhash64("d", F.lit(seed)), F.lit(1_000_003))
    share = F.create_map(*[x for y, n in sorted(sizes.items()) for x in (F.lit(y), F.lit(min(1.0, rows / 2 / n)))])
    picked = marks.where(F.col(f"y_{last}").isNotNull()).where(drawn < F.lit(1_000_003) * share[F.col(f"y_{last}")])
    met = docs.where(F.col("text").isNotNull()).select(F.col("doc_id").alias("d"), "text").join(F.broadcast(picked), "d")
    texts = met.groupBy("d", *[f"y_{n}" for n in names]).agg(F.min("text").alias("text")).drop("d")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            items = utf8(batch.column("text"))
            for lo, hi in by_bytes(items, _CHUNK):
                words, counts = presence(items[lo:hi])
                ends = np.concatenate([[0], np.cumsum(counts)])
                fold = np.zeros(hi - lo, np.int32)
                fold[counts > 0] = words[ends[:-1][counts > 0]] % np.uint64(FOLDS)
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(words.view(np.int64)))
                yield pa.RecordBatch.from_arrays([lists, pa.array(fold), *[batch.column(f"y_{n}").slice(lo, hi - lo) for n in names]], names=["words", "fold", *[f"y_{n}" for n in names]])

    taken = materialize(texts.mapInArrow(run, "words array<long>, fold int, " + ", ".join(f"y_{n} int" for n in names)), "taken")
    counts = {n: np.zeros((2, FOLDS)) for n in names}
    for n in names:
        for r in taken.where(F.col(f"y_{n}").isNotNull()).groupBy(f"y_{n}", "fold").count().collect():
            counts[n][r[0], r[1]] = r[2]
    known = _vocabulary(taken.select(F.explode("words").alias("word"), "fold", *[f"y_{n}" for n in names]), names, counts)
    vocabulary = np.array(known, np.int64)

    def chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("words")
            words, owner = np.asarray(lists.flatten(), np.int64), np.repeat(np.arange(len(batch)), np.asarray(lists.value_lengths()))
            hit = np.isin(words, vocabulary)
            ends = np.concatenate([[0], np.cumsum(np.bincount(owner[hit], minlength=len(batch)))])
            yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(words[hit])), *batch.columns[1:]], names=batch.schema.names)

    found = taken.mapInArrow(chosen, taken.schema).collect()
    drop_scratch(taken)
    if not found:
        return None
    found.sort(key=lambda r: (r["words"], r["fold"], *[-1 if r[f"y_{n}"] is None else r[f"y_{n}"] for n in names]))
    each = [np.sort(np.array(r["words"], np.int64).view(np.uint64)) for r in found]
    y = {n: np.array([-1 if r[f"y_{n}"] is None else r[f"y_{n}"] for r in found]) for n in names}
    return train_chain(names, np.concatenate(each), np.array([len(x) for x in each]), y, np.array([r["fold"] for r in found]))


def score(docs: DataFrame, chain: Chain | None, names: Sequence[str]) -> DataFrame:
    """doc_id and p_<category> for each document.

    Null, empty and wordless texts get 0 for every category; null ids and repeated rows are scored like
    any; an empty table gives no rows; without a chain every probability is 0.
    """
    inner = docs.select("doc_id", "text")
    schema = "doc_id long, " + ", ".join(f"p_{n} double" for n in names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = utf8(batch.column("text"))
            p = predict(chain, texts) if chain else np.zeros((len(texts), len(names)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), *[pa.array(p[:, k]) for k in range(len(names))]], names=["doc_id", *[f"p_{n}" for n in names]])

    return inner.mapInArrow(run, schema)


def categories() -> dict[str, Column]:
    """In chain order: text labelled of low quality, then toxic text.

    The labels there are have one category of toxicity only, so the chain's first link is low quality.
    """
    return {"junk": F.col("quality") == 0, "toxic": F.col("toxic") == 1}


def op9_toxicity(spark, sf_dir: str) -> DataFrame:
    """doc_id, p_junk, p_toxic and toxic (p_toxic reaches THRESHOLD); without usable labels nothing is toxic."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    chain = learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), categories())
    return score(docs, chain, list(categories())).withColumn("toxic", F.col("p_toxic") >= THRESHOLD)
