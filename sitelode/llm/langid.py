"""Language identification with a byte convolutional network.

Filters of several widths slide over the UTF-8 bytes of fixed-length windows, the highest answer of
each filter in a window is kept, and a softmax over those answers gives the window's languages. A
text's languages are the mean over all its windows, by bytes. The network is trained in numpy.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .chunks import by_bytes, utf8

WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 8
#: Labelled rows that training looks at, over all languages together, and windows taken from each.
TRAIN_ROWS = 6000
TRAIN_WINDOWS = 2
EPOCHS = 30
UNKNOWN = "und"
_PAD = -1e4
_LETTER = re.compile(r"[^\W\d_]")
_CHUNK = 1 << 19


@dataclass
class Network:
    langs: list[str]
    tables: list[np.ndarray]  # for each width, (width, 256, FILTERS): what a byte at an offset adds
    bias: np.ndarray
    dense: np.ndarray
    offset: np.ndarray


def padded(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All texts' bytes, each filled with zeros to whole windows (one at least), and the windows of each."""
    n = np.array([len(t) for t in texts], np.int64)
    windows = np.maximum(1, -(-n // WINDOW))
    out = np.zeros(int(windows.sum()) * WINDOW + max(WIDTHS), np.uint8)
    at = 0
    for t, w in zip(texts, windows):
        out[at : at + len(t)] = np.frombuffer(t, np.uint8)
        at += int(w) * WINDOW
    return out, windows


def _answers(net: Network, data: np.ndarray, where: bool = False):
    """Highest answer of each filter in each window, and where asked for, its place."""
    n = len(data) - max(WIDTHS)
    best, places = [], []
    for width, table in zip(WIDTHS, net.tables):
        z = table[0].take(data[:n], axis=0)
        for j in range(1, width):
            z += table[j].take(data[j : n + j], axis=0)
        z = z.reshape(-1, WINDOW, FILTERS)
        if where:
            places.append(z.argmax(axis=1))
            best.append(z.max(axis=1))
            continue
        while z.shape[1] > 1:
            half = z.shape[1] // 2
            z = np.maximum(z[:, :half], z[:, half:])
        best.append(z[:, 0])
    raw = np.concatenate(best, axis=1) + net.bias
    return (raw, places) if where else raw


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def window_probabilities(net: Network, data: np.ndarray) -> np.ndarray:
    return _softmax(np.maximum(_answers(net, data), 0) @ net.dense + net.offset)


def train(windows: list[bytes], labels: list[str], seed: int = 7) -> Network:
    """Adam on the cross entropy; gradients reach the tables at the places that won the pooling."""
    langs = sorted(set(labels))
    rng = np.random.default_rng(seed)
    k, total = len(langs), FILTERS * len(WIDTHS)
    net = Network(langs, [rng.normal(0, 0.3, (w, 256, FILTERS)).astype(np.float32) for w in WIDTHS], np.zeros(total, np.float32), rng.normal(0, 0.3, (total, k)).astype(np.float32), np.zeros(k, np.float32))
    for t in net.tables:
        t[:, 0] = _PAD
    x = np.zeros((len(windows), WINDOW), np.uint8)
    for i, w in enumerate(windows):
        w = w[:WINDOW]
        x[i, : len(w)] = np.frombuffer(w, np.uint8)
    y = np.searchsorted(langs, labels)
    share = np.bincount(y, minlength=k)
    weight = (len(y) / (k * np.maximum(share, 1)))[y].astype(np.float32)
    params = [*net.tables, net.bias, net.dense, net.offset]
    m, v, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    for epoch in range(EPOCHS):
        order = rng.permutation(len(x))
        rate = 0.02 * (1 - epoch / EPOCHS) + 0.001
        for lo in range(0, len(order), 128):
            pick = order[lo : lo + 128]
            data = np.concatenate([x[pick].ravel(), np.zeros(max(WIDTHS), np.uint8)])
            raw, places = _answers(net, data, where=True)
            act = np.maximum(raw, 0)
            p = _softmax(act @ net.dense + net.offset)
            p[np.arange(len(pick)), y[pick]] -= 1
            p *= weight[pick, None] / len(pick)
            grads = [np.zeros_like(t) for t in net.tables]
            back = (p @ net.dense.T) * (raw > 0)
            for g, width, place, part in zip(grads, WIDTHS, places, np.split(back, len(WIDTHS), axis=1)):
                at = place + np.arange(len(pick))[:, None] * WINDOW
                for j in range(width):
                    np.add.at(g[j], (data[at + j], np.arange(FILTERS)[None, :]), part)
                g[:, 0] = 0
            grads += [back.sum(axis=0), act.T @ p, p.sum(axis=0)]
            step += 1
            for q, g, a, b in zip(params, grads, m, v):
                a *= 0.9
                a += 0.1 * g
                b *= 0.999
                b += 0.001 * g * g
                q -= rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-8)
    for t in net.tables:
        t[:, 0] = _PAD
    return net


def held_out(doc_id: Column) -> Column:
    """True for the quarter of documents that training never sees."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def sample_windows(docs: DataFrame, rows: int = TRAIN_ROWS, seed: int = 7) -> tuple[list[bytes], list[str]]:
    """Windows of at most ``rows`` labelled documents outside the held-out quarter, languages even.

    Documents are picked by a hash of id and text, so the sample needs no sort or shuffle of texts and
    is the same in every run (unless whole rows repeat beyond twice ``rows``); only counts of languages and the picked windows reach the driver.
    """
    known = docs.where(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return [], []
    quota = max(1, rows // len(counts))
    share = F.create_map(*[x for lang, n in sorted(counts.items()) for x in (F.lit(lang), F.lit(min(1.0, 1.3 * quota / n)))])
    drawn = F.pmod(F.xxhash64("doc_id", "text", F.lit(seed)), F.lit(1_000_003))
    n = F.length("text")
    parts = F.array(*[F.substring(F.col("text"), (F.pmod(F.xxhash64("text", F.lit(seed + 1 + i)), F.greatest(n - WINDOW, F.lit(1)))).cast("int") + 1, F.lit(WINDOW)) for i in range(TRAIN_WINDOWS)])
    picked = known.where(drawn < F.lit(1_000_003) * share[F.col("lang")]).select("lang", drawn.alias("drawn"), parts.alias("parts")).limit(2 * rows + len(counts)).collect()
    taken: dict[str, int] = {}
    windows, labels = [], []
    for r in sorted(picked, key=lambda r: (r["lang"], r["drawn"], r["parts"])):
        if taken.setdefault(r["lang"], 0) < quota:
            taken[r["lang"]] += 1
            for part in dict.fromkeys(r["parts"]):
                if _LETTER.search(part):
                    windows.append(part.encode()[:WINDOW])
                    labels.append(r["lang"])
    return windows, labels


def classify(net: Network, texts: list[bytes | None]) -> list[tuple[str, float]]:
    """Language and its mean probability for each text; ``und`` and 0 for null or letterless texts."""
    out: list[tuple[str, float]] = [(UNKNOWN, 0.0)] * len(texts)
    for lo, hi in by_bytes(texts, _CHUNK):
        at = [i for i in range(lo, hi) if texts[i] and _LETTER.search(texts[i].decode("utf-8", "replace"))]
        if not at or not net.langs:
            continue
        sums = np.zeros((len(at), len(net.langs)))
        # a text longer than a chunk goes through in pieces of whole windows
        pieces, owner = [], []
        for k, i in enumerate(at):
            t = texts[i].replace(b"\0", b" ")
            for s in range(0, len(t), _CHUNK):
                pieces.append(t[s : s + _CHUNK])
                owner.append(k)
        for a, b in by_bytes(pieces, _CHUNK):
            data, windows = padded(pieces[a:b])
            p = window_probabilities(net, data)
            size = np.full(len(p), WINDOW)
            ends = np.cumsum(windows)
            size[ends - 1] = [len(x) - (w - 1) * WINDOW for x, w in zip(pieces[a:b], windows)]
            np.add.at(sums, np.repeat(owner[a:b], windows), p * size[:, None])
        sums /= sums.sum(axis=1, keepdims=True)
        for i, row in zip(at, sums):
            best = int(row.argmax())
            out[i] = (net.langs[best], float(min(1.0, row[best])))
    return out


def identify(docs: DataFrame, net: Network, keep: list[str] | None = None) -> DataFrame:
    """``docs``' columns named in ``keep`` (doc_id if none) with lang_pred and score.

    Null text, or text without a letter: ``und`` and 0. Rows with null doc_id and repeated rows are
    predicted like any. An empty table gives no rows. With no labelled text at all, all are ``und``.
    """
    keep = keep or ["doc_id"]
    inner = docs.select(*[F.col(c).alias(f"c{i}") for i, c in enumerate(keep)], F.col("text").alias("x"))
    schema = inner.drop("x").withColumn("p", F.lit("")).withColumn("s", F.lit(0.0)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = classify(net, utf8(batch.column("x")))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array([p for p, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64())], names=[*batch.schema.names[:-1], "p", "s"])

    out = inner.mapInArrow(run, schema)
    return out.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(keep)], F.col("p").alias("lang_pred"), F.col("s").alias("score"))


def op10_language_id(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    windows, labels = sample_windows(docs)
    net = train(windows, labels) if windows else Network([], [], np.empty(0), np.empty(0), np.empty(0))
    out = identify(docs.select("doc_id", "text"), net)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
