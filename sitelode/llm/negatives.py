"""Hard negatives: every anchor's scores sorted in full, a window cut from the order by binary search.

Anchors meet all rows in the grid of tiles of the exact top-k search. One pass finds each anchor's
positives, its best rows of the same label. A second pass sorts, in each cell of the grid and for each
anchor, all scores of the cell (by score, then id), finds the upper limit that each positive sets by binary
search, and reads on from there the first rows of other labels down to the lower limit. Cells' short lists
are merged as in the search.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import materialize
from .topk import _TILE, LEAST_SCORE, MOST_SCORE, _best, _pack, _products, quantized

ROWS_PER_TILE = 4096
ANCHORS_PER_TILE = 256
#: Tiles of a group: what a cell of the grid holds at a time.
ANCHOR_GROUP, ROW_GROUP = 8, 4
#: Scores that a cell sorts at a time.
_SCORES = 1 << 21
_EMPTY = np.empty(0, np.int64)


def _tiles(table: pa.Table):
    """ids, further integers and matrix of each tile of a cell; all have one dimension."""
    for dim, ids, more, m in zip(*(table.column(c).to_pylist() for c in ("dim", "ids", "more", "matrix"))):
        ids = np.frombuffer(ids, np.int64)
        yield ids, np.frombuffer(more, np.int64).reshape(len(ids), -1), np.frombuffer(m, np.float64).reshape(len(ids), dim)


def _positives(n: int):
    def run(anchors: pa.Table, rows: pa.Table) -> pa.Table:
        kept = [_EMPTY] * 3
        for aids, alabels, am in _tiles(anchors):
            best = [_EMPTY] * 3
            for ids, labels, m in _tiles(rows):
                fits = (alabels[:, :1] == labels[:, 0][None, :]) & (aids[:, None] != ids[None, :])
                r, c = np.nonzero(fits)
                new = [aids[r], ids[c], _products(am, m)[r, c]]
                part = _best(*new, n)
                best = [np.concatenate([x, y[part]]) for x, y in zip(best, new)]
                part = _best(*best, n)
                best = [x[part] for x in best]
            kept = [np.concatenate([x, y]) for x, y in zip(kept, best)]
        return pa.table(dict(zip(("anchor_id", "vec_id", "score"), map(pa.array, kept))))

    return run


def limits(score: int, lower: int, upper: int) -> tuple[int, int]:
    """The least and the highest integer s with lower * score <= 100 * s <= upper * score, within 64 bits."""
    return max(LEAST_SCORE, -(-lower * score // 100)), min(MOST_SCORE, upper * score // 100)


def window(keys: np.ndarray, other: np.ndarray, least: int, most: int, k: int) -> np.ndarray:
    """Places of the first ``k`` entries that are ``other`` among those with least <= score <= most.

    ``keys`` are the scores' complements in ascending order.
    """
    if least > most:
        return _EMPTY
    at, end = np.searchsorted(keys, [~np.int64(most)], "left")[0], np.searchsorted(keys, [~np.int64(least)], "right")[0]
    found, size = [], 4 * k
    while at < end and sum(map(len, found)) < k:  # reads on in steps that double
        found.append(at + np.flatnonzero(other[at : min(end, at + size)]))
        at, size = at + size, 2 * size
    return np.concatenate(found)[:k] if found else _EMPTY


def _negatives(k: int, lower: int, upper: int):
    def run(anchors: pa.Table, rows: pa.Table) -> pa.Table:
        out: list[list] = [[_EMPTY] for _ in range(6)]
        parts = list(_tiles(rows))
        if parts and anchors.num_rows:
            ids, labels = np.concatenate([x[0] for x in parts]), np.concatenate([x[1][:, 0] for x in parts])
            step = max(1, _SCORES // len(ids))
            for aids, more, am in _tiles(anchors):
                for lo in range(0, len(aids), step):
                    scores = np.concatenate([_products(am[lo : lo + step], m) for _, _, m in parts], axis=1)
                    for row, anchor, (label, n, *positives) in zip(scores, aids[lo : lo + step].tolist(), more[lo : lo + step].tolist()):
                        order = np.lexsort((ids, ~row))
                        keys, other = ~row[order], (labels[order] != label) & (ids[order] != anchor)
                        for rank, (pid, score) in enumerate(zip(positives[:n], positives[len(positives) // 2 :])):
                            found = order[window(keys, other, *limits(score, lower, upper), k)]
                            for column, values in zip(out, ([anchor] * len(found), [rank + 1] * len(found), [pid] * len(found), [score] * len(found), ids[found], row[found])):
                                column.append(np.asarray(values, np.int64))
        names = ("anchor_id", "positive_rank", "positive_id", "positive_score", "negative_id", "negative_score")
        return pa.table(dict(zip(names, (pa.array(np.concatenate(c)) for c in out))))

    return run


def _grid(anchors: DataFrame, rows: DataFrame, run, schema: str) -> DataFrame:
    """Each group of anchor tiles against each group of row tiles, a cell in a task."""
    n = {"anchor_group": max(1, -(-anchors.count() // ANCHOR_GROUP)), "row_group": max(1, -(-rows.count() // ROW_GROUP))}
    own = lambda name: F.pmod(F.xxhash64("ids", "matrix"), F.lit(n[name])).cast("int").alias(name)
    every = lambda name: F.explode(F.sequence(F.lit(0), F.lit(n[name] - 1))).alias(name)
    cell = ["dim", "anchor_group", "row_group"]
    left = anchors.select("*", own("anchor_group"), every("row_group")).groupBy(cell)
    return left.cogroup(rows.select("*", own("row_group"), every("anchor_group")).groupBy(cell)).applyInArrow(run, schema)


def _merged(lists: DataFrame, keys: list[str], score: str, id: str, k: int) -> DataFrame:
    """The first ``k`` of each key by score down and id up, as rank: in groups by a hash of the id first, then all."""
    for by in ([*keys, F.pmod(F.xxhash64(id), F.lit(8))], keys):
        order = Window.partitionBy(*by).orderBy(F.col(score).desc(), F.col(id))
        lists = lists.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return lists


def hard_negatives(vectors: DataFrame, is_anchor: Column, label: Column | None = None, positives: int = 5, k: int = 10, lower: int = 30, upper: int = 90, id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """anchor_id, positive_id, rank (from 1), negative_id, positive_score, negative_score, positive_rank.

    An anchor's positives are its ``positives`` best other rows of the same ``label`` (the column of that
    name, or an expression); for each of them the negatives are the ``k`` best rows of other labels whose
    score is between ``lower`` and ``upper`` hundredths of the positive's. Scores are inner products of
    floor(256 * component); ties go to the smaller id.

    Rows with a null id, label or vector, or a null or non-finite component, take no part; vectors meet
    only those of their own length. A row with an anchor's id is neither its positive nor its negative. Rows
    that repeat an id count each; an anchor id asks once, with the least of its labels and then vectors. A
    positive of negative score has no negatives (its limits are the wrong way round), one of score 0 those
    of score 0. Scores beyond 64 bits count as the nearest number of 64 bits. Anchors without positives or
    negatives give no rows, nor does an empty table. Other columns are ignored.

    Every anchor meets every row twice, which is the work asked for. A task holds a group of tiles of each
    side, whatever labels they have; a cell passes on ``k`` rows at most for an anchor and positive.
    """
    label = F.col("label") if label is None else label
    rows = vectors.select(F.col(id).cast("long").alias("id"), label.cast("long").alias("label"), quantized(F.col(vector)).alias("v"), is_anchor.alias("a"))
    rows = rows.where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull())
    anchors = materialize(rows.where("a").groupBy("id").agg(F.min(F.struct("label", "v")).alias("x")).select("id", "x.label", "x.v"), "anchors")
    tiles = materialize(rows.select("id", "v", F.array("label").alias("more")).mapInArrow(_pack(ROWS_PER_TILE), _TILE), "negatives-rows")
    asked = materialize(anchors.select("id", "v", F.array("label").alias("more")).mapInArrow(_pack(ANCHORS_PER_TILE), _TILE), "negatives-anchors")
    found = _merged(_grid(asked, tiles, _positives(positives), "anchor_id long, vec_id long, score long"), ["anchor_id"], "score", "vec_id", positives)
    found = materialize(found, "positives")
    lists = found.groupBy("anchor_id").agg(F.sort_array(F.collect_list(F.struct("rank", "vec_id", "score"))).alias("p"))  # ``positives`` entries at most
    padded = lambda field: F.concat(F.col(f"p.{field}"), F.array_repeat(F.lit(0).cast("long"), F.lit(positives) - F.size("p")))
    more = F.concat(F.array("label", F.size("p").cast("long")), padded("vec_id"), padded("score")).alias("more")
    asked = materialize(anchors.join(lists, anchors["id"] == lists["anchor_id"]).select("id", "v", more).mapInArrow(_pack(ANCHORS_PER_TILE), _TILE), "negatives-asked")
    schema = "anchor_id long, positive_rank long, positive_id long, positive_score long, negative_id long, negative_score long"
    out = _merged(_grid(asked, tiles, _negatives(k, lower, upper), schema), ["anchor_id", "positive_rank", "positive_id", "positive_score"], "negative_score", "negative_id", k)
    ints = [F.col(c).cast("int").alias(c) for c in ("rank", "positive_rank")]
    return out.select("anchor_id", "positive_id", ints[0], "negative_id", "positive_score", "negative_score", ints[1])


def op11_hard_negatives(spark, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(vectors, F.col("vec_id") % 100 == 0, label)
