"""Exact top-k inner products: a grid of tiles, merged as a tree.

Vectors are packed into tiles (a matrix in one row). Query tiles and row tiles are dealt to groups of a
fixed number of tiles; each cell of the grid of both groups is one task, which multiplies every query tile
with every row tile and keeps, for each query, the best k. Those short lists are merged level by level. The
query set is a stated part of the table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import materialize

ROWS_PER_TILE = 4096
QUERIES_PER_TILE = 512
#: Tiles of a group: what a cell of the grid holds at a time.
QUERY_GROUP, ROW_GROUP = 16, 8
#: Scores beyond 64 bits count as the number of 64 bits next to them.
LEAST_SCORE, MOST_SCORE = -(2**63), 2**63 - 1
#: Products up to here are exact in a double.
_EXACT = float(2**53)
_TILE = "dim int, ids binary, more binary, matrix binary"
_LIST = "query_id long, vec_id long, score long"


def quantized(x: Column, scale: float = 256.0) -> Column:
    """floor(scale * component) as doubles, or null where the vector or a component is null or not finite."""
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v.cast("double")) | (F.abs(v.cast("double")) == float("inf")))

    def floored(v: Column) -> Column:
        y = v.cast("double") * F.lit(scale)
        return F.when(F.abs(y) < F.lit(_EXACT), F.floor(y).cast("double")).otherwise(y)  # larger doubles are whole, and floor() ends at 64 bits

    return F.when(x.isNotNull() & ~bad, F.transform(x, floored))


def _pack(rows_per_tile: int):
    """Tiles of rows (id, v, more): ``more`` is an array of integers, as many for each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}

        def tile(dim: int) -> pa.RecordBatch:
            ids, more, m = (np.concatenate(x) for x in zip(*held[dim]))
            order = np.argsort(ids, kind="stable")
            columns = [pa.array([np.ascontiguousarray(x[order]).tobytes()], pa.binary()) for x in (ids, more, m)]
            return pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), *columns], names=["dim", "ids", "more", "matrix"])

        for batch in batches:
            lists = batch.column("v")
            ids, dims = np.asarray(batch.column("id"), np.int64), np.asarray(lists.value_lengths(), np.int64)
            more = np.asarray(batch.column("more").flatten(), np.int64).reshape(len(batch), -1)
            flat, starts = np.asarray(lists.flatten(), np.float64), np.concatenate([[0], np.cumsum(dims)])
            for dim in np.unique(dims):
                at = np.flatnonzero(dims == dim)
                for lo in range(0, len(at), rows_per_tile):
                    part = at[lo : lo + rows_per_tile]
                    m = flat[starts[part][:, None] + np.arange(dim)[None, :]]
                    held.setdefault(int(dim), []).append((ids[part], more[part], m))
                    if sum(len(x[0]) for x in held[int(dim)]) >= rows_per_tile:
                        yield tile(int(dim))
                        held[int(dim)] = []
        for dim in held:
            if held[dim]:
                yield tile(dim)

    return run


def _best(query: np.ndarray, vec: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Places of each query's k best, by score down and vec_id up."""
    order = np.lexsort((vec, ~score, query))  # ~ turns the order round, for the least number of 64 bits too
    q = query[order]
    first = np.flatnonzero(np.concatenate([[True], q[1:] != q[:-1]]))
    rank = np.arange(len(q)) - np.repeat(first, np.diff(np.concatenate([first, [len(q)]])))
    return order[rank < k]


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b.T as exact integers, within LEAST_SCORE and MOST_SCORE."""
    tops = [np.abs(m).max(axis=1, initial=0.0) for m in (a, b)]
    with np.errstate(over="ignore", invalid="ignore"):
        out = a @ b.T
        if tops[0].max(initial=0.0) * tops[1].max(initial=0.0) * a.shape[1] < _EXACT:
            return out.astype(np.int64)
        large = np.outer(*tops) * a.shape[1] >= _EXACT
    out = np.where(large, 0.0, out).astype(np.int64)
    whole = [{i: list(map(int, m[i])) for i in np.flatnonzero(large.any(axis=side)).tolist()} for m, side in ((a, 1), (b, 0))]
    for i, j in zip(*(x.tolist() for x in np.nonzero(large))):  # only the pairs of rows whose numbers are that large
        out[i, j] = max(LEAST_SCORE, min(MOST_SCORE, sum(x * y for x, y in zip(whole[0][i], whole[1][j]))))
    return out


def _search(k: int):
    def run(queries: pa.Table, rows: pa.Table) -> pa.Table:
        """All query tiles of a cell against all its row tiles."""
        kept = [np.empty(0, np.int64)] * 3
        for qids, qm in zip(*(queries.column(c).to_pylist() for c in ("ids", "matrix"))):
            qids = np.frombuffer(qids, np.int64)
            best = [np.empty(0, np.int64)] * 3
            for dim, ids, m in zip(*(rows.column(c).to_pylist() for c in ("dim", "ids", "matrix"))):
                ids = np.frombuffer(ids, np.int64)
                scores = _products(np.frombuffer(qm, np.float64).reshape(-1, dim), np.frombuffer(m, np.float64).reshape(-1, dim)) if dim else np.zeros((len(qids), len(ids)), np.int64)
                own = qids[:, None] == ids[None, :]
                masked = np.where(own, LEAST_SCORE, scores)
                most = min(k, masked.shape[1])
                # partial selection: the k-th best score of each query; all that tie with it stay until the merge
                floor = np.partition(masked, masked.shape[1] - most, axis=1)[:, masked.shape[1] - most]
                r, c = np.nonzero((masked >= floor[:, None]) & ~own)
                new = [qids[r], ids[c], scores[r, c]]
                part = _best(*new, k)
                best = [np.concatenate([x, y[part]]) for x, y in zip(best, new)]
                part = _best(*best, k)
                best = [x[part] for x in best]
            kept = [np.concatenate([x, y]) for x, y in zip(kept, best)]
        return pa.table(dict(zip(("query_id", "vec_id", "score"), map(pa.array, kept))))

    return run


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the ``k`` highest integer inner products of each query.

    Components count as floor(256 * x). A query's own id is no candidate; ties go to the smaller
    vec_id. Vectors that are null or hold a null or non-finite component, and null ids, take no part;
    vectors meet only those of their own length. Rows that repeat an id are candidates each; an id asks
    once, with the least of its vectors, component by component. A score beyond 64 bits counts as the
    nearest number of 64 bits. An empty table gives no rows. Columns besides the two named are ignored.

    Every query meets every row, which is the work asked for. A row tile travels once for each group of
    query tiles and a query tile once for each group of row tiles; a task holds one group of each.
    """
    rows = vectors.select(F.col(id).cast("long").alias("id"), quantized(F.col(vector)).alias("v"), is_query.alias("q"), F.expr("array(0L)").alias("more")).where(F.col("id").isNotNull() & F.col("v").isNotNull())
    tiles = materialize(rows.select("id", "v", "more").mapInArrow(_pack(ROWS_PER_TILE), _TILE), "topk-rows")
    once = rows.where("q").groupBy("id").agg(F.min("v").alias("v"), F.expr("array(0L)").alias("more"))
    asked = materialize(once.mapInArrow(_pack(QUERIES_PER_TILE), _TILE), "topk-queries")
    grid = {}
    for name, table, size in (("query_group", asked, QUERY_GROUP), ("row_group", tiles, ROW_GROUP)):
        grid[name] = max(1, -(-table.count() // size))
    place = lambda name: F.pmod(F.xxhash64("ids", "matrix"), F.lit(grid[name])).cast("int").alias(name)
    every = lambda name: F.explode(F.sequence(F.lit(0), F.lit(grid[name] - 1))).alias(name)
    cell = ["dim", "query_group", "row_group"]
    left = asked.select("dim", "ids", "matrix", place("query_group"), every("row_group")).groupBy(cell)
    right = tiles.select("dim", "ids", "matrix", place("row_group"), every("query_group")).groupBy(cell)
    lists = left.cogroup(right).applyInArrow(_search(k), _LIST)
    for level in range(2):  # a tree: lists meet first in groups by a hash of the candidate, then all
        by = [F.col("query_id"), F.pmod(F.xxhash64("vec_id"), F.lit(8))] if level == 0 else [F.col("query_id")]
        order = Window.partitionBy(*by).orderBy(F.col("score").desc(), F.col("vec_id"))
        lists = lists.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        if level == 0:
            lists = lists.drop("rank")
    return lists.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op4_top_k(spark, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return top_k(vectors, F.col("vec_id") % 50 == 0)
