"""Force-directed layout of a link graph and its SVG map: repulsion from grid cells, attraction along links.

All pairs of pages repel each other, which a grid makes linear: far cells push with all their pages from their
centre, and of the nine cells around a page the small ones inside them do so. The canvas is fixed, so there are
never more than some ten thousand cells, however many pages; their counts and centres are all that goes
through the driver, once a round. A page that has others within a few small cells' sides, where pushes are
strongest, may go another way than by all pairs; all others go the same way to a small part of a unit.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import graph
from .functions.scalars import escape_html
from .plans.scratch import cut
from .registry import query

# Strengths, distance, damping and canvas of the layout; colours by depth of clicks.
REPULSION, ATTRACTION, IDEAL, DAMPING = 2000.0, 0.005, 120.0, 0.9
LEFT, RIGHT, TOP, BOTTOM = 60.0, 1140.0, 60.0, 840.0
DEPTH_COLORS = ["#3b82f6", "#6366f1", "#8b5cf6", "#a855f7", "#d946ef", "#ec4899"]
#: Sides of large and small cells; a large one holds a whole number of small ones.
COARSE, FINE = 60.0, 3.0


def _push(x: np.ndarray, y: np.ndarray, cx: np.ndarray, cy: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What ``n`` pages at each of the centres do to each page: sums over the last axis."""
    dx, dy = x[:, None] - cx, y[:, None] - cy
    square = np.maximum(dx * dx + dy * dy, 1.0)
    force = n * REPULSION / (square * np.sqrt(square))
    return (dx * force).sum(axis=1), (dy * force).sum(axis=1)


def _repelled(cells, fine: float, coarse: float):
    """fx and fy of pages (id, x, y) from the cells (row, column, pages, sum of x, sum of y)."""
    r, c, n, sx, sy = cells
    k = round(coarse / fine)
    big = (r // k) * 4096 + c // k
    names, group = np.unique(big, return_inverse=True)
    total = lambda v: np.bincount(group, weights=v, minlength=len(names))
    bn, bx, by = total(n), total(sx), total(sy)
    br, bc = names // 4096, names % 4096

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("id")
            x, y = (np.asarray(batch.column(a), np.float64) for a in "xy")
            row, col = (y // fine).astype(np.int64), (x // fine).astype(np.int64)
            fx, fy = np.zeros(len(x)), np.zeros(len(x))
            own = (row // k) * 4096 + col // k
            for cell in np.unique(own):  # pages of one large cell have the same neighbours
                at = np.flatnonzero(own == cell)
                near = (np.abs(br - cell // 4096) <= 1) & (np.abs(bc - cell % 4096) <= 1)
                far = ~near
                if far.any():
                    px, py = _push(x[at], y[at], bx[far] / bn[far], by[far] / bn[far], bn[far])
                    fx[at] += px
                    fy[at] += py
                close = near[group]
                mine = (r[close][None, :] == row[at][:, None]) & (c[close][None, :] == col[at][:, None])
                rest = n[close][None, :] - mine  # a page does not push itself
                some = np.maximum(rest, 1)
                cx, cy = (sx[close][None, :] - mine * x[at][:, None]) / some, (sy[close][None, :] - mine * y[at][:, None]) / some
                px, py = _push(x[at], y[at], cx, cy, rest)
                fx[at] += px
                fy[at] += py
            yield pa.RecordBatch.from_arrays([ids, pa.array(fx), pa.array(fy)], names=["id", "fx", "fy"])

    return run


def start(vertices: DataFrame) -> DataFrame:
    """id, x, y of ``vertices`` (id): a place on the canvas by a hash of the id."""
    share = lambda salt: F.pmod(F.xxhash64(F.lit(salt), "id"), F.lit(1_000_003)) / F.lit(1_000_003.0)
    return vertices.select("id", (F.lit(LEFT) + share(1) * (RIGHT - LEFT)).alias("x"), (F.lit(TOP) + share(2) * (BOTTOM - TOP)).alias("y"))


def layout(placed: DataFrame, edges: DataFrame, rounds: int = 30, fine: float = FINE, coarse: float = COARSE) -> DataFrame:
    """id, x, y after ``rounds`` from ``placed`` (id, x, y; ids once each), with links ``edges`` (src, dst); links to unknown ids pull nothing.

    A round is one aggregation to cells, one pass over the pages, and two joins of the links with the places of their ends.
    """
    state = cut(placed.select("id", "x", "y", F.lit(0.0).alias("vx"), F.lit(0.0).alias("vy")))
    edges = cut(edges.select("src", "dst"))
    for _ in range(rounds):
        grid = state.groupBy(F.floor(F.col("y") / fine).alias("r"), F.floor(F.col("x") / fine).alias("c")).agg(F.count("*").alias("n"), F.sum("x").alias("sx"), F.sum("y").alias("sy")).collect()
        if not grid:
            break
        cells = [np.array([row[k] for row in grid], np.float64 if k > 2 else np.int64) for k in range(5)]
        pushed = state.select("id", "x", "y").mapInArrow(_repelled(cells, fine, coarse), f"id {state.schema['id'].dataType.simpleString()}, fx double, fy double")
        at = lambda end: state.select(F.col("id").alias(end), F.col("x").alias(f"{end}_x"), F.col("y").alias(f"{end}_y"))
        ends = edges.join(at("src"), "src").join(at("dst"), "dst")
        dx, dy = F.col("dst_x") - F.col("src_x"), F.col("dst_y") - F.col("src_y")
        dist = F.greatest(F.sqrt(dx * dx + dy * dy), F.lit(1.0))
        pull = ends.select("src", "dst", (dx / dist * (dist - IDEAL) * ATTRACTION).alias("fx"), (dy / dist * (dist - IDEAL) * ATTRACTION).alias("fy"))
        pulled = pull.select(F.explode(F.array(F.struct(F.col("src").alias("id"), "fx", "fy"), F.struct(F.col("dst").alias("id"), (-F.col("fx")).alias("fx"), (-F.col("fy")).alias("fy")))).alias("p")).select("p.*")
        forces = pushed.unionByName(pulled).groupBy("id").agg(F.sum("fx").alias("fx"), F.sum("fy").alias("fy"))
        vx, vy = (F.col("vx") + F.col("fx")) * DAMPING, (F.col("vy") + F.col("fy")) * DAMPING
        moved = state.join(forces, "id").select("id", "x", "y", vx.alias("vx"), vy.alias("vy"))
        within = lambda v, lo, hi: F.greatest(F.least(v, F.lit(hi)), F.lit(lo))
        state = cut(moved.select("id", within(F.col("x") + F.col("vx"), LEFT, RIGHT).alias("x"), within(F.col("y") + F.col("vy"), TOP, BOTTOM).alias("y"), "vx", "vy"))
    return state.select("id", "x", "y")


def svg(placed: DataFrame, edges: DataFrame, depths: DataFrame) -> DataFrame:
    """part, id, line of an SVG map: a line a link, a dot and a label a page, coloured by ``depths`` (id, depth)."""
    none = F.lit(None).cast("string").alias("id")
    number = lambda c: F.format_string("%.1f", F.col(c))
    one = placed.sparkSession.range(1)
    head = one.select(F.lit(0).alias("part"), none, F.lit(f'<svg xmlns="http://www.w3.org/2000/svg" viewBox="0 0 {RIGHT + LEFT:.0f} {BOTTOM + TOP:.0f}">').alias("line"))
    at = lambda end: placed.select(F.col("id").alias(end), F.col("x").alias(f"{end}_x"), F.col("y").alias(f"{end}_y"))
    links = edges.join(at("src"), "src").join(at("dst"), "dst").select(F.lit(1).alias("part"), F.col("src").cast("string").alias("id"), F.concat(F.lit('<line stroke="#d1d5db" x1="'), number("src_x"), F.lit('" y1="'), number("src_y"), F.lit('" x2="'), number("dst_x"), F.lit('" y2="'), number("dst_y"), F.lit('"/>')).alias("line"))
    path = F.regexp_extract(F.col("id").cast("string"), "^[a-z]+://[^/]*(/.*)$", 1)
    label = F.when(path == "", F.when(F.col("id").cast("string").contains("://"), "/").otherwise(F.col("id").cast("string"))).when(F.length(path) > 30, F.concat(F.substring(path, 1, 29), F.lit("…"))).otherwise(path)
    color = F.element_at(F.array(*[F.lit(c) for c in DEPTH_COLORS]), F.least(F.coalesce("depth", F.lit(5)), F.lit(5)).cast("int") + 1)
    dots = placed.join(depths, "id", "left").select(F.lit(2).alias("part"), F.col("id").cast("string").alias("id"), F.concat(F.lit('<g><circle r="5" fill="'), color, F.lit('" cx="'), number("x"), F.lit('" cy="'), number("y"), F.lit('"/><text x="'), number("x"), F.lit('" y="'), number("y"), F.lit('">'), escape_html(label), F.lit("</text></g>")).alias("line"))
    tail = one.select(F.lit(3).alias("part"), none, F.lit("</svg>").alias("line"))
    return head.unionByName(links).unionByName(dots).unionByName(tail)


@query("crawl_map")
def crawl_map(spark, sf_dir):
    """Where every URL of the link graph stands after three rounds."""
    e = cut(graph.edges(graph.of(spark, sf_dir)))
    placed = layout(start(graph.vertices(e).withColumnRenamed("url", "id")), e, 3)
    return placed.select(F.col("id").alias("url"), F.round("x", 3).alias("x"), F.round("y", 3).alias("y"))
