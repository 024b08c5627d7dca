"""Connected components by alternating large and small stars, each round a written table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import drop_scratch, materialize


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Hang the neighbours of each node on the least of them: the larger ones, or the smaller ones and itself."""
    if large:
        pairs = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    else:
        pairs = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    # written, so that the join below has two plain sides and a crowded node can be split
    least = materialize(pairs.groupBy("u").agg(F.min("v").alias("m")), "least")
    met = pairs.join(least, "u").select("u", "v", F.least("u", "m").alias("m"))
    if large:
        out = met.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        out = met.select(F.explode(F.array(F.struct(F.col("u").alias("a"), F.col("m").alias("b")), F.struct(F.col("v").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.a", "e.b")
    made = materialize(out.where("a != b").distinct(), "star")
    drop_scratch(least)
    return made


def _state(edges: DataFrame):
    r = edges.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x")).first()
    return r["n"], r["x"]


def components(edges: DataFrame) -> DataFrame:
    """(a, b) pairs -> (node, label) for each node of an edge; the label is the least node connected with it.

    Self-links and repeated or reversed pairs change nothing; pairs with a null are left out. Rounds go
    on until the edges stay as they are; nothing but their number and checksum reaches the driver.
    """
    now = materialize(edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = _state(now)
    while before[0]:
        large = _star(now, True)
        small = _star(large, False)
        drop_scratch(now)
        drop_scratch(large)
        now, after = small, _state(small)
        if after == before:
            break
        before = after
    roots = now.select(F.col("b").alias("node")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(roots.select("node", F.col("node").alias("label")))
