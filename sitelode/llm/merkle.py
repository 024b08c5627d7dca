"""Merkle manifest of a dataset: large blocks reduced on executors, a small top tree on the driver.

Every row is a leaf. Leaves of a group stand in the order of their key; while a group has several nodes,
every eight consecutive ones become their digest, up to the group's subroot. The subroots, in the order of
the groups, are joined the same way up to the root.

Rows get their places from one range-partitioned sort of digests (texts never move). Blocks of 8**LEVELS
leaves are then packed and reduced, each in one task, whatever the size of their group. What is left, one
digest a block, goes to the driver if it is small enough, else through another round of blocks. The driver
builds the top tree and broadcasts each block's path to the root; tasks read the packed blocks again,
finish every row's proof with it, and fold every row's leaf up to a root of its own.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import drop_scratch, materialize, shuffle_partitions

#: Nodes that become one.
RUN = 8
#: Levels that one task reduces: a block has RUN**LEVELS nodes at most.
LEVELS = 4
#: Nodes at most that the driver takes, and paths that it broadcasts (some 2 KB each).
TOP = 4096
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: left and right siblings of a node, level by level
Path = list[tuple[str, str]]
_PATH = "left array<string>, right array<string>"
_PACKED = "g string, block long, n long, node string, name array<string>, id array<long>, nodes array<string>, altered array<string>"


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(values: Iterable[Column]) -> Column:
    """The digest of a row: each value as its UTF-8 byte count, a colon and itself, a null as a dash."""

    def framed(c: Column) -> Column:
        s = c.cast("string")
        return F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-"))

    return F.sha2(F.concat(*map(framed, values)).cast("binary"), 256)


def levels_of(n: int) -> int:
    """Levels from ``n`` nodes up to one."""
    k = 0
    while n > 1:
        n, k = -(-n // RUN), k + 1
    return k


def reduced(nodes: list[str], levels: int) -> list[list[str]]:
    """The nodes of each level, from the lowest up."""
    out = [nodes]
    for _ in range(levels):
        nodes = [digest("".join(nodes[i : i + RUN])) for i in range(0, len(nodes), RUN)]
        out.append(nodes)
    return out


def path_of(levels: list[list[str]], i: int) -> Path:
    """The siblings on the way from node ``i`` of the lowest level to the highest."""
    out = []
    for nodes in levels[:-1]:
        start = i - i % RUN
        out.append(("".join(nodes[start:i]), "".join(nodes[i + 1 : start + RUN])))
        i //= RUN
    return out


def fold(node: str, path: Iterable[tuple[str, str]]) -> str:
    for left, right in path:
        node = digest(left + node + right)
    return node


def _block(most: int):
    def run(table: pa.Table) -> pa.Table:
        """All nodes of a block, in order, and what they become in ``most`` levels."""
        table = table.sort_by("pos")
        n, nodes = table.column("n")[0].as_py(), table.column("node").to_pylist()
        top = reduced(nodes, min(most, levels_of(n)))[-1][0]
        columns = [table.column(c).to_pylist() for c in ("name", "id", "node", "altered")]
        kept = [[c] if any(v is not None for v in c) else [None] for c in columns]
        types = [pa.list_(t) for t in (pa.string(), pa.int64(), pa.string(), pa.string())]
        first = [table.column(c).slice(0, 1).combine_chunks() for c in ("g", "block")]
        return pa.Table.from_arrays([*first, pa.array([n], pa.int64()), pa.array([top]), *(pa.array(c, t) for c, t in zip(kept, types))], names=["g", "block", "n", "node", "name", "id", "nodes", "altered"])

    return run


def _packed(nodes: DataFrame, name: str, levels: int) -> DataFrame:
    """One row a block: ``nodes`` has g, pos, n (nodes of its group), node, name, id and altered."""
    blocks = nodes.withColumn("block", F.expr(f"pos div {RUN**levels}"))
    return materialize(blocks.groupBy("g", "block").applyInArrow(_block(levels), _PACKED), name)


def _numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` with pos, the place in their group g by ``order``, and n, the rows of the group.

    One range-partitioned sort; groups are cut wherever partitions end, and repeated rows part by their
    serial number, so that no group or key needs to fit in a task.
    """
    by = ["g", *order, "serial"]
    sort = [F.col(c).asc_nulls_first() for c in by]
    ranges = rows.repartitionByRange(shuffle_partitions(rows.sparkSession), *sort).sortWithinPartitions(*sort)
    ranges = materialize(ranges.withColumn("at", F.monotonically_increasing_id()), "merkle-order").withColumn("part", F.shiftright("at", 33))
    counts = ranges.groupBy("g", "part").agg(F.min("at").alias("low"), F.count(F.lit(1)).alias("rows"))
    group = Window.partitionBy("g")
    before = group.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("g", "part", "low", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("start"), F.sum("rows").over(group).alias("n"))
    # a row for each partition and each group: Spark broadcasts it only if it is small
    return ranges.join(starts, ["g", "part"]).withColumn("pos", F.col("start") + F.col("at") - F.col("low"))


def _top_paths(rows: list, forest: bool) -> dict[tuple[str, int], tuple[Path, str | None, str]]:
    """For each block its path to the root, the subroot (unless known from below) and the root."""
    groups: dict[str, list] = {}
    for r in sorted(rows, key=lambda r: (r["g"].encode(), r["block"])):
        groups.setdefault(r["g"], []).append(r["node"])
    trees = {g: reduced(nodes, levels_of(len(nodes))) for g, nodes in groups.items()}
    over = [] if forest else reduced([t[-1][0] for t in trees.values()], levels_of(len(trees)))
    out = {}
    for k, (g, tree) in enumerate(trees.items()):
        above = [] if forest else path_of(over, k)
        for i in range(len(tree[0])):
            root = tree[-1][0] if forest else over[-1][0]
            out[g, i] = (path_of(tree, i) + above, None if forest else tree[-1][0], root)
    return out


def _suffixes(batch: pa.RecordBatch, paths) -> Iterator[tuple[Path, str | None, str]]:
    """The path from each packed block of a batch to the root: broadcast, or joined to its row."""
    if paths is not None:
        yield from (paths.value[key] for key in zip(batch.column("g").to_pylist(), batch.column("block").to_pylist()))
    else:
        for left, right, sub, root in zip(*(batch.column(c).to_pylist() for c in ("left", "right", "subroot", "root"))):
            yield list(zip(left, right)), sub, root


def _inner(batch: pa.RecordBatch, most: int) -> Iterator[tuple[list[list[str]], dict]]:
    for row in batch.select(["g", "block", "n", "node", "name", "id", "nodes", "altered"]).to_pylist():
        yield reduced(row["nodes"], min(most, levels_of(row["n"]))), row


def _downward(paths, most: int):
    """For each node of an upper block, which is a block of the round below, its path to the root."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for (levels, row), (above, sub, root) in zip(_inner(batch, most), _suffixes(batch, paths)):
                own = [path_of(levels, i) + above for i in range(len(row["nodes"]))]
                n = len(own)
                named = row["name"] is not None  # nodes of the forest: a group each, which is one block
                first = row["block"] * RUN**most
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(row["name"] if named else [row["g"]] * n, pa.string()),
                        pa.array([0] * n if named else range(first, first + n), pa.int64()),
                        pa.array([[x for x, _ in p] for p in own], pa.list_(pa.string())),
                        pa.array([[y for _, y in p] for p in own], pa.list_(pa.string())),
                        pa.array(row["nodes"] if named else [sub] * n, pa.string()),
                        pa.array([root] * n, pa.string()),
                    ],
                    names=["g", "block", "left", "right", "subroot", "root"],
                )

    return run


_RESULT = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def _finished(paths, most: int, with_proofs: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for (levels, row), (above, sub, root) in zip(_inner(batch, most), _suffixes(batch, paths)):
                nodes = row["nodes"]
                n = len(nodes)
                altered = row["altered"] or [None] * n
                own = [path_of(levels, i) + above for i in range(n)]
                proofs = [digest("".join(x + y for x, y in p)) for p in own]
                roots = [fold(new or node, p) for node, new, p in zip(nodes, altered, own)]
                out = [pa.array(row["id"] or [None] * n, pa.int64()), pa.array(nodes), pa.array([sub] * n, pa.string()), pa.array([root] * n), pa.array(proofs), pa.array(roots), pa.array([r == root for r in roots])]
                names = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
                if with_proofs:
                    out += [pa.array([[x for x, _ in p] for p in own], pa.list_(pa.string())), pa.array([[y for _, y in p] for p in own], pa.list_(pa.string()))]
                    names += ["left", "right"]
                yield pa.RecordBatch.from_arrays(out, names=names)

    return run


def manifest(docs: DataFrame, altered: dict[str, Column] | None = None, where: Column | None = None, key: str = "doc_id", group: str = "lang", fields: Iterable[str] = FIELDS, with_proofs: bool = False, levels: int = LEVELS, top: int = TOP) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root and verified for every row of ``docs``.

    A leaf is the digest of ``fields``. ``altered`` replaces columns of the rows that meet ``where``: their
    folded_root starts from the leaf of the replaced values, all others' from their own, both with the
    siblings of the untouched tree. ``proof_sha256`` is the digest of a row's siblings, level by level,
    left to right; ``with_proofs`` adds them as left and right, one string of digests a level each.

    Groups are ordered by their UTF-8 bytes with null first, rows of a group by ``key``, null first, and
    rows that share it by their leaf, so repeated rows are leaves each. A null group is a group; null and
    empty values differ. A single row is leaf, subroot and root with an empty proof. An empty table gives
    no rows. Other columns are ignored, whatever their names.

    A task reduces ``levels`` levels. The driver and the broadcast hold ``top`` nodes at most; more blocks,
    or more groups, go through further rounds of blocks on the executors.
    """
    spark = docs.sparkSession
    values = {c: F.col(c) for c in fields}
    rows = docs.select(
        F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit("-")).alias("g"),
        F.col(key).cast("long").alias("id"),
        leaf(values.values()).alias("node"),
        F.when(where, leaf((values | altered).values())).alias("altered") if altered else F.lit(None).cast("string").alias("altered"),
    )
    rows = materialize(rows.withColumn("serial", F.monotonically_increasing_id()), "merkle-leaves")
    leaves = _numbered(rows, ["id", "node"])
    blank = F.lit(None)
    rounds = [_packed(leaves.withColumn("name", blank.cast("string")), "merkle-blocks", levels)]
    drop_scratch(rows)
    forest = False
    while rounds[-1].count() > top:
        last = rounds[-1].select("g", "block", "n", "node")
        extra = {"id": blank.cast("long"), "altered": blank.cast("string")}
        if not forest and last.where(F.col("n") > RUN**levels).isEmpty():
            # every group is one node: their order is that of the leaves of one more tree
            forest = True
            roots = materialize(last.select(F.lit("").alias("g"), F.col("g").alias("name"), "node", F.lit(0).cast("long").alias("serial")), "merkle-subroots")
            nodes = _numbered(roots, ["name"]).withColumns(extra)
        else:
            nodes = last.select("g", F.col("block").alias("pos"), F.expr(f"(n + {RUN**levels - 1}) div {RUN**levels}").alias("n"), "node", blank.cast("string").alias("name")).withColumns(extra)
        rounds.append(_packed(nodes, "merkle-blocks", levels))
    paths = spark.sparkContext.broadcast(_top_paths(rounds[-1].select("g", "block", "node").collect(), forest))
    blocks = rounds[-1]
    for below in reversed(rounds[:-1]):
        suffixes = materialize(blocks.mapInArrow(_downward(paths, levels), f"g string, block long, {_PATH}, subroot string, root string"), "merkle-paths")
        blocks, paths = below.join(suffixes, ["g", "block"]), None
    return blocks.mapInArrow(_finished(paths, levels, with_proofs), _RESULT + (f", {_PATH}" if with_proofs else ""))


def op13_merkle_manifest(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    lower = F.translate(F.col("text"), _UPPER, _UPPER.lower())
    third = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    return manifest(docs, {"text": lower}, third)
