"""N-gram Jaccard join: a MinHash LSH forest, then exact verification.

A text's set is that of its runs of five words. Its signature in each tree is a sequence of up to eight
MinHash digits; two texts of similarity s agree on the first d digits of one tree with probability s**d.
All signatures of a tree, sorted, are a prefix trie: neighbours in that order share as many digits as any
two texts with as long a common prefix, so that the neighbours' common prefixes hold every node of the trie.

The join starts at the deepest prefixes. The neighbours that meet there, weighted by the chance to meet, tell
how similar the corpus's similar texts are (by the digits that their whole signatures share); matched prefixes
are then shortened to the longest at which the expected recall over those similarities reaches the target, and
so on until it stands. One more pair at the threshold is always assumed, so that little data leads to the
shortest prefixes.

A crowded node is never turned into pairs. Texts that nodes connect are compared in blocks bounded in texts
and bytes, by matrix products over the shingles they share, and what leaves a block is one row for each of
its texts: how much it is linked, and one link of a spanning forest.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .chunks import by_bytes, runs, utf8
from .components import components
from .scratch import drop_scratch, materialize, shuffle_partitions, written_tables
from .words import LETTERED, grams, lowered, mix, whole, words_of

SHINGLE = 5
#: Similarity from which two texts are linked, as a fraction so that the test is exact.
SIMILAR = (4, 5)
TREES, DEEPEST, RECALL = 20, 8, 0.9999
#: Texts and bytes that a block has at most; blocks of BLOCK texts up to SPREAD of them, larger ones from there on.
MOST_TEXTS, BLOCK_BYTES, BLOCK, SPREAD = 2048, 8 << 20, 64, 16
#: Links are counted by similarity in steps of 1 / STEPS.
STEPS = 100
_CHUNK = 1 << 20
_TILE = 4096
#: Texts on each side of one matrix product.
_SIDE = 2048


def found_at(similarity: float, depth: int, trees: int) -> float:
    """The chance that two texts share the first ``depth`` digits in some tree."""
    return 1 - (1 - similarity**depth) ** trees


def shortened(links: dict[int, int], depth: int, trees: int = TREES, recall: float = RECALL) -> int:
    """The longest prefix, up to ``depth``, with the target recall over the pairs that ``depth`` has shown.

    ``links``: pairs found at ``depth`` by similarity in steps of 1 / STEPS.
    """
    least = STEPS * SIMILAR[0] // SIMILAR[1]
    seen = {least: 1} | {k: n + (k == least) for k, n in links.items()}
    there = {k: n / found_at(k / STEPS, depth, trees) for k, n in seen.items()}
    for d in range(depth, 1, -1):
        if sum(n * found_at(k / STEPS, d, trees) for k, n in there.items()) >= recall * sum(there.values()):
            return d
    return 1


def shingles(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of all texts, one text after another; how many each has; words of each.

    A text of one to four words has one shingle, all its words.
    """
    w = words_of([lowered(t) for t in texts], LETTERED)
    ok = whole(w.counts, SHINGLE)
    keys = grams(w.hashes, SHINGLE)[ok]
    owner = np.repeat(np.arange(len(texts)), np.maximum(w.counts - SHINGLE + 1, 0))
    few = np.flatnonzero((w.counts > 0) & (w.counts < SHINGLE))
    if len(few):
        ends = np.cumsum(w.counts)
        short = np.array([np.bitwise_xor.reduce(grams(np.concatenate([w.hashes[ends[i] - w.counts[i] : ends[i]], np.zeros(1, np.uint64)]), int(w.counts[i]) + 1)) for i in few.tolist()], np.uint64)
        keys, owner = np.concatenate([keys, short]), np.concatenate([owner, few])
    order = np.lexsort((keys, owner))
    keys, owner = keys[order], owner[order]
    new = np.ones(len(keys), bool)
    new[1:] = (keys[1:] != keys[:-1]) | (owner[1:] != owner[:-1])
    return keys[new], np.bincount(owner[new], minlength=len(texts)), w.counts


def exact_shingles(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """As ``shingles``, but numbers that are equal for equal shingles alone."""
    w = words_of([lowered(t) for t in texts], LETTERED)
    ids = w.ids() + 1
    first = np.cumsum(w.counts) - w.counts
    few = np.flatnonzero((w.counts > 0) & (w.counts < SHINGLE))
    # short texts once more at the end, filled with zeros to a whole shingle
    tail = np.zeros(len(few) * SHINGLE, np.int64)
    tail[runs(np.arange(len(few)) * SHINGLE, w.counts[few])] = ids[runs(first[few], w.counts[few])]
    tokens = np.concatenate([ids, tail])
    many = np.maximum(w.counts - SHINGLE + 1, 0)
    at = np.concatenate([runs(first, many), len(ids) + np.arange(len(few)) * SHINGLE])
    owner = np.concatenate([np.repeat(np.arange(len(texts)), many), few])
    code = np.zeros(len(at), np.uint64)
    for k in range(SHINGLE):
        code = mix(code + tokens[at + k].astype(np.uint64))
    _, like, group = np.unique(code, return_index=True, return_inverse=True)
    if any((tokens[at + k] != tokens[at[like[group]] + k]).any() for k in range(SHINGLE)):
        group = tokens[at]
        for k in range(1, SHINGLE):
            _, group = np.unique(group * (int(tokens.max()) + 1) + tokens[at + k], return_inverse=True)
    order = np.lexsort((group, owner))
    group, owner = group[order], owner[order]
    new = np.ones(len(group), bool)
    new[1:] = (group[1:] != group[:-1]) | (owner[1:] != owner[:-1])
    return group[new], np.bincount(owner[new], minlength=len(texts))


def names(texts: list[bytes | None]) -> list[bytes | None]:
    """A 128-bit cryptographic hash of each text's word sequence; None without words."""
    w = words_of([lowered(t) for t in texts], LETTERED)
    lengths = w.ends - w.starts + 1
    data = w.data[runs(w.starts, lengths)]
    data[np.cumsum(lengths) - 1] = 0x20
    at = np.concatenate([[0], np.cumsum(lengths)])[np.concatenate([[0], np.cumsum(w.counts)])].tolist()
    raw = data.tobytes()
    return [hashlib.blake2b(raw[lo:hi], digest_size=16).digest() if hi > lo else None for lo, hi in zip(at[:-1], at[1:])]


def signatures(keys: np.ndarray, counts: np.ndarray, trees: int, depth: int) -> np.ndarray:
    """For each text (all have shingles) and tree, its first ``depth`` MinHash digits, of 16 bits each."""
    rng = np.random.default_rng(97)
    mult = rng.integers(1, 2**62, trees * depth).astype(np.uint64) * np.uint64(2) + np.uint64(1)
    plus = rng.integers(0, 2**62, trees * depth).astype(np.uint64)
    first = np.cumsum(counts) - counts
    out = np.empty((len(counts), trees * depth), ">u2")
    for k in range(trees * depth):
        h = keys * mult[k]
        h += plus[k]
        h ^= h >> np.uint64(32)
        h *= mult[k]
        out[:, k] = mix(np.minimum.reduceat(h, first)) >> np.uint64(48)
    return out.reshape(len(counts), trees, depth)


def _signed(trees: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = utf8(batch.column("x"))
            for lo, hi in by_bytes(texts, _CHUNK):
                part = texts[lo:hi]
                nodes = names(part)
                keys, counts, _ = shingles(part)
                some = np.flatnonzero(counts > 0)
                trie: list[bytes | None] = [None] * len(part)
                if len(some):
                    for i, row in zip(some.tolist(), signatures(keys, counts[some], trees, DEEPEST)):
                        trie[i] = row.tobytes()
                yield pa.RecordBatch.from_arrays([batch.column("k").slice(lo, hi - lo), batch.column("h").slice(lo, hi - lo), pa.array([len(t or b"") for t in part], pa.int64()), pa.array(nodes, pa.binary()), pa.array(trie, pa.binary())], names=["k", "h", "size", "node", "trie"])

    return run


_LEAF = "tree int, signature binary, node binary"
_PAIR = "a binary, b binary, shared int, heads array<binary>, tree int, signature binary"


def _leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if len(batch):
            raw = b"".join(batch.column("trie").to_pylist())
            trees = len(raw) // (2 * DEEPEST * len(batch))
            rows = pa.FixedSizeBinaryArray.from_buffers(pa.binary(2 * DEEPEST), trees * len(batch), [None, pa.py_buffer(raw)]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(np.tile(np.arange(trees, dtype=np.int32), len(batch))), rows, batch.column("node").take(pa.array(np.repeat(np.arange(len(batch)), trees)))], names=["tree", "signature", "node"])


def _neighbours(least: int):
    """Of a sorted part of the tries: neighbours that share ``least`` digits, and for each number of digits from there on the first text of their node; and both ends of the part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = heads = None
        depths = np.arange(least, DEEPEST + 1)
        for batch in batches:
            if not len(batch):
                continue
            tree, node = np.asarray(batch.column("tree")), batch.column("node")
            digits = np.frombuffer(b"".join(batch.column("signature").to_pylist()), ">u2").reshape(-1, DEEPEST)
            if before is None:
                yield _ends(batch.slice(0, 1))
                heads = node.take(pa.array(np.zeros(len(depths), np.int64)))
            else:
                tree, digits = np.append(before[0], tree), np.concatenate([before[1], digits])
                node = pa.concat_arrays([before[2], node])
            shared = np.minimum.accumulate(digits[1:] == digits[:-1], axis=1).sum(axis=1) * (tree[1:] == tree[:-1])
            # a node's first text: that at which fewer digits are shared, or one that an earlier batch has left
            opens = np.concatenate([np.zeros((1, len(depths)), bool), shared[:, None] < depths[None, :]])
            first = np.maximum.accumulate(np.where(opens, np.arange(len(opens))[:, None], 0), axis=0)
            pool = pa.concat_arrays([heads, node])
            first = np.where(first > 0, first + len(depths), np.arange(len(depths))[None, :])
            at = np.flatnonzero(shared >= least)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1) * len(depths), pa.int32()), pool.take(pa.array(first[at + 1].ravel())))
            yield pa.RecordBatch.from_arrays([node.take(pa.array(at)), node.take(pa.array(at + 1)), pa.array(shared[at].astype(np.int32)), lists, pa.nulls(len(at), pa.int32()), pa.nulls(len(at), pa.binary())], names=["a", "b", "shared", "heads", "tree", "signature"])
            heads = pool.take(pa.array(first[-1]))
            before, last = (tree[-1:], digits[-1:], node.slice(len(node) - 1)), batch.slice(len(batch) - 1)
        if before is not None:
            yield _ends(last)

    return run


def _ends(row: pa.RecordBatch) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([row.column("node"), pa.nulls(1, pa.binary()), pa.nulls(1, pa.int32()), pa.nulls(1, pa.list_(pa.binary())), row.column("tree"), row.column("signature")], names=["a", "b", "shared", "heads", "tree", "signature"])


def tries(texts: DataFrame, least: int) -> DataFrame:
    """a, b, shared, heads: neighbours in the sorted prefix tries of ``texts`` (node, trie), how many digits they share, and for
    each number of digits from ``least`` on the first text of b's node (null where two parts of the sort meet).

    The sort is by range of tree, signature and node, so a prefix that very many texts have is spread over
    tasks; where one part ends and the next begins, the two texts (one row for each end) are neighbours too.
    """
    parts = shuffle_partitions(texts.sparkSession)
    leaves = texts.select("node", "trie").mapInArrow(_leaves, _LEAF)
    pairs = materialize(leaves.repartitionByRange(parts, "tree", "signature", "node").sortWithinPartitions("tree", "signature", "node").mapInArrow(_neighbours(least), _PAIR), "tries")
    order = Window.partitionBy("tree").orderBy("signature", "a")
    digits = [F.substring("signature", 1, 2 * d) == F.substring(F.lag("signature").over(order), 1, 2 * d) for d in range(least, DEEPEST + 1)]
    ends = pairs.where("tree IS NOT NULL").select(F.lag("a").over(order).alias("a"), F.col("a").alias("b"), F.when(digits[0], sum(x.cast("int") for x in digits) + F.lit(least - 1)).alias("shared"))
    return pairs.where("tree IS NULL").select("a", "b", "shared", "heads").unionByName(ends.where("shared IS NOT NULL").withColumn("heads", F.lit(None).cast("array<binary>")))


def _alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The share of digits in which two signatures agree, in steps of 1 / STEPS rounded down."""
    for batch in batches:
        one, two = (np.frombuffer(b"".join(batch.column(c).to_pylist()), ">u2").reshape(len(batch), -1) if len(batch) else np.zeros((0, 1)) for c in ("ta", "tb"))
        yield pa.RecordBatch.from_arrays([batch.column("shared"), pa.array(((one == two).sum(axis=1) * STEPS // one.shape[1]).astype(np.int32))], names=["shared", "alike"])


def chosen_depth(texts: DataFrame, pairs: DataFrame, trees: int, recall: float) -> int:
    """How many digits must be shared for two texts to become candidates."""
    once = pairs.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.max("shared").alias("shared"))
    side = lambda c: texts.select(F.col("node").alias(c), F.col("trie").alias(f"t{c}"))
    seen = once.join(side("a"), "a").join(side("b"), "b").select("shared", "ta", "tb").mapInArrow(_alike, "shared int, alike int")
    found = [(r["shared"], r["alike"], r["n"]) for r in seen.where(F.col("alike") * SIMILAR[1] >= STEPS * SIMILAR[0]).groupBy("shared", "alike").agg(F.count(F.lit(1)).alias("n")).collect()]
    depth = DEEPEST
    while True:
        links: dict[int, int] = {}
        for shared, alike, n in found:
            if shared >= depth:
                links[alike] = links.get(alike, 0) + n
        last, depth = depth, shortened(links, depth, trees, recall)
        if depth == last:
            return depth


def groups_of(near: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Connected rows and columns of a matrix of links; each row and column is looked at once."""
    rows, columns = near.any(axis=1), near.any(axis=0)
    while rows.any():
        front = np.zeros(len(rows), bool)
        front[int(rows.argmax())] = True
        own_rows, own_columns = front.copy(), np.zeros(len(columns), bool)
        rows &= ~front
        while front.any():
            reached = near[front].any(axis=0) & columns
            columns &= ~reached
            own_columns |= reached
            front = near[:, reached].any(axis=1) & rows if reached.any() else np.zeros(len(rows), bool)
            rows &= ~front
            own_rows |= front
        yield np.flatnonzero(own_rows), np.flatnonzero(own_columns)


def linked(texts: list[bytes], copies: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Compare texts ``left`` with ``right`` (places in ``texts``; the same array: all pairs of it).

    Returns for each text the copies of all texts linked to it, and one place it is linked to in a
    spanning forest of the links (its own place for roots).
    """
    keys, counts = exact_shingles(texts)
    owner = np.repeat(np.arange(len(texts)), counts)
    _, column, times = np.unique(keys, return_inverse=True, return_counts=True)
    slot = np.cumsum(times > 1) - 1
    use = times[column] > 1
    row, col = owner[use], slot[column[use]]
    order = np.argsort(col, kind="stable")
    row, col = row[order], col[order]
    width = int(col[-1]) + 1 if len(col) else 0
    weight = np.zeros(len(texts), np.int64)
    root = list(range(len(texts)))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    def dense(side: np.ndarray, lo: int) -> np.ndarray:
        a, b = np.searchsorted(col, (lo, lo + _TILE))
        place = np.full(len(texts), -1)
        place[side] = np.arange(len(side))
        at = place[row[a:b]]
        m = np.zeros((len(side), min(_TILE, width - lo)), np.float32)
        m[at[at >= 0], col[a:b][at >= 0] - lo] = 1
        return m

    # pieces of fixed size, so that memory does not grow with the square of the texts
    for one, two in product(*([side[k : k + _SIDE] for k in range(0, len(side), _SIDE)] for side in (left, right))):
        inner = np.zeros((len(one), len(two)), np.float64)
        for lo in range(0, width, _TILE):
            inner += dense(one, lo) @ dense(two, lo).T
        both = inner.astype(np.int64)
        union = counts[one][:, None] + counts[two][None, :] - both
        near = (both * SIMILAR[1] >= union * SIMILAR[0]) & (union > 0) & (one[:, None] != two[None, :])
        np.add.at(weight, one, near @ copies[two])
        if left is not right:
            np.add.at(weight, two, near.T @ copies[one])
        # a forest edge for each text: the text whose tree it joined
        for rows, columns in groups_of(near):
            members = [*one[rows].tolist(), *two[columns].tolist()]
            x = find(members[0])
            for m in members[1:]:
                y = find(m)
                if x != y:
                    root[max(x, y)] = min(x, y)
                    x = min(x, y)
    return weight, np.array([find(i) for i in range(len(texts))])


def _verify(table: pa.Table) -> pa.Table:
    nodes = table.column("node").to_pylist()
    _, first = np.unique(np.array(nodes, object), return_index=True)  # rows that repeat id and text
    table = table.take(pa.array(np.sort(first)))
    nodes, texts = table.column("node").to_pylist(), utf8(table.column("x"))
    block = np.asarray(table.column("block"))
    copies = np.asarray(table.column("copies"), np.int64)
    one, two = table.column("one")[0].as_py(), table.column("two")[0].as_py()
    left = np.flatnonzero(block == one)
    right = left if one == two else np.flatnonzero(block == two)
    weight, root = linked(texts, copies, left, right)
    keep = np.flatnonzero(weight > 0)
    return pa.table({"node": pa.array([nodes[i] for i in keep], pa.binary()), "to": pa.array([nodes[root[i]] for i in keep], pa.binary()), "weight": pa.array(weight[keep], pa.int64())})


#: Sorts after every id; stands for null ids.
NO_ID = 2**63 - 1


def _compared(inner: DataFrame, texts: DataFrame, pairs: DataFrame) -> DataFrame:
    """All links among texts that ``pairs`` connect: node, to, weight."""
    members = materialize(components(pairs), "candidates")
    info = materialize(members.join(texts.drop("trie"), "node"), "members")
    blocks = F.greatest(F.ceil(F.col("n") / MOST_TEXTS), F.least(F.ceil(F.col("n") / BLOCK), F.lit(SPREAD)), F.ceil(F.col("bytes") / BLOCK_BYTES))
    sizes = materialize(info.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes")).select("label", blocks.cast("int").alias("blocks")), "sizes")
    placed = materialize(info.join(sizes, "label").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")).select("k", "h", "node", "copies", "label", "blocks", "block"), "placed")
    met = (
        inner.select(F.coalesce("k", F.lit(NO_ID)).alias("k"), "h", "x")
        .join(placed.hint("merge"), ["k", "h"])  # candidates grow with the texts
        .select("node", "copies", "label", "block", "x", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
        .select("node", "copies", "label", "block", "x", F.least("block", "other").alias("one"), F.greatest("block", "other").alias("two"))
    )
    found = materialize(met.groupBy("label", "one", "two").applyInArrow(_verify, "node binary, to binary, weight long"), "links")
    for t in (members, info, sizes, placed):
        drop_scratch(t)
    return found


def _grouped(docs: DataFrame, trees: int = TREES, recall: float = RECALL) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows with words (k, h, size, node, trie), rows without, and one row for each text: node, copies, k, h, label, weight."""
    inner = docs.select(F.col("doc_id").cast("long").alias("k"), F.xxhash64("text").alias("h"), F.col("text").alias("x"))
    signed = materialize(inner.mapInArrow(_signed(trees), "k long, h long, size long, node binary, trie binary"), "signed")
    lone, rows = signed.where("node is null"), signed.where("node is not null")

    # one row for each text: copies share their node
    picked = rows.groupBy("node").agg(F.min(F.struct(F.coalesce("k", F.lit(NO_ID)).alias("k"), "h", "size", "trie")).alias("one"), F.count(F.lit(1)).alias("copies"))
    texts = materialize(picked.select("node", "copies", "one.*"), "texts")
    least = shortened({}, DEEPEST, trees, recall)
    pairs = tries(texts, least)
    depth = chosen_depth(texts, pairs, trees, recall)
    head = F.coalesce(F.try_element_at("heads", F.lit(depth - least + 1)), F.col("a"))
    found = _compared(inner, texts, pairs.where(F.col("shared") >= depth).select(head.alias("a"), "b"))

    labels = materialize(components(found.select(F.col("node").alias("a"), F.col("to").alias("b"))), "labels")
    weights = materialize(found.groupBy("node").agg(F.sum("weight").alias("weight")), "weights")
    named = texts.select("node", "copies", "k", "h").join(labels, "node", "left").join(weights, "node", "left").select("node", "copies", "k", "h", F.coalesce("label", "node").alias("label"), F.coalesce("weight", F.lit(0)).alias("weight"))
    return rows, lone, materialize(named, "named")


def jaccard_classes(docs: DataFrame, trees: int = TREES, recall: float = RECALL) -> DataFrame:
    """doc_id, class_id and n_links for each document.

    Two documents are linked if the Jaccard similarity of their sets of five-word shingles is 0.8 or more;
    a class is what links connect, class_id its least doc_id, n_links a document's links, copies included.
    Words are runs of ASCII letters, digits and non-ASCII characters in lower case; a text of one to four
    words has one shingle.

    Null and wordless texts are linked to nothing: class_id is their own doc_id, n_links 0. Null ids never
    name a class (one of nothing else has a null class_id). Repeated rows are copies of each other; ids
    that repeat with other texts are other documents. An empty table gives no rows.

    At most ``1 - recall`` of the links are expected to be missed as candidates; the shortest prefixes miss
    no more of those at the threshold itself. Candidates are compared by their words' bytes.
    """
    with written_tables() as made:
        return _classes(docs, trees, recall, made)


def _classes(docs: DataFrame, trees: int, recall: float, made: list[DataFrame]) -> DataFrame:
    rows, lone, named = _grouped(docs, trees, recall)
    least = materialize(named.groupBy("label").agg(F.min("k").alias("least")), "least")
    classes = materialize(named.join(least, "label").select("node", F.when(F.col("least") < NO_ID, F.col("least")).alias("class_id"), (F.col("copies") - 1 + F.col("weight")).alias("n_links")), "classes")
    for t in made[1:-1]:  # the first has the rows, the last the classes
        drop_scratch(t)
    out = rows.select("k", "node").join(classes, "node").select(F.col("k").alias("doc_id"), "class_id", "n_links")
    return out.unionByName(lone.select(F.col("k").alias("doc_id"), F.col("k").alias("class_id"), F.lit(0).cast("long").alias("n_links")))


def keys_of(docs: DataFrame) -> DataFrame:
    """``docs`` with k and h, which say id and text: null ids as NO_ID, texts by a hash of 64 bits."""
    return docs.withColumns({"k": F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)), "h": F.xxhash64("text")})


def surplus(docs: DataFrame) -> DataFrame:
    """k, h, chosen for the rows that repeat others, by ``keys_of``: which to drop to keep one row of each class.

    A class keeps the least id, null ids last, and of an id's several texts that of the least hash; ids and
    texts of all its other rows are there with ``chosen`` false. Its own are there, with ``chosen`` true, only
    if several rows have them: all but one of those are to go. Rows in no class of several rows are not there.
    """
    with written_tables() as made:
        out = _surplus(docs)
    for t in made[:-1]:
        drop_scratch(t)
    return out


def _surplus(docs: DataFrame) -> DataFrame:
    rows, _, named = _grouped(docs)
    best = materialize(named.groupBy("label").agg(F.min(F.struct("k", "h")).alias("best"), F.sum("copies").alias("copies")).where("copies > 1").select("label", "best"), "best")
    several = materialize(named.select("node", "label").join(best, "label").select("node", "best"), "several")
    met = rows.select(F.coalesce("k", F.lit(NO_ID)).alias("k"), "h", "node").join(several, "node")
    marks = met.groupBy("k", "h").agg(F.max((F.col("k") == F.col("best.k")) & (F.col("h") == F.col("best.h"))).alias("chosen"), F.count(F.lit(1)).alias("n"))
    return materialize(marks.where("NOT chosen OR n > 1").select("k", "h", "chosen"), "surplus")


def op2_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return jaccard_classes(spark.read.parquet(f"{sf_dir}/documents.parquet"))
