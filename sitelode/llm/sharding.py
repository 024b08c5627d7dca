"""Sharding by weighted rendezvous hashing, in DataFrame functions only.

Each shard draws a number from (key, shard number); the shard whose draw, lifted by its weight,
is highest takes the record. Nothing else decides, so one more shard takes records only into
itself, and a removed shard's records are all that move.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import materialize, shuffle_partitions

#: Hex digits of the md5 that make a draw: 52 bits, exact in a double.
DIGITS = 13


def _hashed(text: Column) -> Column:
    return F.conv(F.substring(F.md5(text), 1, DIGITS), 16, 10).cast("long")


def _draw(key: Column, shard: Column) -> Column:
    """A number in [0, 2**52) from the record key and the shard number."""
    return _hashed(F.concat(key, F.lit(":"), shard.cast("string")))


def _score(key: Column, shard: Column, weight: Column) -> Column:
    unit = (_draw(key, shard).cast("double") + F.lit(0.5)) / F.lit(float(2 ** (4 * DIGITS)))
    return -weight / F.log(unit)


def rendezvous(key: Column, weights: Sequence[float], first: int = 0) -> Column:
    """struct(score, negated shard) of the winner among shards ``first ...``; ties go to the smaller number."""
    numbers = range(first, first + len(weights))
    shards = F.array(*[F.struct(F.lit(n).alias("n"), F.lit(float(w)).alias("w")) for n, w in zip(numbers, weights)])
    return F.array_max(F.transform(shards, lambda s: F.struct(_score(key, s["n"], s["w"]).alias("score"), (-s["n"]).alias("neg"))))


def record_key(column: Column) -> Column:
    """The key as text; a null key has a text of its own, so all such records share a shard."""
    return F.coalesce(column.cast("string"), F.lit("null"))


def assign_shards(
    docs: DataFrame,
    n_shards: int,
    weights: Sequence[float] | None = None,
    key: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """Deal records over ``n_shards`` shards and number them in each.

    Returns doc_id (the key), size, text_crc32, law (``key``), shard, slot (gapless from 0 in each
    shard) and grown_shard (the shard if there were one more, of weight 1).

    Null text counts as empty (size 16, crc32 0); null keys share one shard; repeated rows get slots
    of their own; an empty table gives no rows; other columns are ignored whatever their names.

    Slots need an order inside a shard, and a shard may be far larger than one task. So each shard is
    cut into cells, ranges of a hash of key, checksum and size (so a repeated key spreads too); cells
    are counted first, and a record's slot is its number in its cell plus the sizes of the cells
    before. Slots so follow the hash whatever the number of cells. Only the counts (shards times
    cells) are ever broadcast; the text never moves.
    """
    weights = [1.0] * n_shards if weights is None else list(weights)
    if len(weights) != n_shards or any(w <= 0 for w in weights):
        raise ValueError("one positive weight for each shard")
    spark = docs.sparkSession
    cells = 1 << max(3, (8 * shuffle_partitions(spark) // n_shards).bit_length())

    won, extra = rendezvous(F.col("_key"), weights), rendezvous(F.col("_key"), [1.0], n_shards)
    plain = F.coalesce(F.col("_text"), F.lit(""))
    rows = (
        docs.select(F.col(key).alias("_id"), F.col(text).alias("_text"))
        .select("_id", record_key(F.col("_id")).alias("_key"), (F.octet_length(plain) + F.lit(16)).cast("long").alias("_size"), F.crc32(plain.cast("binary")).cast("long").alias("_crc"))
        .select("_id", "_key", "_size", "_crc", won.alias("_won"), extra.alias("_extra"))
        .select(
            "_id",
            "_size",
            "_crc",
            (-F.col("_won.neg")).cast("int").alias("_shard"),
            F.when(F.col("_extra.score") > F.col("_won.score"), F.lit(n_shards)).otherwise(-F.col("_won.neg")).cast("int").alias("_grown"),
            _hashed(F.concat_ws(":", F.col("_key"), F.col("_crc").cast("string"), F.col("_size").cast("string"))).alias("_order"),
        )
        .withColumn("_cell", F.floor(F.col("_order") * F.lit(cells / 2 ** (4 * DIGITS))).cast("int"))
    )
    rows = materialize(rows, "shards")  # hashed once; a row is some 40 bytes
    counts = rows.groupBy("_shard", "_cell").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("_shard").orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("_shard", "_cell", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy("_shard", "_cell").orderBy("_order", "_id", "_crc", "_size")
    numbered = rows.withColumn("_at", F.row_number().over(inside) - F.lit(1))
    return numbered.join(F.broadcast(starts), ["_shard", "_cell"]).select(
        F.col("_id").alias("doc_id"),
        F.col("_size").alias("size"),
        F.col("_crc").alias("text_crc32"),
        F.lit("key").alias("law"),
        F.col("_shard").alias("shard"),
        (F.col("_start") + F.col("_at")).cast("long").alias("slot"),
        F.col("_grown").alias("grown_shard"),
    )


SHARDS = 40


def op1_sharding(spark, sf_dir: str) -> DataFrame:
    return assign_shards(spark.read.parquet(f"{sf_dir}/documents.parquet"), SHARDS)
