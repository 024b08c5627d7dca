import zlib
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from sitelode.llm.sharding import assign_shards


def test_slots_sizes_and_checksums(docs, corpus):
    rows = assign_shards(docs, 5).collect()
    assert len(rows) == len(corpus)
    want = Counter((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in corpus)
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in rows) == want
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
        assert r.law == "key" and (r.grown_shard == r.shard or r.grown_shard == 5)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_one_more_shard_is_the_grown_shard(spark):
    ids = spark.range(2000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"))
    small = {r.doc_id: r for r in assign_shards(ids, 7).collect()}
    large = {r.doc_id: r.shard for r in assign_shards(ids, 8).collect()}
    assert all(small[i].grown_shard == large[i] for i in small)
    moved = sum(small[i].shard != large[i] for i in small)
    assert 150 < moved < 350


def test_weights_draw_their_share(spark):
    ids = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit(None).cast("string").alias("text"))
    n = Counter(r.shard for r in assign_shards(ids, 3, [1.0, 1.0, 2.0]).collect())
    assert abs(n[2] - 2000) < 150 and abs(n[0] - 1000) < 120


def test_slots_do_not_depend_on_partitions(spark, docs):
    def run(n):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        return sorted(map(repr, assign_shards(docs, 3).collect()))

    try:
        assert run("2") == run("60")
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_empty(nothing):
    assert assign_shards(nothing, 4).count() == 0
