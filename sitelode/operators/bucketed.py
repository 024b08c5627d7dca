"""Crawls kept in buckets by URL, so that comparing two of them shuffles nothing."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import history
from ..plans.scratch import shared_folder
from ..registry import query

COLUMNS = ["page_id", "url", "title", "word_count", "html_bytes"]
BUCKETS = 32


def stored(crawl: DataFrame, name: str, buckets: int = BUCKETS, folder: str | None = None) -> DataFrame:
    """Write a crawl (COLUMNS; of a URL the row of the least page_id) as table ``name`` in buckets by URL, and read it.

    All crawls of a store need the same number of buckets. Rows are dealt by URL before they are written, so a bucket is one sorted file.
    """
    spark = crawl.sparkSession
    first = crawl.select(COLUMNS).groupBy("url").agg(F.min_by(F.struct("page_id", "title", "word_count", "html_bytes"), "page_id").alias("r")).select("r.page_id", "url", "r.title", "r.word_count", "r.html_bytes")
    place = f"{folder or shared_folder(spark)}/{name}"
    first.repartition(buckets, "url").write.bucketBy(buckets, "url").sortBy("url").option("path", place).mode("overwrite").saveAsTable(name)
    return spark.table(name)


def compared(spark: SparkSession, base: str, later: str) -> DataFrame:
    """url, change between two stored crawls (tables of ``stored``, of one catalog or two): a merge of their buckets, without an exchange."""
    return history.diff(spark.table(base), spark.table(later))


@query("compare_stored", f"{history._TWO} SELECT url, unnest({history._KIND}) AS change FROM j")
def compare_stored(spark, sf_dir):
    """Two crawls, written to a store each and compared from there."""
    names = []
    for crawl, side in zip(history.crawls(spark, sf_dir), ("base", "later")):
        names.append(f"crawl_{side}_{uuid.uuid4().hex}")
        stored(crawl, names[-1])
    return compared(spark, *names)
