"""Shared scratch tables: how a job here cuts lineage."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def scratch_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where it is unset a folder is chosen: a temporary one in local mode (tests), else one
    beside the warehouse, which a cluster shares.
    """
    conf = spark.sparkContext.getConf()
    found = spark.conf.get("spark.checkpoint.dir", None) or conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if conf.get("spark.master", "").startswith("local"):
        made = tempfile.mkdtemp(prefix="sitelode-")
    else:
        made = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"
    spark.conf.set("spark.checkpoint.dir", made)
    return made


@contextmanager
def _frees_shuffles(spark: SparkSession):
    """Shuffle files of a job that ends in a written table are of no more use, so Spark may drop them then."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


#: Lists of the tables written since each open ``written_tables``.
_records: list[list[DataFrame]] = []


@contextmanager
def written_tables():
    """The tables that ``materialize`` writes inside, as a list."""
    made: list[DataFrame] = []
    _records.append(made)
    try:
        yield made
    finally:
        _records.pop()


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to a new Parquet table in the shared folder and return a scan of it.

    Reading it again never needs what made it, so lost executors cost only the scan.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    with _frees_shuffles(spark):
        df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    for made in _records:
        made.append(out)
    return out


def drop_scratch(df: DataFrame) -> None:
    """Delete a table that ``materialize`` wrote and that no later step reads."""
    path = getattr(df, "_scratch_path", None)
    if path:
        spark = df.sparkSession
        jvm = spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
