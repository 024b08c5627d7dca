"""A corpus pipeline of the operators in ``sitelode.llm``: documents in, training rows out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitelode.llm.decontaminate import decontaminate
from sitelode.llm.jaccard import keys_of, surplus
from sitelode.llm.langid import identify, sample_windows, train
from sitelode.llm.pieces import encode_pieces
from sitelode.llm.scratch import drop_scratch, materialize
from sitelode.llm.substrings import dedup_substrings

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: A language must reach this probability over a whole text.
SURE = 0.5


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents whose text has letters and a language that is surer than all others together.

    Trains on labelled documents of its own input; without any, nothing can be told and only texts
    without letters go.
    """
    windows, labels = sample_windows(docs)
    if not windows:
        return docs.select(COLUMNS).where(F.col("text").rlike(r"\p{L}"))
    out = identify(docs, train(windows, labels), COLUMNS)
    return out.where((F.col("lang_pred") != "und") & (F.col("score") >= SURE)).select(COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each class of near duplicates, that of the least doc_id.

    Rows are told apart by id and text: a repeated id with another text is another document, repeated rows
    and rows with a null doc_id (last in their class) count like all others.
    """
    marks = surplus(docs)
    keyed = keys_of(docs.select(COLUMNS))
    once = keyed.join(marks.hint("merge"), ["k", "h"], "left_anti").select(COLUMNS)  # marks grow with the documents
    repeated = marks.where("chosen")
    if repeated.isEmpty():
        return once
    # the key is one struct, not k and h, so that rows that repeat very often meet after partial aggregation
    rows = keyed.join(repeated.select("k", "h").hint("merge"), ["k", "h"], "left_semi").groupBy(F.struct("k", "h").alias("key"))
    one = rows.agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), *COLUMNS)).alias("one"))
    return once.unionByName(one.select([F.col(f"one.{c}").alias(c) for c in COLUMNS]))


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes out passages of 13 words or more that a document with a smaller doc_id has.

    Texts that lose nothing stay as they are; texts that lose every word go.
    """
    out = dedup_substrings(docs, COLUMNS)
    text = F.when(F.col("n_removed") == 0, F.col("text")).otherwise(F.col("kept_text"))
    return out.where("n_removed = 0 or n_removed < n_words").select("doc_id", text.alias("text"), "lang", "source", F.when(F.col("n_removed") == 0, F.col("n_chars")).otherwise(F.length("kept_text").cast("long")).alias("n_chars"))


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item's passages, in whatever order."""
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), COLUMNS).where(~F.col("contaminated")).select(COLUMNS)


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Adds the ids of a sampled segmentation of each text."""
    import public_tokenizers

    return encode_pieces(docs, public_tokenizers.path("piece_bpe_32k.model"), COLUMNS)


STAGES = [
    ("language ID", language),
    ("n-gram Jaccard join", near_duplicates),
    ("substring dedup", substrings),
    ("benchmark decontamination", benchmark),
    ("SentencePiece encoding", pieces),
]

#: Neither a trained network nor tiling nor sampling can be told in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        before, docs = docs, stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = materialize(docs, f"stage-{k}")
            drop_scratch(before)  # read for the last time
    return docs
