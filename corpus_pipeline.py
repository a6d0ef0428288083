"""Corpus pipeline: five stages from raw documents to encoded training text.

Every stage takes any rows: null texts are empty ones, repeated rows are rows of their own, columns beside those of
documents are carried by all stages but the last, whatever their names, and an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellweave.llm import cotrain_quality, pivotal_mix, suffix_merge_dedup, suffix_sentencepiece, tensor_minhash
from cellweave.llm.common import Stages


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier keeps; each row is judged by itself.  Without labels all stay, with labels of
    one class all or none; null metadata are values of their own."""
    return cotrain_quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that shares four fifths of its five-word shingles, that with the smallest doc_id.

    Documents without words stay; of rows that repeat a doc_id with the same text one stays; in a group with other ids a
    row with a null doc_id goes.
    """
    return tensor_minhash.deduplicate(docs, width=5, percent=80)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages of 200 bytes or more that occur more than once; sizes follow.

    A document of such passages alone stays with an empty text.  Null texts stay null.
    """
    cut = suffix_merge_dedup.cut_repeats(docs)
    text = F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col("text"))
    size = F.length(text).cast(docs.schema["n_chars"].dataType)
    return cut.withColumns({"text": text, "n_chars": F.when(F.col("n_removed") > 0, size).otherwise(F.col("n_chars"))}).select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, three times at most; documents without words have no size and are not taken.

    A null source is a source of its own.
    """
    return pivotal_mix.mix(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of each document, and whether they decode to its text; null doc_ids, languages and sources are carried."""
    return suffix_sentencepiece.encode(docs, keep=("doc_id", "lang", "source"))


STAGES = [
    ("quality classifier", quality),
    ("minhash near-dedup", near_duplicates),
    ("suffix-array dedup", repeats),
    ("source mixing", mix),
    ("sentencepiece encoding", encode),
]

#: SQL expresses neither the classifier nor the suffix sort; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    stages = Stages(spark, "pipeline")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = stages.save(docs, name.replace(" ", "-"))
    return docs
