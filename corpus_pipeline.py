"""A training corpus from documents: language, near copies, repeated passages, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a table; written as Parquet and read again, it
is the next one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm import langid, mixing, near_dedup, packing, substring_dedup
from gridloom.llm.queries import WEIGHTS
from gridloom.llm.scratch import Scratch

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts of no language (null, or without a letter) go, also where no row has a lang to learn from."""
    return langid.keep_identified(docs, langid.train(docs)).select(*COLUMNS)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the least doc_id stays."""
    return near_dedup.keep_one(docs, Scratch(spark, "near")).select(*COLUMNS)


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that an earlier document has are cut out; a text of which nothing is left goes."""
    rows = substring_dedup.remove_repeats(docs, Scratch(spark, "passages")).where("n_removed = 0 or n_removed < n_words")
    return rows.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in the order of the mix."""
    return mixing.mixed(docs, WEIGHTS).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences, which follow the mix: each shard is a range of it, and sequence_id grows from range to range.

    Files don't keep the order of rows (a reader puts them together by size), so it is made again
    from the schedule, which depends on the rows alone. Within a shard (a partition, or its next
    131,072 documents) sequences are in the order of packing.
    """
    return packing.pack(mixing.mixed(docs.select("doc_id", "text", "source"), WEIGHTS))


STAGES = [("language_id", language), ("near_dedup", near_copies), ("substring_dedup", passages), ("mixing", mix), ("packing", pack)]

#: Training, signatures and tokens can't be written in SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents of sf_dir; what a stage returns is written and read again."""
    docs, scratch = spark.read.parquet(f"{sf_dir}/documents.parquet"), Scratch(spark, "pipeline")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = scratch.keep(docs, name)
            if k:
                scratch.drop(STAGES[k - 1][0])
    return docs
