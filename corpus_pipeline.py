"""A corpus pipeline: quality rules, exact and near deduplication, mixing to target weights, packing.

Each stage gets what the one before it has written. All but the last return the columns of documents.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexispark.cluster import ship
from lexispark.llm import crf, dartminhash, exact, mixing, packing
from lexispark.llm.common import discard, new_path, noting

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
#: Folders of the stage that was called last. They go when the next is called, as its documents are what the last has written.
_LEFT: list[str] = []


def staged(stage: Stage) -> Stage:
    @functools.wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        while _LEFT:
            discard(spark, _LEFT.pop())
        with noting(_LEFT):
            return stage(spark, docs, sf_dir)

    return run


@staged
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the line field reject go. The field learns from the labelled documents among docs."""
    return crf.keep_content(docs, crf.fit_field(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


@staged
def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts one stays."""
    return exact.drop_exact_duplicates(docs)


@staged
def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near-duplicates one document stays."""
    return dartminhash.drop_near_duplicates(docs)


@staged
def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them; where it takes part of one, those words."""
    mixed = mixing.mixed_documents(docs)
    return mixed.withColumn("n_chars", F.char_length("text").cast("long")) if "n_chars" in docs.columns else mixed


@staged
def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of documents in sequences of tokens, with their ids."""
    return packing.pack(docs)


STAGES: list[tuple[str, Stage]] = [("quality rules", quality), ("exact dedup", exact_dedup), ("near dedup", near_dedup), ("mixing", mix), ("packing", pack)]

#: The field's decoding, the tokenizer and the packing can't be said in SQL; a test holds run() against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, each written as Parquet and read again; what a stage has written on its way is deleted.

    Null and repeated ids, null, empty and very long texts, ties, empty tables and further columns go through every stage as
    its operator defines; a document without a word ends at the quality rules.
    """
    ship(spark)
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        path = new_path(spark, name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        if before:
            discard(spark, before)
        docs, before = spark.read.parquet(path), path
    while _LEFT:
        discard(spark, _LEFT.pop())
    return docs


QUERIES = {"pipeline": run}
QUERY_SQL = {"pipeline": ORACLE_SQL}
