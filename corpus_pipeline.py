"""A corpus pipeline over `documents`: each stage applies one operator to all that the one before it kept.

A stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the
next stage's docs. All stages but the last return the columns of `documents`; the last returns the packed
pieces of the documents that are left.

Every stage takes an empty table and gives an empty one; null and empty texts pass all stages and are packed as
their end alone; rows that are repeated whole leave the second stage once; further columns, whatever their names,
pass all stages but the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from millrace.llm import anchors, common, jaccard, packing, quality


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: documents that the classifier rejects go. Labels are those of documents that are here."""
    return quality.keep_selected(docs, common.table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: of each group of linked documents the one with the smallest id stays."""
    return jaccard.keep_one(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: passages of 50 words and more that a document with a smaller id has go from the text."""
    return anchors.without_repeats(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: the rest as sequences of at most 4096 tokens."""
    return packing.pack_documents(docs)


STAGES = [("quality_classifier", quality_classifier), ("near_duplicates", near_duplicates), ("repeated_passages", repeated_passages), ("pack", pack)]

#: A fitted classifier has no SQL; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, last = common.table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        docs, done = common.written(stage(spark, docs, sf_dir), f"pipeline-{name}"), last
        if done is not None:
            common.drop_written(done)  # the stage that read it has been written
        last = docs
    return docs
