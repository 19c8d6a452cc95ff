"""From documents to training tokens, in five stages. Each stage is written as Parquet and read
again as the next one's input; all but the last return the columns of documents.

Every stage takes documents with doc_id and text (quality rules lang and source as well) and any
further columns, whatever their names, and hands these on unchanged. A null text is an empty one:
it fails the quality rules, and later stages would let it pass. Null lang and source are values of
their own, rows without doc_id come last in the order of lines and are linked by text only. Repeated
rows share their verdict. Empty tables give empty tables.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryline.llm import bpe, decontam, linededup, neardup, quality
from quarryline.llm.common import remove, scratch, shared_dir


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that quality.quality() rejects go."""
    return quality.keep_good(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that equal or nearly equal an earlier one go, and documents that they made up wholly.
    A column n_chars, if there is one, follows the text."""
    left = linededup.dedup_lines(docs, drop_emptied=True)
    if "n_chars" not in docs.columns:
        return left
    return left.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (similarity 0.8 or more) stays, the one with
    the smallest doc_id."""
    return neardup.keep_one(docs, percent=80, width=5)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which benchmark windows of 13 words cover a twentieth or more go."""
    return decontam.remove_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, with digests of them and of the text decoded from them."""
    return bpe.digests(docs, public_tokenizers.path("byte_bpe_50k.json"), ids=True)


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("bpe", encode),
]

#: The outlier estimate is iterative; tests/llm/test_pipeline.py compares with brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order, from the table documents. A stage's rows are deleted when the next one's are written; those of
    the last but one stay, as the result reads them."""
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for _, stage in STAGES[:-1]:
        path = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
        with scratch(spark):
            stage(spark, docs, sf_dir).write.option("compression", "zstd").parquet(path)
        docs = spark.read.parquet(path)
        if last:
            remove(spark, last)
        last = path
    return STAGES[-1][1](spark, docs, sf_dir)
