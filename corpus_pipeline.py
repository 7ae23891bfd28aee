"""A corpus pipeline of five stages: each works on what the one before kept, written as Parquet and read again."""
from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chorale.llm import packing, quality, simhash, substrings, toxicity
from chorale.llm.common import settings, table
from chorale.llm.queries import vocabulary
from chorale.session import shared_folder


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, fitted on the labelled documents among them, predicts good."""
    settings(spark)
    return quality.keep_good(docs, quality.fit(docs, table(spark, sf_dir, "labels", "doc_id", "quality"), F.lit(True)))


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity grammar, fitted on the labelled documents among them, does not reject."""
    settings(spark)
    return toxicity.keep_clean(docs, toxicity.fit(docs, table(spark, sf_dir, "labels", "doc_id", "toxic"), F.lit(True)))


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, the one with the smallest id; documents without an id come last and are not lost."""
    settings(spark)
    return simhash.keep_one(docs)


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without passages of 13 words and more that stand in a document with a smaller id."""
    settings(spark)
    return substrings.rewrite_documents(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents with their places in sequences."""
    settings(spark)
    return packing.pack(docs, vocabulary("word_bpe_49k.json"))


STAGES = [("quality", quality_stage), ("toxicity", toxicity_stage), ("simhash", simhash_stage), ("substrings", substring_stage), ("packing", packing_stage)]

#: Fitted models and fingerprints are beyond SQL; tests/llm compares the stages with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. Every stage writes below the folder that the cluster names for checkpoints; the folder is left to whoever reads the result."""
    docs, folder = spark.read.parquet(f"{sf_dir}/documents.parquet"), os.path.join(shared_folder(spark), f"pipeline-{uuid.uuid4().hex}")
    for name, stage in STAGES:
        path = f"{folder}/{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
