"""A corpus pipeline of the numbered operators. Each stage's result is written as Parquet and reread as the next one's docs.

language: documents without any language (no letters, or no text) go.
exact: of texts that are equal without white space, one document stays.
near: of documents linked by a Jaccard index of 5-word shingles of 0.75 or more, one stays.
mix: sources by target weights; a row for each round in which a document's words are taken.
encode: token counts and digests of the ids and of the decoded text.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from factorloom.llm import bpe, exact_dedup, langid, minhash, mixing
from factorloom.llm.common import documents, shared_dir


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return langid.keep_known(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.kept_documents(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash.kept_documents(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.digests(docs)


STAGES = [("language", language), ("exact_dedup", exact), ("near_dedup", near), ("mix", mix), ("encode", encode)]
#: Signatures, draws and token ids have no SQL form; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
