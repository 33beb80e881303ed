"""Training-text pipeline: each stage applies one operator to all that the stage before it kept.

Language ID drops documents it rejects, exact de-duplication and SimHash leave one document of each
group, decontamination drops documents with a benchmark item, and the last stage encodes the rest.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from brandsieve.llm import bpe, decontam, exact_dedup, langid, near_copies
from brandsieve.llm.common import shared_folder
from brandsieve.llm.queries import tokenizer_path
from brandsieve.sources.files import remove


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return langid.keep_identified(docs)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.dedup(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_copies.keep_representatives(docs)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.digests(bpe.encode(docs, tokenizer_path()))


STAGES = [
    ("language ID", keep_known_languages),
    ("exact dedup", drop_exact_copies),
    ("SimHash near-dedup", drop_near_copies),
    ("benchmark decontamination", drop_benchmark_leaks),
    ("BPE encoding and decoding", encode),
]

#: A trained language model and distances between passages have no form in SQL; tests hold the stages
#: against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again by the next.

    The tables between stages go to the folder of reliable checkpoints, which all executors share. Each is
    removed once the next one is written; the last stage reads the last one, which stays for its reader.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for number, (_, stage) in enumerate(STAGES[:-1]):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{number}")
        docs = spark.read.parquet(f"{folder}/{number}")
        if number:
            remove(spark, f"{folder}/{number - 1}")
    return STAGES[-1][1](spark, docs, sf_dir)
