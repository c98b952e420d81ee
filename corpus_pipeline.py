"""A corpus pipeline: each stage takes what its predecessor kept and returns documents; the last returns digests of token ids.

Order: quality rules, line deduplication, near-duplicates (the document with the least doc_id of each group stays), benchmark
decontamination (contaminated documents go), BPE encoding and decoding.

Every stage takes null and empty texts, very long ones, ties, repeated rows, an empty table and extra columns, whatever their
names. Null and empty texts fail the quality rules and go. Rows that share doc_id and text share every verdict: they stay
or go together. Rows of one doc_id with different texts are judged apart, but count as one document for line deduplication.
Of near-duplicates all rows of the least doc_id stay. An empty table gives an empty table.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from cedarledger.llm import bpe, decontam, exchange, line_dedup, minhash, quality


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return line_dedup.deduplicated(docs, line_dedup.keep_bitmaps(docs))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash.first_of_each(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.digests(bpe.encode_decode(docs))


STAGES = [
    ("quality", quality_rules),
    ("line_dedup", drop_lines),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", decontaminate),
    ("bpe", encode),
]
#: SQL can't express the importance scores, the components or the encoding; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each stage's documents are written as Parquet to the shared folder and read again, so no stage runs twice; what
    the next stage has read is removed.
    """
    folder = f"{exchange.shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    *first, (_, last) = STAGES
    try:
        before = None
        for name, stage in first:
            stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
            docs = spark.read.parquet(f"{folder}/{name}")
            if before:
                exchange.removed(spark, before)
            before = f"{folder}/{name}"
        return exchange.stored(last(spark, docs, sf_dir))
    finally:
        exchange.removed(spark, folder)
