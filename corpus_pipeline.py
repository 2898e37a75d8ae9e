"""From raw documents to packed training sequences: five stages, each one operator of formledger.llm.

run() writes each stage as Parquet and reads it again for the next, so that a lost executor costs one stage's tasks.
"""

from __future__ import annotations

import uuid
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from formledger.llm import mixing, ngram_join, packing, quality_rules, secret_scan
from formledger.llm.common import n_words, shared_folder, small_batches
from formledger.sources.intermediate import delete


def _whole(docs: DataFrame):
    """The row as one column, so that no name an operator adds can clash with it."""
    return F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no rule of the current policy rejects."""
    return quality_rules.apply_policy(quality_rules.ledger(docs.select("text", _whole(docs)))).where("kept").select("__row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by a shingle similarity of 0.8 or more."""
    return ngram_join.keep_first(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with what the scan finds replaced by a mark; n_chars follows."""
    cleaned = secret_scan.redacted(docs)
    return cleaned.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text")).otherwise(F.col("n_chars")).cast("long"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Whole copies of the documents by source weights, in curriculum order; a document may come twice or not at all."""
    sized = docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), _whole(docs))
    return mixing.copies(mixing.mix(sized)).select("__row.*")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 2048 tokens, with their ids, in the order of the rows that mixing wrote."""
    return packing.pack(docs, place=packing.place_in_files()).withColumn("ids_crc32", F.crc32("ids"))



def _settled(stage):
    """stage, with the session's batches bounded."""

    @wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        small_batches(spark)
        return stage(spark, docs, sf_dir)

    return run_stage


STAGES = [
    ("quality_rules", _settled(quality)),
    ("ngram_join", _settled(near_duplicates)),
    ("secret_scan", _settled(secrets)),
    ("mixing", _settled(mix)),
    ("packing", _settled(pack)),
]
#: Tokenizing cannot be told in SQL: tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage; a stage's table goes once the next one has been written, and all of them after a failure."""
    folder = f"{shared_folder(spark)}/corpus-pipeline-{uuid.uuid4().hex}"
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    try:
        for name, stage in STAGES:
            stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
            docs = spark.read.parquet(f"{folder}/{name}")
            if before is not None:
                delete(spark, before)
            before = f"{folder}/{name}"
    except BaseException:
        delete(spark, folder)
        raise
    return docs
