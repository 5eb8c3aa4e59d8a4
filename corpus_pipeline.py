"""A corpus pipeline of four operators: toxicity, SimHash near-dedup, mixing, BPE. Part of subpackage llm.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the
columns of documents. run() writes each stage's result as Parquet in the shared folder and reads it again for the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from twinsieve.llm import bpe, mixing, neardup, toxicity
from twinsieve.llm.common import fresh_dir, table
from twinsieve.llm.queries import TOKENIZER


def stage_toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score as toxic go; labels come from the labels table, rows held out of training included in scoring."""
    return toxicity.without_toxic(docs, table(spark, sf_dir, "labels"))


def stage_simhash(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of exact and near copies stays."""
    return neardup.deduplicated(docs)


def stage_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's rate draws for it; shuffled."""
    return mixing.mixed(docs).drop("copy", "shuffle_key")


def stage_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each row, and the ids themselves."""
    return bpe.round_trip(docs, TOKENIZER, outputs=True).drop("decoded")


STAGES = [("toxicity", stage_toxicity), ("simhash_dedup", stage_simhash), ("mixing", stage_mixing), ("bpe", stage_bpe)]

#: SQL can't express the trained model of the first stage; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    at = fresh_dir(spark, "pipeline")
    for i, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{at}/{i}-{name}")
        docs = spark.read.parquet(f"{at}/{i}-{name}")
    return docs
