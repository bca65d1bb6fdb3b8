"""From documents to token ids: each stage takes (spark, docs, sf_dir) and works on all that the one before kept.

Documents of bad quality go; of each group of near duplicates the one of the smallest doc_id stays; secrets are masked in the text;
sources are mixed to their weights, every document at least once; the texts become ids. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from strandbase.llm import bpe, mixing, ngram_join, quality_cotraining, secret_scan
from strandbase.llm.common import Tables

#: No document is lost to the mixture: the budget is what reads the largest source once.
MIXTURE = mixing.Goal(entropy=0.9, repeat=2.0, budget="all")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_cotraining.keep_good(docs, quality_cotraining.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.keep_one(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secret_scan.redact(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(docs, MIXTURE)
    return mixed.toDF(*(f"c{i}" for i in range(len(mixed.columns)))).select(*(f"c{i}" for i in range(len(docs.columns)))).toDF(*docs.columns)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.encode(docs)


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("secrets", secrets), ("mixture", mixture), ("token_ids", token_ids)]

#: Neither the models nor the tokenizer can be expressed in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, tables, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), Tables(spark), None
    for name, stage in STAGES[:-1]:
        docs = tables.keep(stage(spark, docs, sf_dir), name)
        if before is not None:
            tables.drop(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
