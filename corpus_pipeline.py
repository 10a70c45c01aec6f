"""A training-corpus pipeline of five stages over `documents`; each stage reads what the one before wrote.

1. toxicity: documents that the model of operator 6 scores 0.5 or more go.
2. ngram_join: of each group of linked texts (operator 7) one row stays, of the smallest id.
3. decontamination: benchmark passages are cut out; texts that are mostly such passages go (operator 8).
4. mixing: each row stays as often as the mix of operator 2 takes it (0, 1 or 2 times).
5. sharding: every row gets its shard and slot (operator 10).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from engramix.llm import decontamination, mixing, ngram_join, sharding, toxicity
from engramix.llm.common import cut, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The model is fitted on labelled rows among docs."""
    return toxicity.drop_toxic(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.keep_one(docs)


def remove_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_rows(docs)


def assign_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sharding.shard(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_join", keep_one_of_each_group),
    ("decontamination", remove_benchmark),
    ("mixing", mix_sources),
    ("sharding", assign_shards),
]

#: Learned scores and set joins have no SQL form; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = cut(docs)
    return docs
