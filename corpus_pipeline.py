"""A training-data pipeline over ``documents``, a stage per text operator.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is
written as Parquet and read again as the next stage's ``docs``.  All but the
last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabsense.llm import decontaminate, mixing, prob_minhash, sharding, toxic_grammar
from tabsense.llm.common import fresh_name, stored, table

SHARDS = 40


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the grammar, fitted on all labels, calls toxic go."""
    model = toxic_grammar.fit(docs, table(spark, sf_dir, "labels"))
    score = fresh_name(docs, "score")
    scored = toxic_grammar.predict(docs, model, docs.columns, out=score)
    return scored.where(F.col(score) < 0.5).drop(score)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every near-duplicate class (the smallest id) stays."""
    return prob_minhash.representatives(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a ten-word window of a benchmark item go."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated so that every source weighs the same, in random order."""
    return mixing.mix(docs).select(*[F.col(f"`{c}`") for c in docs.columns])


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows in 40 shards of near-equal bytes, equal texts together."""
    return sharding.shard_documents(docs, SHARDS).withColumnRenamed("id", "doc_id")


STAGES = [
    ("toxicity", toxicity),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("source_mix", source_mix),
    ("shards", shards),
]

# The toxicity grammar and the near-duplicate classes are fitted or iterated:
# tests/llm holds run() against a brute-force version instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to ``documents``; between stages the rows are written and reread."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
