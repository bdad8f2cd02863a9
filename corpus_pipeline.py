"""A corpus pipeline of the training-data operators: toxicity, near duplicates, secrets, mixing, packing.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; run() writes each stage's result as
Parquet to the cluster's shared folder and reads it again. All stages but the last return the columns of `documents`;
columns beyond those stay too. Null texts count as empty, ids may be null, and tables may be empty; what the operators
define for such cases holds here.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caslake.llm import mixing, neardup, packing, secrets, toxicity
from caslake.llm.common import fresh, materialise, release, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.5 or more for toxicity go; null scores can't occur."""
    score = fresh(docs, "toxicity_score")
    return toxicity.scored(docs, table(spark, sf_dir, "labels"), score).where(F.col(score) < 0.5).drop(score)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates stays: the one with the least id."""
    return neardup.keep_one(docs)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents stay; secrets in their texts give way to a mark, and n_chars follows."""
    clean = fresh(docs, "clean_text")
    rows = docs.withColumn(clean, secrets.redact(docs))
    chars = F.when(F.col(clean).isNull() | (F.col(clean) == F.col("text")), F.col("n_chars")).otherwise(F.length(clean).cast("long"))
    return rows.withColumn("n_chars", chars).withColumn("text", F.col(clean)).select(docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in as many copies as their source's rate draws, in a global random order."""
    return mixing.mix(docs).select(docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document goes; copies of a document never share a sequence."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("secrets", redact_secrets),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: SQL expresses neither the classifier nor the signatures, the network and the packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        after = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
        release(docs)
        docs = after
    return STAGES[-1][1](spark, docs, sf_dir)
