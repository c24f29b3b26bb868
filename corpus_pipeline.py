"""A corpus pipeline of five stages, each of which applies one operator of quernel.llm to all that the stage before has kept.

1. language id: documents without a language, or in which no language has half of the words, go.
2. near duplicates: one document of each component of the 5-gram Jaccard join at 0.8 stays, the one of the smallest id.
3. decontamination: documents that hold a 10-word window of a benchmark item go.
4. secrets: every secret is replaced by a mark; documents stay.
5. mixing: documents are emitted as often as their source's target weight asks for.

Each stage but the last returns the columns of documents. A stage's input is a Parquet table.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernel.llm import decontaminate, jaccard, language, mixing, secrets
from quernel.llm.common import delete_folder, shared_dir, table

#: Stages on word shingles take five words and a similarity of 0.8.
SHINGLE_WORDS, SHINGLE_PERCENT = 5, 80


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language.keep_identified(docs)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.keep_one_of_each(docs, SHINGLE_WORDS, SHINGLE_PERCENT)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redact_secrets(docs).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.emit_mix(docs)


STAGES = [
    ("language id", identify),
    ("near duplicates", one_of_each),
    ("decontamination", decontaminated),
    ("secrets", without_secrets),
    ("mixing", mixed),
]

#: Language models and block products have no SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage, with copy, the number of the emission (from 1). A stage's table is deleted when the next one's is written."""
    docs, before = table(spark, sf_dir, "documents"), None
    for _, stage in STAGES[:-1]:
        path = f"{shared_dir(spark)}/stage-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        if before:
            delete_folder(spark, before)
        docs, before = spark.read.parquet(path), path
    return STAGES[-1][1](spark, docs, sf_dir)
