"""Documents to training sequences: quality rules, toxicity, near-duplicates, PII, packing.

Each stage takes (spark, docs, sf_dir) and is written as Parquet before the next one reads it.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from depthlane.llm import nearcopies, packing, pii, quality, toxicity
from depthlane.llm.queries import pii_key
from depthlane.runtime import materialise, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go; from the others the lines above their host's limit go."""
    return quality.cleaned(docs)


def toxic_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score as toxic go."""
    rows, rates = toxicity.training_rows(docs, table(spark, sf_dir, "labels"))
    return toxicity.without_toxic(docs, toxicity.fit(rows, rates))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of documents at similarity 0.8 or more the one with the least doc_id stays (one row, where rows repeat)."""
    return nearcopies.representatives(docs)


def private_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.redact(docs, pii_key(spark))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"))


STAGES = [("quality rules", quality_rules), ("toxicity", toxic_documents), ("near duplicates", near_duplicates), ("private data", private_data), ("packing", packed)]
#: Minhash values, nearest neighbours and tokens are beyond SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
