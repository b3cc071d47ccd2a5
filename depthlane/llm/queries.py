"""The thin queries over the operators of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from ..runtime import table
from . import attribution, bpe, htmltext, media, packing, pii, quality, sharding, simhash, toxicity


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.deduplicate(table(spark, sf_dir, "documents"))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents").select("doc_id", "text", "source")).drop("source")


def op5_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.text_media(table(spark, sf_dir, "documents"))


def op6_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return attribution.attribute(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), ranks_path=public_tokenizers.path("byte_bpe_50k.tiktoken"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    rows, rates = toxicity.training_rows(documents, table(spark, sf_dir, "labels"))
    return toxicity.score(documents, toxicity.fit(rows, rates))


def op8_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.extract_pages(table(spark, sf_dir, "pages"))


#: For the made-up persons of the test tables only; a session's depthlane.pii.key comes before it.
TEST_KEY = "key of the test tables"


def pii_key(spark: SparkSession) -> str:
    return spark.conf.get("depthlane.pii.key", None) or TEST_KEY


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.entities(table(spark, sf_dir, "documents"), pii_key(spark))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


QUERIES = {f.__name__: f for f in (op1_packing, op2_simhash, op3_sharding, op4_quality, op5_media, op6_attribution, op7_toxicity, op8_html, op9_pii, op10_bpe)}
#: CRC-32, XXH64, SHA-256 of tokens, nearest neighbours and HTML are beyond DuckDB's SQL; tests hold those queries against brute force.
ORACLES: dict[str, str] = {"op4_quality": quality.ORACLE}
