"""The registered queries of this subpackage, with production parameters over whole tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from sitelens.llm import (
    conversation_repair, decontaminate, fingerprint, langid, language_model, line_dedup, packing, pii, secret_scan, simhash, toxicity, vector_codes, warc,
)
from sitelens.llm.shared import documents, shared_dir


#: The key of the registered PII query alone; whoever runs the operator brings a secret one.
QUERY_KEY = "the key of this query"


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(documents(spark, sf_dir))


def op2_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model.score(documents(spark, sf_dir))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontaminate.judged(decontaminate.search(documents(spark, sf_dir), benchmark))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(documents(spark, sf_dir))


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprints(documents(spark, sf_dir))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op8_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymise(documents(spark, sf_dir).select("doc_id", "text"), QUERY_KEY)


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.digest(secret_scan.scan(documents(spark, sf_dir)))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = documents(spark, sf_dir).select("doc_id", "source", "text")
    return line_dedup.drop_boilerplate(pages, counted=True).select("doc_id", "text", "n_lines", "n_dropped")


def op11_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages are archived and all records read back; what is told of them comes from the archives."""
    index = warc.write(spark.read.parquet(f"{sf_dir}/pages.parquet"), f"{shared_dir(spark)}/llm-warc-{uuid.uuid4().hex}")
    return warc.read(index, payloads=False).drop("payload")


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.compress(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_repair.repair(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_language_id": op1_language_id,
        "op2_lm_scores": op2_lm_scores,
        "op3_decontamination": op3_decontamination,
        "op4_packing": op4_packing,
        "op5_simhash": op5_simhash,
        "op6_fingerprints": op6_fingerprints,
        "op7_toxicity": op7_toxicity,
        "op8_pii_surrogates": op8_pii_surrogates,
        "op9_secret_scan": op9_secret_scan,
        "op10_line_dedup": op10_line_dedup,
        "op11_warc": op11_warc,
        "op12_vector_codes": op12_vector_codes,
        "op13_conversation_repair": op13_conversation_repair,
        "pipeline": pipeline,
    }


def oracle_sql() -> dict[str, str]:
    return {"op10_line_dedup": line_dedup.ORACLE_SQL, "op11_warc": warc.ORACLE_SQL, "op12_vector_codes": vector_codes.ORACLE_SQL}
