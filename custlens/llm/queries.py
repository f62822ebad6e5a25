"""The registered queries of the text operators."""

from __future__ import annotations

import secrets
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from custlens.llm import (
    alignment, decontaminate, license_scan, line_dedup, merkle, ngram_join, packing, pii, quality_rules, secret_scan, substring_dedup, suffix_dedup, token_file)
from custlens.llm.common import documents, table


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.matches(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "n_shared", "n_item", "containment")


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(documents(spark, sf_dir)).drop("detections")


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.report(documents(spark, sf_dir))


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(documents(spark, sf_dir))


#: The setting with the key of pseudonyms; without it every call draws a new one that nobody keeps.
PII_KEY = "spark.custlens.pii.key"


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = spark.conf.get(PII_KEY, None)
    return pii.pseudonymized(documents(spark, sf_dir), key.encode() if key else secrets.token_bytes(32))


def op6_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.linked(documents(spark, sf_dir), n=3, percent=90)


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan(documents(spark, sf_dir))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.report(documents(spark, sf_dir))


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.report(documents(spark, sf_dir))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return quality_rules.report(docs, quality_rules.ordered(docs))


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.report(documents(spark, sf_dir))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.report(table(spark, sf_dir, "documents"))


def op13_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_file.round_trip(documents(spark, sf_dir))


def all_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        f.__name__: f
        for f in (
            op1_decontamination, op2_license_scan, op3_substring_dedup, op4_best_fit_packing, op5_pii, op6_ngram_join,
            op7_secret_scan, op8_line_dedup, op9_suffix_dedup, op10_quality_rules, op11_token_alignment,
            op12_merkle_manifest, op13_token_file,
        )
    }
