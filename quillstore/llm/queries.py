"""The registered queries of this subpackage: each applies an operator to its whole table and derives the digest columns."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import bpe, jaccard_join, license_scan, media, packing, quality, substring_dedup, token_count, toxicity, url_rules

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), WORD_BPE)


def op2_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.kept_texts(table(spark, sf_dir, "documents"), digest=True)


#: The listed rules: verdict, host, path.
URL_RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]


def op3_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_rules.judged(table(spark, sf_dir, "pages"), URL_RULES)


def op4_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.join(table(spark, sf_dir, "documents"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.token_counts(table(spark, sf_dir, "documents"), BYTE_BPE)


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.digests(table(spark, sf_dir, "documents"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.verdicts(table(spark, sf_dir, "documents"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), BYTE_BPE)


def op10_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.text_media(table(spark, sf_dir, "documents"), with_bytes=False)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_bpe": op1_bpe,
    "op2_substrings": op2_substrings,
    "op3_url_rules": op3_url_rules,
    "op4_jaccard": op4_jaccard,
    "op5_toxicity": op5_toxicity,
    "op6_token_counts": op6_token_counts,
    "op7_licenses": op7_licenses,
    "op8_quality": op8_quality,
    "op9_packing": op9_packing,
    "op10_media": op10_media,
}

ORACLE_SQL: dict[str, str] = {
    "op2_substrings": substring_dedup.ORACLE,
    "op4_jaccard": jaccard_join.ORACLE,
    "op8_quality": quality.ORACLE,
}
