"""Queries over the documents table, one per operator, with the SQL that gives the same rows where SQL can.

Each operator has an interface of its own; a query here applies it to the whole table.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfwise.llm import (
    bpe, collocations, decontaminate, fill_in_middle, fingerprints, language, licenses, line_dedup, near_dedup,
    packing, pii, substring_dedup, toxicity,
)
from shelfwise.llm.frames import documents

RANKS = "byte_bpe_multi_50k.tiktoken"
PACKED_TOKENIZER = "word_bpe_49k.json"


def op1_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return near_dedup.classified(documents(spark, folder))


def op2_language_id(spark: SparkSession, folder: str) -> DataFrame:
    return language.predicted(documents(spark, folder))


def grades(spark: SparkSession, folder: str) -> DataFrame:
    """The label has two grades of severity: 0, and 1 for toxic."""
    return spark.read.parquet(f"{folder}/labels.parquet").select("doc_id", F.col("toxic").alias("grade"))


def op3_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder)
    return toxicity.scored(docs, toxicity.learn(docs, grades(spark, folder)))


def op4_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    return bpe.digests(documents(spark, folder), public_tokenizers.path(RANKS), public_tokenizers.PATTERN)


def op5_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    return licenses.found(documents(spark, folder))


def op6_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    return fingerprints.with_edits(documents(spark, folder))


def op7_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return line_dedup.report(documents(spark, folder))


def op8_personal_data(spark: SparkSession, folder: str) -> DataFrame:
    return pii.personal_data(documents(spark, folder))


def op9_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.matches(documents(spark, folder), spark.read.parquet(f"{folder}/benchmark.parquet"))


def op10_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return substring_dedup.kept_words(documents(spark, folder))


def op11_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.digests(packing.packed(documents(spark, folder), public_tokenizers.path(PACKED_TOKENIZER)))


def op12_collocations(spark: SparkSession, folder: str) -> DataFrame:
    return collocations.collocations(documents(spark, folder))


def op13_fill_in_middle(spark: SparkSession, folder: str) -> DataFrame:
    return fill_in_middle.digests(fill_in_middle.transformed(fill_in_middle.framed(documents(spark, folder))))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_near_dedup": op1_near_dedup,
    "op2_language_id": op2_language_id,
    "op3_toxicity": op3_toxicity,
    "op4_byte_bpe": op4_byte_bpe,
    "op5_license_scan": op5_license_scan,
    "op6_fingerprints": op6_fingerprints,
    "op7_line_dedup": op7_line_dedup,
    "op8_personal_data": op8_personal_data,
    "op9_decontamination": op9_decontamination,
    "op10_substring_dedup": op10_substring_dedup,
    "op11_packing": op11_packing,
    "op12_collocations": op12_collocations,
    "op13_fill_in_middle": op13_fill_in_middle,
}

SQL: dict[str, str] = {
    "op5_license_scan": licenses.sql(),
    "op7_line_dedup": line_dedup.sql(),
    "op10_substring_dedup": substring_dedup.sql(),
    "op12_collocations": collocations.sql(),
}
