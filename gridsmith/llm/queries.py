"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chat, decontam, fingerprint, langid, line_dedup, lm, minhash, pieces, quality, suffix_dedup
from .common import read_documents


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.query(read_documents(spark, sf_dir), read_documents(spark, sf_dir, "labels"))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.query(read_documents(spark, sf_dir))


def op3_chat_preferences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.query(read_documents(spark, sf_dir, "conversations"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.query(read_documents(spark, sf_dir))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.query(read_documents(spark, sf_dir), read_documents(spark, sf_dir, "benchmark"))


def op6_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.query(read_documents(spark, sf_dir))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.query(read_documents(spark, sf_dir))


def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.query(read_documents(spark, sf_dir))


def op9_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.query(read_documents(spark, sf_dir))


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.query(read_documents(spark, sf_dir))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality": op1_quality,
    "op2_suffix_dedup": op2_suffix_dedup,
    "op3_chat_preferences": op3_chat_preferences,
    "op4_line_dedup": op4_line_dedup,
    "op5_decontamination": op5_decontamination,
    "op6_minhash": op6_minhash,
    "op7_language_id": op7_language_id,
    "op8_lm_scoring": op8_lm_scoring,
    "op9_pieces": op9_pieces,
    "op10_fingerprints": op10_fingerprints,
}

SQL: dict[str, str] = {
    "op2_suffix_dedup": suffix_dedup.SQL,
    "op3_chat_preferences": chat.SQL,
    "op4_line_dedup": line_dedup.SQL,
    "op5_decontamination": decontam.SQL,
    "op6_minhash": minhash.SQL,
    "op8_lm_scoring": lm.SQL,
}
