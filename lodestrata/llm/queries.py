"""Queries of the training-data operators, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources.tables import table
from . import encoding, neardup, packing, pii, provenance, secrets, splitting, syntax

Query = Callable[[SparkSession, str], DataFrame]


def p1_groups(spark: SparkSession, folder: str) -> DataFrame:
    return neardup.near_duplicate_groups(table(spark, folder, "chunks"))


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return neardup.pairs_of(p1_groups(spark, folder))


def p2_checked(spark: SparkSession, folder: str) -> DataFrame:
    return syntax.check_files(table(spark, folder, "files"))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return syntax.invalid_files(p2_checked(spark, folder))


def p2_rates(spark: SparkSession, folder: str) -> DataFrame:
    return syntax.rates(p2_checked(spark, folder))


def p3_pieces(spark: SparkSession, folder: str) -> DataFrame:
    return splitting.split_oversized(table(spark, folder, "chunks"))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return splitting.oversized_ids(p3_pieces(spark, folder))


def p4_labels(spark: SparkSession, folder: str) -> DataFrame:
    return provenance.label_files(table(spark, folder, "files"))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return provenance.not_hand_written(p4_labels(spark, folder))


def p5_redacted(spark: SparkSession, folder: str) -> DataFrame:
    return secrets.find_secrets(table(spark, folder, "chunks"))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return secrets.secret_lines(p5_redacted(spark, folder))


def p6_ids(spark: SparkSession, folder: str) -> DataFrame:
    return encoding.encode_texts(table(spark, folder, "documents"))


def p7_packed(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(table(spark, folder, "documents"))


def p8_masked(spark: SparkSession, folder: str) -> DataFrame:
    return pii.find_personal(table(spark, folder, "documents"))


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    return pii.kinds_found(p8_masked(spark, folder))


QUERIES: dict[str, Query] = {
    "p1_found": p1_found,
    "p1_groups": p1_groups,
    "p2_found": p2_found,
    "p2_rates": p2_rates,
    "p3_found": p3_found,
    "p3_pieces": p3_pieces,
    "p4_found": p4_found,
    "p4_labels": p4_labels,
    "p5_found": p5_found,
    "p5_redacted": p5_redacted,
    "p6_ids": p6_ids,
    "p7_packed": p7_packed,
    "p8_found": p8_found,
    "p8_masked": p8_masked,
}
