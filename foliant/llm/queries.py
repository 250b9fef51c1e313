"""Queries of the text operators, and the SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import encoding, lookalike, mixing, packing, personal, repetition, scan_noise, sentences
from .common import read


def _scans(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return read(spark, d, "choose_best_page_text"), read(spark, d, "page_audit"), read(spark, d, "files")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return scan_noise.found(*_scans(spark, d))


def p1_repaired(spark: SparkSession, d: str) -> DataFrame:
    return scan_noise.repaired(*_scans(spark, d))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return personal.find(read(spark, d, "choose_best_page_text"))


def p2_replaced(spark: SparkSession, d: str) -> DataFrame:
    return personal.replaced(read(spark, d, "choose_best_page_text"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    found = encoding.damaged(read(spark, d, "choose_best_page_text"), read(spark, d, "page_audit"))
    return found.select("field_name", "rec_id").distinct()


def p3_repaired(spark: SparkSession, d: str) -> DataFrame:
    return encoding.damaged(read(spark, d, "choose_best_page_text"), read(spark, d, "page_audit"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return lookalike.pairs(read(spark, d, "choose_best_page_text"))


def p4_forms(spark: SparkSession, d: str) -> DataFrame:
    return lookalike.consistent(read(spark, d, "choose_best_page_text")).select("field_name", "layer_id", "form")


def p4_classes(spark: SparkSession, d: str) -> DataFrame:
    return lookalike.membership(read(spark, d, "choose_best_page_text"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return repetition.repetitive(read(spark, d, "choose_best_page_text"))


def p5_shares(spark: SparkSession, d: str) -> DataFrame:
    return repetition.judged(read(spark, d, "choose_best_page_text"))


def p6_containers(spark: SparkSession, d: str) -> DataFrame:
    return packing.assign(read(spark, d, "documents"), read(spark, d, "pack_sizes"))


def p6_slack(spark: SparkSession, d: str) -> DataFrame:
    kinds = read(spark, d, "pack_sizes")
    return packing.slack(packing.assign(read(spark, d, "documents"), kinds), kinds)


def p7_mix(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(read(spark, d, "documents"), read(spark, d, "mix_targets"))


def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.report(p7_mix(spark, d))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return sentences.split(read(spark, d, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (p1_found, p1_repaired, p2_found, p2_replaced, p3_found, p3_repaired, p4_found, p4_forms, p4_classes, p5_found, p5_shares, p6_containers, p6_slack, p7_mix, p7_shares, p8_found)
}

ORACLE_SQL: dict[str, str] = {}
