"""The registered queries of the corpus operators, and SQL where it can express one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, cotraining, html_extract, language_id, license_scan, media, near_dedup, packing, quality_rules, substring_dedup

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_html_extract": html_extract.op1,
    "op2_language_id": language_id.op2,
    "op3_license_scan": license_scan.op3,
    "op4_cotraining": cotraining.op4,
    "op5_media": media.op5,
    "op6_bpe": bpe.op6,
    "op7_near_dedup": near_dedup.op7,
    "op8_quality_rules": quality_rules.op8,
    "op9_packing": packing.op9,
    "op10_substring_dedup": substring_dedup.op10,
}

ORACLES: dict[str, str] = {"op3_license_scan": license_scan.oracle()}
