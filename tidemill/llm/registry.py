"""The llm queries by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemill.llm import batchdedup, leakage, mixing, neardup, quality, sitelines, truncation


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "p1_found": truncation.found,
        "p1_sources": truncation.shares,
        "p1_limits": truncation.limits,
        "p2_found": neardup.found,
        "p2_classes": neardup.groups,
        "p3_found": sitelines.found,
        "p3_clean": sitelines.cleaned,
        "p5_found": batchdedup.found,
        "p6_found": leakage.found,
        "p6_items": leakage.items_report,
        "p7_mix": mixing.selection,
        "p7_shares": mixing.shares,
        "p8_found": quality.found,
        "p8_statistics": quality.report,
    }


def oracle_sql() -> dict[str, str]:
    return {"p5_found": batchdedup.SQL}
