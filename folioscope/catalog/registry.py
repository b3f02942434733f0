"""Every registered query and its oracle SQL."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

SECTIONS = ("sources", "routing", "joins", "aggregates", "ordered", "texts", "records", "streams", "jobs")

# Array sizes and positions are 32-bit in Spark and 64-bit in SQL; these columns are aligned.
INTEGER_COLUMNS = {
    "json_corpus": ["n_chars"],
    "archive_listing": ["n_entries"],
    "confident_lines": ["line_index"],
    "request_ids": ["n_chars"],
    "annotate_lines": ["line_index"],
    "page_stats": ["lines"],
    "claim_rollup": ["total_views_analyzed", "n_skipped"],
    "flatten_lines": ["line_index"],
    "chunk_lines": ["chunk_index"],
    "number_near_label": ["engine_cc", "max_load_kg", "seats"],
    "ordered_distinct": ["n_words"],
    "coerce_int": ["year"],
    "text_preview": ["line_count_preview"],
    "collect_texts": ["n"],
    "extract_record": ["engine_cc", "empty_weight_kg", "max_load_kg", "seats"],
    "translate_record": ["page", "line_index", "line_count"],
    "translate_lines": ["line_index"],
    "damage_reports": ["total_views_analyzed"],
}


def _gather(name: str) -> dict:
    merged: dict = {}
    for section in SECTIONS:
        merged.update(getattr(importlib.import_module(f"folioscope.catalog.{section}"), name))
    return merged


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return _gather("QUERIES")


def oracle_sql() -> dict[str, str]:
    return {key: _aligned(key, sql) for key, sql in _gather("ORACLES").items()}


def _aligned(key: str, sql: str) -> str:
    columns = INTEGER_COLUMNS.get(key)
    if not columns:
        return sql
    casts = ", ".join(f"CAST({c} AS INTEGER) AS {c}" for c in columns)
    return f"SELECT * REPLACE ({casts}) FROM (\n{sql}\n)"
