"""Rule tables and dictionaries as small dimension DataFrames."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope import rules


def parts_rules(spark: SparkSession) -> DataFrame:
    rows = [(kind, where, parts) for (kind, where), parts in rules.PARTS_AT_RISK.items()]
    return spark.createDataFrame(rows, "type string, region string, parts_at_risk array<string>")


def repair_rules(spark: SparkSession) -> DataFrame:
    rows = [(kind, level, *outcome) for (kind, level), outcome in rules.REPAIRS.items()]
    return spark.createDataFrame(rows, "type string, severity string, repair_action string, replace boolean")


def view_part_names(spark: SparkSession) -> DataFrame:
    rows = [(view, part, name) for view, names in rules.VIEW_PART_NAMES.items() for part, name in names.items()]
    return spark.createDataFrame(rows, "view string, part string, renamed string")


def view_part_map() -> Column:
    """The view renames as one literal map: view -> (part -> name)."""
    empty = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    entries = []
    for view, names in rules.VIEW_PART_NAMES.items():
        inner = F.create_map(*[F.lit(x) for x in chain(*names.items())]) if names else empty
        entries += [F.lit(view), inner]
    return F.create_map(*entries)


def translations(spark: SparkSession, pairs: dict[str, str] | None = None) -> DataFrame:
    return spark.createDataFrame(list((pairs or rules.ARABIC_ENGLISH).items()), "source string, target string")


def field_labels(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(rules.FIELD_LABELS_EN.items()), "field string, label string")


def error_codes(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(rules.ERROR_CODES, "code string, http_status int, retryable boolean")


def status_codes(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(rules.STATUS_CODES.items()), "status_code int, code string")


def media_types(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(rules.SUFFIX_MEDIA_TYPES.items()), "extension string, guessed_type string")


def dims(spark: SparkSession) -> dict[str, DataFrame]:
    """Every rule table by name."""
    return {
        "parts": parts_rules(spark),
        "repairs": repair_rules(spark),
        "view_parts": view_part_names(spark),
        "translations": translations(spark),
        "field_labels": field_labels(spark),
        "error_codes": error_codes(spark),
    }
