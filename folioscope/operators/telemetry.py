"""Operational tables: envelopes, errors, request metrics, readiness."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.operators.dimensions import error_codes
from folioscope.rules import EXCEPTION_CODES, HISTOGRAM_BUCKETS, SERVER_TIME_HEADERS, STATUS_CODES

CIRCUIT_LEVELS = {"closed": 0, "half_open": 1, "open": 2}


def envelope(df: DataFrame, data: Column, error: Column, request_id: Column, endpoint: Column,
             latency_ms: Column, service_version: str, timestamp: Column, api_version: str = "v1") -> DataFrame:
    """Wrap rows as success / data / error / meta; exactly one of data and error is set."""
    failed = error.isNotNull()
    meta = F.struct(
        request_id.alias("request_id"), endpoint.alias("endpoint"), F.lit(api_version).alias("api_version"),
        F.lit(service_version).alias("service_version"), F.round(latency_ms, 2).alias("latency_ms"),
        F.date_format(timestamp, "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("timestamp"),
    )
    return df.select(
        (~failed).alias("success"), F.when(~failed, data).alias("data"), error.alias("error"), meta.alias("meta")
    )


def classify_errors(df: DataFrame, status: str = "status_code", exception: str | None = None, code: str | None = None) -> DataFrame:
    """Error code, HTTP status and retryable flag by exception class or status code.

    Without an exception the reported status is kept and only 503 and 504 are retryable. An
    error that already has a code (column ``code``) keeps it.
    """
    by_status = F.lit("INTERNAL_ERROR")
    for http, status_code in STATUS_CODES.items():
        by_status = F.when(F.col(status) == http, status_code).otherwise(by_status)
    if exception is None:
        return (
            df.withColumn("error_code", by_status)
            .withColumn("http_status", F.col(status).cast("int"))
            .withColumn("retryable", F.coalesce(F.col(status).isin(503, 504), F.lit(False)))
        )
    by_class = F.lit("INTERNAL_ERROR")
    for name, known_code in EXCEPTION_CODES.items():
        by_class = F.when(F.col(exception) == name, known_code).otherwise(by_class)
    if code is not None:
        by_class = F.coalesce(F.col(code), by_class)
    known = F.broadcast(error_codes(df.sparkSession).withColumnRenamed("code", "error_code"))  # 9 fixed rows
    return df.withColumn("error_code", by_class).join(known, "error_code", "left")


def ensure_request_id(c: Column) -> Column:
    keep = F.coalesce(c != "", F.lit(False)) & (F.length(c) <= 128)
    return F.when(keep, c).otherwise(F.replace(F.uuid(), F.lit("-"), F.lit("")))


def server_ms(headers: Column) -> Column:
    """First parsable of the server-time headers of a header map."""
    return F.coalesce(*[F.try_element_at(headers, F.lit(name)).try_cast("double") for name in SERVER_TIME_HEADERS])


def histogram(df: DataFrame, by: Sequence[str], seconds: Column,
              buckets: Sequence[float] = HISTOGRAM_BUCKETS, clamp: bool = False) -> DataFrame:
    """Cumulative ``le`` counts, sum and count per group; one pass, combined before the shuffle."""
    value = F.greatest(F.lit(0.0), seconds) if clamp else seconds
    counts = [F.count_if(value <= le).alias(f"le_{str(le).replace('.', '_')}") for le in buckets]
    return df.groupBy(*by).agg(
        *counts, F.count(value).alias("le_inf"), F.sum(value).alias("sum_seconds"), F.count(value).alias("observations")
    )


def status_class(status: Column) -> Column:
    return F.concat(F.floor(status / 100).cast("string"), F.lit("xx"))


def request_counters(df: DataFrame, by: Sequence[str], status: str = "status_code") -> DataFrame:
    return df.groupBy(*by, status_class(F.col(status)).alias("status_class")).agg(F.count(F.lit(1)).alias("requests"))


def circuit_level(state: Column) -> Column:
    level = F.lit(0)
    for name, number in CIRCUIT_LEVELS.items():
        level = F.when(state == name, number).otherwise(level)
    return level


def latest_gauge(df: DataFrame, key: str, value: Column, order: Sequence[str]) -> DataFrame:
    """Last value per key."""
    return df.groupBy(key).agg(F.max_by(value, F.struct(*order)).alias("value"))


def readiness(components: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Ready unless a critical component is down; circuits are up unless one is open.

    Components have ready, critical and, for circuits, state.
    """
    down_circuit = F.coalesce(F.bool_or(F.col("state") == "open"), F.lit(False))
    return components.groupBy(*by).agg(
        F.bool_and(F.coalesce("ready", F.lit(False)) | ~F.col("critical")).alias("ready"),
        (~down_circuit).alias("circuits_ready"),
        F.count_if(F.col("critical") & ~F.coalesce("ready", F.lit(False))).alias("critical_down"),
    )


def error_tally(df: DataFrame, code: str = "error_code") -> DataFrame:
    """Cases per error code, null counting as OK."""
    return df.groupBy(F.coalesce(F.col(code), F.lit("OK")).alias("error_code")).agg(
        F.count(F.lit(1)).alias("total"), F.count_if("ok").alias("success"), F.count_if(~F.col("ok")).alias("failure")
    )
