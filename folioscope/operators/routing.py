"""Routing: file categories, process types, request validation, review decisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.rules import (
    ARCHIVE_SUFFIXES, AUTO_ACCEPT, CARD_THRESHOLD, DEFAULT_MEDIA_TYPE, IMAGE_SUFFIXES, MAX_UPLOAD_BYTES,
    PROCESS_TYPES, REJECT_BELOW, SUFFIX_MEDIA_TYPES, TEXT_SUFFIXES,
)


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)\z", 1)


def suffix_of(name: Column) -> Column:
    """Lower-case suffix with its dot; null when there is none."""
    return F.nullif(F.lower(F.regexp_extract(name, r"[^/.](\.[^./]+)\z", 1)), F.lit(""))


def media_type(name: Column, declared: Column | None = None) -> Column:
    """Declared type if given, else guessed from the suffix, else octet-stream."""
    known = F.create_map(*(F.lit(x) for pair in SUFFIX_MEDIA_TYPES.items() for x in pair))
    chosen = F.coalesce(F.try_element_at(known, suffix_of(name)), F.lit(DEFAULT_MEDIA_TYPE))
    if declared is None:
        return chosen
    given = F.lower(F.trim(declared))
    return F.when(F.coalesce(given, F.lit("")) != "", given).otherwise(chosen)


def is_pdf(name: Column, mime: Column) -> Column:
    return F.lower(name).endswith(".pdf") | (F.lower(F.coalesce(mime, F.lit(""))) == "application/pdf")


def is_image(name: Column, mime: Column) -> Column:
    by_suffix = F.lit(False)
    for suffix in IMAGE_SUFFIXES:
        by_suffix = by_suffix | F.lower(name).endswith(suffix)
    return F.lower(F.coalesce(mime, F.lit(""))).startswith("image/") | by_suffix


def file_category(suffix: Column, mime: Column, is_zip: Column | None = None) -> Column:
    """First match wins, in this order; ``.xml`` therefore counts as text."""
    zipped = suffix.isin(*ARCHIVE_SUFFIXES)
    if is_zip is not None:
        zipped = zipped | is_zip
    return (
        F.when(mime == "application/pdf", "pdf")
        .when(mime.startswith("image/"), "image")
        .when(mime.startswith("text/") | suffix.isin(*TEXT_SUFFIXES), "text")
        .when(suffix == ".json", "json")
        .when(suffix.isin(".csv", ".tsv"), "tabular")
        .when(zipped, "archive")
        .otherwise("binary")
    )


def categorize(files: DataFrame, is_zip: str | None = None) -> DataFrame:
    """Category and suggested process type for (filename, mime_type) rows."""
    suffix = F.coalesce("extension", F.lit(""))
    category = file_category(suffix, F.col("mime_type"), F.col(is_zip) if is_zip else None)
    return files.withColumn("category", category).withColumn(
        "suggested_process_type",
        F.when(F.col("category") == "pdf", "pdf").when(F.col("category") == "image", "mulkiya").otherwise("file"),
    )


def route(docs: DataFrame, card_threshold: float = CARD_THRESHOLD) -> DataFrame:
    """Confidence source, input kind, label and note by process type, in one projection.

    Expects process_type, is_pdf, skip_ocr, has_record, card_probability, car_confidence and
    mean_line_confidence.
    """
    kind, pdf, skip = F.col("process_type"), F.col("is_pdf"), F.col("skip_ocr")
    record, card = F.col("has_record"), F.col("card_probability")
    is_card = kind == "mulkiya"
    classified = F.when(pdf, 0.0).otherwise(card)
    confidence = (
        F.when(kind == "file", 1.0)
        .when(kind == "car", F.coalesce("car_confidence", F.lit(0.0)))
        .when(kind == "pdf", F.coalesce("mean_line_confidence", F.lit(0.0)))
        .when(is_card & (skip | record), classified)
        .when(is_card, F.coalesce("mean_line_confidence", F.lit(0.0)))
    )
    input_kind = (
        F.when(kind == "file", "file").when(kind == "car", "image").when(kind == "pdf", "pdf")
        .when(is_card, F.when(pdf, "pdf").otherwise("image"))
    )
    label = F.when(
        is_card,
        F.when(pdf, "unknown").when(card >= card_threshold, "card").otherwise("not card"),
    )
    note = (
        F.when(kind == "file", "General file inspection executed without OCR.")
        .when(kind == "car", "Car classification model executed.")
        .when(kind == "pdf", "PDF OCR and text chunking executed.")
        .when(is_card & skip, "Mulkiya classification executed without OCR.")
        .when(is_card & record, "Mulkiya pipeline executed with card inference and OCR extraction.")
        .when(is_card, "Mulkiya OCR ran but structured Mulkiya JSON was not created; returned OCR lines.")
    )
    chunked = (kind == "file") | (kind == "pdf") | (is_card & ~skip)
    return (
        docs.withColumn("confidence_score", confidence).withColumn("input_kind", input_kind)
        .withColumn("classification_label", label).withColumn("note", note).withColumn("has_chunks", chunked)
    )


def check_requests(df: DataFrame, max_bytes: int = MAX_UPLOAD_BYTES) -> DataFrame:
    """Add error_code: validation errors first, then size; null for a good request."""
    named = F.coalesce(F.col("filename"), F.lit("")) != ""
    known = F.coalesce(F.col("process_type").isin(*PROCESS_TYPES), F.lit(False))
    return df.withColumn(
        "error_code",
        F.when(F.col("size_bytes") > max_bytes, "PAYLOAD_TOO_LARGE").when(~named | ~known, "VALIDATION_ERROR"),
    )


def validate_requests(df: DataFrame, max_bytes: int = MAX_UPLOAD_BYTES) -> tuple[DataFrame, DataFrame]:
    checked = check_requests(df, max_bytes)
    return checked.where(F.col("error_code").isNull()).drop("error_code"), checked.where(F.col("error_code").isNotNull())


def hitl(confidence: Column, accept: float = AUTO_ACCEPT, reject: float = REJECT_BELOW) -> Column:
    """Review decision; null confidence gives no decision."""
    return (
        F.when(confidence >= accept, "auto_accept").when(confidence < reject, "reject_or_reupload")
        .when(confidence.isNotNull(), "human_review")
    )
