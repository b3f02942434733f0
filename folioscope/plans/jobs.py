"""End-to-end jobs built from the operators. Each is one lazy plan over whole tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.functions import jsontext as js
from folioscope.functions.scores import damage_prediction
from folioscope.functions.text import text_preview
from folioscope.operators import claims, detections, lines, quality, records, routing, translate
from folioscope.operators.chunks import chunks_of, errors_of, parsed_documents, rag_chunks, struct_chunks
from folioscope.rules import CAR_THRESHOLD, DAMAGE_THRESHOLD
from folioscope.session import cut_lineage, written
from folioscope.sources import files as src
from folioscope.sources.ranges import MOST_BYTES, text_head, with_range, zip_at_end

PREVIEW_CHARS = 4000


def pdf_job(docs: DataFrame, key: str = "doc_id", raw: str = "raw") -> dict[str, DataFrame]:
    """OCR JSON of PDF documents to lines, confidence, chunks and errors.

    ``confidence`` has a row for every document, also those without lines; ``errors`` names the documents and pages
    that could not be read. Sections for chunks and errors are parsed once and written.
    """
    parsed = lines.parse_ocr(docs.select(key, raw), raw)
    sections = written(parsed_documents(docs.select(F.col(key).cast("string").alias("source_file"), F.col(raw).alias("raw"))), "sections")
    return {
        "lines": lines.flatten_lines(parsed, key),
        "confidence": lines.mean_confidence(parsed, key).select(
            key, F.col("mean_confidence").alias("confidence_score"), F.lit("PDF OCR and text chunking executed.").alias("note")
        ),
        "chunks": chunks_of(sections),
        "errors": errors_of(sections),
    }


def ordered_texts(boxes: DataFrame, column: str, min_conf: float, rtl: bool) -> DataFrame:
    """Line boxes to one array of normalised, non-blank texts per row, in reading order."""
    kept = F.filter(lines.reading_order(F.col(column), rtl), lambda b: b["confidence"] >= min_conf)
    staged = boxes.withColumn("_texts", F.transform(kept, lambda b: b["text"]))
    return lines.normalized_lines(staged, F.col("_texts"), column).withColumn(
        column, F.filter(column, lambda t: t != "")
    ).drop("_texts")


def record_job(docs: DataFrame, key: str = "doc_id", lang: str = "lang") -> dict[str, DataFrame]:
    """Card text lines (with auxiliary lines) to records, notes, translations and chunks."""
    extracted = records.with_fallback(docs, "lines", "aux_lines", lang)
    # Three outputs read the records: materialise them once instead of extracting three times.
    noted = cut_lineage(extracted.withColumn("validation_notes", records.validation_notes(F.col("record"))))
    payload = F.struct("record.*", "validation_notes", F.struct(F.col(lang), "auxiliary_ocr_lang").alias("source"))
    fields = noted.select(key, F.explode(translate.translate_record(F.col("record"))).alias("f")).select(key, "f.*")
    chunks = struct_chunks(noted.select(key, payload.alias("payload")), F.col(key).cast("string"), "payload")
    return {"records": noted, "fields": fields, "chunks": chunks}


#: Fields of a damage entry.
ENTRY = {
    "type": "string", "confidence": "double", "severity": "string", "region": "string", "bbox": "array<double>",
    "parts_at_risk": "array<string>", "repair_action": "string", "replace": "boolean",
}


def damage_job(views: DataFrame, boxes: DataFrame, claim_spine: DataFrame, plates: DataFrame | None = None,
               car_threshold: float = CAR_THRESHOLD, damage_threshold: float = DAMAGE_THRESHOLD) -> dict[str, DataFrame]:
    """Views with scores and detector boxes to damage entries and claim reports.

    Views have claim_id, view, car_prob and prob_damaged; boxes have claim_id, view and the
    detector columns. The car gate and the damage label run before the boxes are touched, so
    only boxes of damaged car views are suppressed and looked up, once. Damaged views without a
    localised entry get the general one. A ``view_error`` column marks views of failed batches.
    """
    gated = claims.gate_in_place(views, car_threshold)
    p = F.col("prob_damaged")
    error = [F.col("view_error")] if "view_error" in views.columns else []
    predicted = gated.withColumn("_p", damage_prediction(1.0 - p, p, damage_threshold)).select(
        "claim_id", "view", "is_car", "car_confidence", *error, "_p.*"
    )
    damaged = predicted.where(F.col("is_car") & F.col("damage_detected"))
    if error:  # views of a failed batch are reported with their error, not as damaged
        damaged = damaged.where("view_error IS NULL")
    on_damaged = boxes.join(damaged.select("claim_id", "view"), ["claim_id", "view"], "left_semi")
    image = F.struct("claim_id", "view")
    entries = detections.damage_entries(on_damaged.withColumn("image_id", image).drop("claim_id"), "image_id", "view")
    entry = [F.col(c) for c in ENTRY]
    found = entries.groupBy("image_id").agg(
        F.transform(F.sort_array(F.collect_list(F.struct((-F.col("confidence")).alias("o"), "det_id", F.struct(*entry).alias("e")))),
                    lambda d: d["e"]).alias("damages")
    ).select("image_id.claim_id", "image_id.view", "damages")
    general = claims.fallback_damage(damaged.join(found, ["claim_id", "view"], "left"))
    g = F.col("general_damage")
    damages = F.coalesce("damages", F.array(F.struct(*[g[c].alias(c) for c in ENTRY])))
    localised = general.select("claim_id", "view", damages.alias("damages")).dropDuplicates(["claim_id", "view"])
    with_damages = predicted.join(localised, ["claim_id", "view"], "left").withColumn(
        "damages", F.coalesce("damages", F.slice(F.array(F.struct(*[F.lit(None).cast(t).alias(c) for c, t in ENTRY.items()])), 1, 0))
    )
    report = claims.claim_rollup(with_damages, claim_spine)
    if plates is not None:
        report = claims.attach_plate(report, plates, F.col("total_views_analyzed") > 0)
    rows = localised.select("claim_id", "view", F.explode("damages").alias("d")).select("claim_id", "view", "d.*")
    return {"predictions": predicted, "damages": rows, "report": report}


def quality_job(samples: DataFrame, by: Sequence[str], order: Sequence[str], warmup: int = 1,
                headers: str | None = None) -> dict[str, DataFrame]:
    """Drop warm-up runs, parse the responses once, then summarise the narrow table.

    ``status_code`` and ``error`` are counted and ``headers`` gives the server's time, where samples have them.
    """
    measured = quality.drop_warmup(samples, by, order, warmup)
    given = [c for c in ("status_code", "error") if c in samples.columns] + (["server_ms"] if headers else [])
    parsed = quality.parse_samples(measured, headers=headers).select(
        *by, *order, "ok", "elapsed_ms", "confidence_score", "classification_label", "is_car", "damage_detected", "hitl_decision",
        "aadhaar_number_found", "required_field_count", "ocr_line_count", *given,
    )
    return quality.summaries(cut_lineage(parsed), by, ts=order[0])


def file_job(files: DataFrame) -> dict[str, DataFrame]:
    """Inspect files: category, details by category, and chunks of the JSON summary.

    Listed files (``path`` and ``length``, of any size) are looked into where needed: the last 64 KiB to tell archives
    from other binaries, the member table of an archive, the first rows of a table, the head of a text, which is
    read through in blocks to know its decoding, and JSON files whole (one that no column can hold gets an error).
    Rows that carry ``content`` are worked on as they are. A ``declared_type`` column goes before the type guessed
    from the name.
    """
    listed = "content" not in files.columns
    declared = F.col("declared_type") if "declared_type" in files.columns else None
    typed = routing.categorize(
        files.withColumn("filename", routing.base_name(F.col("path"))).withColumn("extension", routing.suffix_of(F.col("filename")))
        .withColumn("mime_type", routing.media_type(F.col("filename"), declared)).withColumn("_zip", zip_at_end(F.col("path")) if listed else src.is_zip(F.col("content"))), "_zip",
    ).drop("_zip")
    texts, objects = (typed.where(F.col("category") == c) for c in ("text", "json"))
    if listed:
        texts = texts.withColumn("_t", text_head(F.col("path"), 8 * PREVIEW_CHARS + 8))
        preview = text_preview(F.col("_t.head"), PREVIEW_CHARS, F.col("_t.valid"))
        objects = with_range(objects.select("path", "length"), "content", F.lit(0), F.when(F.col("length") <= MOST_BYTES, F.col("length")))
    else:
        preview = text_preview(F.col("content"), PREVIEW_CHARS)
    text = texts.select("path", preview.alias("p")).select("path", "p.*")
    json = objects.select("path", js.json_profile(F.col("content").cast("string")).alias("p")).select("path", "p.*")
    summary = F.to_json(
        F.struct("filename", "mime_type", "extension", F.col("length").alias("size_bytes"), "category", "suggested_process_type"),
        {"ignoreNullFields": "false"},
    )
    inventory = typed.select("path", "filename", "mime_type", "extension", F.col("length").alias("size_bytes"), "category", "suggested_process_type")
    return {
        "inventory": inventory,
        "text": text,
        "json": json,
        "tables": src.tabular_preview(typed.where(F.col("category") == "tabular")),
        "archives": src.archive_listing(typed.where(F.col("category") == "archive")),
        "chunks": rag_chunks(typed.select(F.col("filename").alias("source_file"), summary.alias("raw"))),
    }
